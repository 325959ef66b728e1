"""Line dedup by site-relative frequency: a line that stands on more than a given share of its site's pages is boilerplate.

Lines are compared without surrounding spaces, by 64-bit hashes; blank lines are neither counted nor dropped. Pages of
equal text count once, in the pages that hold a line and in the site's total: copies are not for this operator to find, and a group of them
makes none of its lines boilerplate. Groups found elsewhere, as of near copies, can count as one page in the same way. The same rule holds for sites of any size.
A site's boilerplate has at most (lines per page) / ratio entries, whatever the site's size, so the sites' lists go
to the pages in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylespark.llm.common import looked_up, prepared, quoted, written

RATIO = 0.05
#: Boilerplate lists of at most this many lines are broadcast (8 bytes each). Longer ones are joined by shuffling, but
#: those of the sites of more than one in HOT_SITES of all pages, each of (lines per page) / ratio entries at most.
MOST_LINES, HOT_SITES = 500_000, 500


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, row: str | None = None, groups: DataFrame | None = None) -> DataFrame:
    """_host, _line (hash), _with (distinct pages that hold the line), _pages: lines of two distinct pages or more, above the ratio.

    groups: row (each of docs once) and page, where the pages of a group count once; texts that are equal if not given. Only hashes of lines are shuffled."""
    body = F.col(quoted(text))
    key = [F.col(quoted(row)).alias("_key")] if groups is not None else []
    own = F.array_distinct(F.transform(F.filter(F.split("_text", "\n"), lambda x: F.trim(x) != ""), _key))
    pages = docs.where(F.col(quoted(host)).isNotNull()).select(*key, F.col(quoted(host)).alias("_host"), body.alias("_text"), F.xxhash64(body).alias("_page"))
    pages = pages.select(*(["_key"] if key else []), "_host", "_page", own.alias("_own"))
    if groups is not None:
        pages = pages.drop("_page").join(groups.select(F.col(row).alias("_key"), F.col("page").alias("_page")), "_key")
    stands = pages.select("_host", F.explode("_own").alias("_line"), "_page").distinct()
    counted = stands.groupBy("_host", "_line").agg(F.count("*").alias("_with")).where("_with > 1")
    totals = pages.select("_host", "_page").distinct().groupBy("_host").agg(F.count("*").alias("_pages"))
    few = totals.count()
    return counted.join(F.broadcast(totals) if few <= MOST_LINES else totals, "_host").where(F.col("_with") > F.lit(ratio) * F.col("_pages"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, row: str | None = None, groups: DataFrame | None = None) -> DataFrame:
    """docs with its boilerplate lines dropped from text, and n_lines, n_dropped; one row per row.

    Null texts stay null with no lines. Pages without a host keep all lines. A line at exactly the ratio stays, and
    so does a line of one distinct page. Every copy of a dropped line on a page goes; a page may become empty. Repeated rows and
    copies count as one page and lose the same lines, and so do pages of one group, where groups (row, page) are given for the key column `row` of docs.
    Near copies that are in no group count as pages of their own. Very long texts are taken whole; an empty table gives no rows.
    Columns named n_lines or n_dropped, in any case, are replaced, all others kept; their names may hold dots.
    """
    prepared(docs.sparkSession)
    found = written(boilerplate(docs, host, text, ratio, row, groups), "boilerplate")
    lists = found.groupBy("_host").agg(F.collect_list("_line").alias("_drop"))
    rest = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    own = F.col("_row")  # names of docs stay inside it and can't clash
    rows = docs.select(F.struct(*map(quoted, rest)).alias("_row"), F.col(quoted(host)).alias("_host"))
    if found.count() <= MOST_LINES:
        joined = rows.join(F.broadcast(lists), "_host", "left")
    else:
        joined = looked_up(rows, "_host", lists.join(rows.groupBy("_host").agg(F.count("*").alias("many")), "_host"), most=HOT_SITES)
    body = own[text]
    lines = F.split(body, "\n")
    # What a page and its site's list have in common is found by hashing; only that is searched line by line.
    hits = F.array_intersect(F.transform(lines, _key), "_drop")
    done = joined.withColumn("_hits", F.when(F.col("_drop").isNotNull(), hits))
    kept = F.filter(lines, lambda x: ~(F.array_contains("_hits", _key(x)) & (F.trim(x) != "")))
    done = done.withColumn("_lines", F.when(F.coalesce(F.size("_hits"), F.lit(0)) <= 0, lines).otherwise(kept))
    n = F.when(body.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    dropped = F.when(body.isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("_lines")).cast("long")
    clean = F.when(dropped > 0, F.array_join("_lines", "\n")).otherwise(body)
    return done.select(*[(clean if c == text else own[c]).alias(c) for c in rest], n.alias("n_lines"), dropped.alias("n_dropped"))
