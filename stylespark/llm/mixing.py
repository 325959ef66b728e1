"""Mixing sources to target weights: hash-threshold histograms, without a sort.

Every document has a 60-bit hash of its id and text. A source takes each of its documents `copies` times, and once more those whose hash is at
most the source's threshold, so that the sets of growing budgets are nested. The threshold comes from histograms: words are summed by source and hash bucket, the
bucket in which the running sum reaches the budget is found, and only that bucket's documents are summed again by the next bits, until
the bucket holds a single hash. That boundary document may be a long one: what is left of the budget before it is filled in the same way beyond
it by documents that fit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylespark.llm.common import looked_up, prepared, written
from stylespark.operators.ranks import running

#: Weights of the sources in order, repeating; a target is at most MOST times its source's size.
WEIGHTS, MOST = (1, 2, 3), 3
#: Bits of a hash, and of them those that a histogram takes at a time.
HASH, BITS = 60, 10
#: How often a source's boundary is passed over for documents that fit; above every hash; types of spans and of a round's end.
ROUNDS, LAST = 4, 1 << HASH
SPANS = "array<struct<start: bigint, upto: bigint, most: double>>"
ENDS = f"array<struct<over: double, spans: {SPANS}>>"
WORD = r"[^\x20\x09-\x0D]+"


def hashed(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text: copies under other ids are dealt apart."""
    return F.conv(F.left(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))), F.lit(HASH // 4)), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """key, source_size, target from key, source_size. key: unique, "" for the null source, which comes last.

    Shares of the total by weight, but for sources whose share is more than `most` times their size: these get that much, and the others share
    what is left. In the order of size by weight the sources that stop come first, so running sums tell each source's share of the rest."""
    placed = running(sizes.select("*", F.lit(1).alias("_one"), (F.col("key") == "").alias("_last")), [], ["_last", "key"], {"_place": "_one"})
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights)).cast("int")).cast("long")
    capped = placed.select("key", "source_size", weight.alias("_w"), (most * F.col("source_size")).alias("_cap")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    ordered = written(running(capped, [], ["_ratio", "key"], {"_caps": "_cap", "_ws": "_w"}), "shares")
    whole = ordered.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.coalesce(F.sum("_w"), F.lit(0)).alias("w")).first()
    left, weights_left = F.lit(whole["t"]) - F.col("_caps"), F.lit(whole["w"]) - F.col("_ws")
    stops = F.col("_cap").cast("double") * weights_left < F.col("_w").cast("double") * left
    rest = ordered.where(~stops).agg(F.min_by(F.struct(left.alias("t"), weights_left.alias("w")), F.struct("_ratio", "key")).alias("f")).first()["f"] or {"t": 0, "w": 1}
    share = (F.col("_w") * F.lit(rest["t"])).cast("double") / F.lit(float(rest["w"]))
    return ordered.select("key", "source_size", F.when(stops, F.col("_cap").cast("double")).otherwise(share).alias("target"))


def boundaries(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """Where a source's budget is reached: key, at (the hash), before (words of smaller hashes), words (of that hash).

    rows: key, size, hash. open_: key, many (rows of the source), budget, and which rows count: hash > start and size <= most. Where these don't reach
    the budget, at is null and before all their words; sources without such rows or a budget have no row. One histogram a level over the rows of all open buckets: at most 2 ** BITS sums a source in each
    task. After the first level they are a part of about 2 ** -BITS of the rows."""
    now, done = open_.where("budget > 0").withColumns({"base": F.lit(0).cast("long"), "prefix": F.lit(0).cast("long")}), []
    for level in range(HASH // BITS):
        at = HASH - BITS * (level + 1)
        own = looked_up(rows, "key", now).where((F.col("hash") > F.col("start")) & (F.col("size") <= F.col("most")) & (F.shiftright("hash", at + BITS) == F.col("prefix")))
        each = own.groupBy("key", F.shiftright("hash", at).alias("bucket")).agg(F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        each = each if level else written(each, "histogram")
        before = F.col("base") + F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        reached = each.join(now, "key").withColumn("before", before).where(F.col("before") + F.col("words") >= F.col("budget"))
        first = reached.groupBy("key").agg(F.min_by(F.struct("bucket", "words", "low", "high", "before"), "bucket").alias("b"))
        found = written(first.select("key", "b.*").join(now, "key"), "buckets")
        done.append(found.where("low = high").select("key", F.col("low").alias("at"), "before", "words"))
        if not level:
            short = each.groupBy("key").agg(F.sum("words").alias("all")).join(now, "key").where(F.col("all") < F.col("budget"))
            done.append(short.select("key", F.lit(None).cast("long").alias("at"), F.col("all").alias("before"), F.lit(0).cast("long").alias("words")))
        now = found.where("low < high").select(*open_.columns, F.col("before").alias("base"), F.col("bucket").alias("prefix"))
        if now.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def spans(rows: DataFrame, wanted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """key and spans, an array of (start, upto, most): documents with start < hash <= upto and size <= most. wanted: key, many, budget.

    A round takes documents up to its boundary, which would exceed the budget; the next one goes on beyond the boundary with documents that fit
    into what is left. A source ends after the last round, or with the boundary of the round that comes closest with it, if that is closer."""
    open_ = wanted.withColumns({"left": F.col("budget"), "start": F.lit(-1).cast("long"), "most": F.lit(float("inf"))}).withColumns({"spans": F.array().cast(SPANS), "ends": F.array().cast(ENDS)})
    span = lambda upto: F.concat("spans", F.array(F.struct("start", upto.alias("upto"), "most")))
    best = F.array_min(F.transform("ends", lambda e, i: F.struct(e["over"].alias("over"), i.alias("i"), e["spans"].alias("spans"))))
    closed = lambda rows: rows.withColumn("best", best).select("key", F.when(F.col("best.over") <= F.col("left"), F.col("best.spans")).otherwise(F.col("spans")).alias("spans"))
    done = []
    for _ in range(rounds):
        got = boundaries(rows, open_.select("key", "many", F.col("left").alias("budget"), "start", "most"))
        left = F.col("left") - F.coalesce("before", F.lit(0)).cast("double")
        full = written(open_.join(got, "key", "left").withColumns({"over": (F.col("before") + F.col("words")).cast("double") - F.col("left"), "left": left}), "rounds")
        done.append(closed(full.where(F.col("at").isNull()).withColumn("spans", F.when(F.col("before").isNotNull(), span(F.lit(LAST).cast("long"))).otherwise(F.col("spans")))))
        ends = F.concat("ends", F.array(F.struct("over", span(F.col("at")).alias("spans"))))
        open_ = full.where("at is not null").select("key", "many", "budget", "left", F.col("at").alias("start"), F.col("left").alias("most"), span(F.col("at") - 1).alias("spans"), ends.alias("ends"))
    done.append(closed(open_))
    return reduce(DataFrame.unionByName, done)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, copies (how often the mix has the document), taken (size times copies); one row per row.

    Null and empty texts have size 0. A null source is a source of its own, the last; its name can't clash with an empty one. Whole documents are taken,
    so a source's taken words differ from its target by half of a boundary document at most, and by far less where it has small documents. Rows equal in
    id and text are taken alike: the boundary may be all of them. Sources of no words have target 0. Very long texts are taken whole; an empty table gives no rows. Further
    columns are ignored, whatever their names. Nothing depends on partitions or on the order of rows, so reruns agree.
    """
    prepared(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit(""))
    rows = written(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), key.alias("key"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), hashed(F.col(f"`{doc_id}`"), body).alias("hash")), "mix-sizes")
    sizes = written(rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("many")), "mix-sources")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    aims = targets(sizes.select("key", "source_size"), weights, most).withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    aims = written(aims.join(sizes.select("key", "many"), "key"), "mix-targets")
    taken = spans(rows.select("key", "size", "hash"), aims.select("key", "many", "budget"))
    table = written(aims.join(taken, "key").select("key", "many", "source_size", "target", "whole", "spans"), "mix-thresholds")
    total = sizes.agg(F.sum("many")).first()[0] or 0
    once = F.exists("spans", lambda s: (F.col("hash") > s["start"]) & (F.col("hash") <= s["upto"]) & (F.col("size") <= s["most"]))
    copies = F.col("whole") + once.cast("long")
    return looked_up(rows, "key", table, total=total).select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def _round(k: int) -> str:
    """SQL for the k-th round: the boundary of each source that is still open after the one before it."""
    return f"""
g{k} AS (SELECT o.source, r.h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY o.source ORDER BY r.h) AS upto FROM o{k} o JOIN r ON r.source IS NOT DISTINCT FROM o.source WHERE o.lft > 0 AND r.h > o.start AND r.size <= o.most GROUP BY o.source, r.h),
p{k} AS (SELECT o.source, min(g.h) AS hit FROM o{k} o JOIN g{k} g ON g.source IS NOT DISTINCT FROM o.source WHERE upto >= lft GROUP BY o.source),
f{k} AS (SELECT o.*, g.h AS hit, g.upto - g.words AS bef, g.words AS words FROM o{k} o LEFT JOIN p{k} p ON p.source IS NOT DISTINCT FROM o.source LEFT JOIN g{k} g ON g.source IS NOT DISTINCT FROM o.source AND g.h = p.hit),
o{k + 1} AS (SELECT source, lft - CAST(bef AS DOUBLE) AS lft, hit AS start, lft - CAST(bef AS DOUBLE) AS most, list_append(spans, {{'start': start, 'upto': hit - 1, 'most': most}}) AS spans,
  list_append(ends, {{'over': CAST(bef + words AS DOUBLE) - lft, 'i': {k}, 'spans': list_append(spans, {{'start': start, 'upto': hit, 'most': most}})}}) AS ends FROM f{k} WHERE hit IS NOT NULL),
z{k} AS (SELECT source, lft - coalesce(w, 0) AS lft, CASE WHEN w IS NULL THEN spans ELSE list_append(spans, {{'start': start, 'upto': CAST({LAST} AS BIGINT), 'most': most}}) END AS spans, ends
  FROM (SELECT f.*, (SELECT CAST(sum(words) AS DOUBLE) FROM g{k} g WHERE g.source IS NOT DISTINCT FROM f.source) AS w FROM f{k} f WHERE hit IS NULL)),"""


#: The query's rows as DuckDB SQL, with a sort by hash in place of the histograms.
SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS body FROM documents),
r AS (SELECT doc_id, source, CAST(len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || body), {HASH // 4}) AS BIGINT) AS h FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
w AS (SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS BIGINT) AS w, {MOST} * source_size AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER p, 0) AS caps, coalesce(sum(w) OVER p, 0) AS ws, sum(source_size) OVER () AS t, sum(w) OVER () AS tw, cap / CAST(w AS DOUBLE) AS ratio FROM w
  WINDOW p AS (ORDER BY cap / CAST(w AS DOUBLE), source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CAST(cap AS DOUBLE) * CAST(tw - ws AS DOUBLE) < CAST(w AS DOUBLE) * CAST(t - caps AS DOUBLE) AS stops FROM o),
fs AS (SELECT t - caps AS lt, tw - ws AS lw FROM c WHERE NOT stops ORDER BY ratio, source NULLS FIRST LIMIT 1),
a AS (SELECT source, source_size, CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE CAST(w * lt AS DOUBLE) / CAST(lw AS DOUBLE) END AS target FROM c, fs),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM a),
k AS (SELECT *, target - whole * source_size AS budget FROM b),
o0 AS (SELECT source, budget AS lft, CAST(-1 AS BIGINT) AS start, CAST('infinity' AS DOUBLE) AS most, CAST([] AS STRUCT("start" BIGINT, upto BIGINT, most DOUBLE)[]) AS spans, CAST([] AS STRUCT("over" DOUBLE, i INTEGER, spans STRUCT("start" BIGINT, upto BIGINT, most DOUBLE)[])[]) AS ends FROM k),
{"".join(map(_round, range(ROUNDS)))}
e AS (SELECT source, CASE WHEN list_sort(ends)[1]['over'] <= lft THEN list_sort(ends)[1]['spans'] ELSE spans END AS spans FROM (SELECT source, lft, spans, ends FROM o{ROUNDS} {"".join(f"UNION ALL SELECT * FROM z{k} " for k in range(ROUNDS))}))
SELECT r.doc_id, r.size, k.source_size, k.target, r.size * (k.whole + CASE WHEN len(list_filter(e.spans, lambda x: r.h > x['start'] AND r.h <= x['upto'] AND r.size <= x['most'])) > 0 THEN 1 ELSE 0 END) AS taken
FROM r JOIN k ON k.source IS NOT DISTINCT FROM r.source JOIN e ON e.source IS NOT DISTINCT FROM r.source
"""
