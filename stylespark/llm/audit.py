"""Filter interaction audit: what each filter removes in every order of the filters.

Documents become masks of the filters that they fail, counted by part and mask: at most 32 cells a part, however many documents. The cells are unpivoted against
orders and steps in long form; a running bit-or window over a cell's earlier steps says which of its documents are gone by then,
conditional sums over the cells give the metrics of a step, and windows over a part's filter their totals over all orders.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stylespark.llm.common import looked_up, prepared, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
MARKS = re.compile(rb"[#$%&*|]")
CAPITALS, CONTINUED = bytes(range(0x41, 0x5B)), bytes(range(0x80, 0xC0))
METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails. Words are what bytes.split() gives: runs without space and U+0009 to U+000D."""
    words = text.split()
    points = len(text) if text.isascii() else len(text.translate(None, CONTINUED))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    few, dull = len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    return few | dull << 1 | (100 * capitals > MOST_CAPITALS * points) << 2 | (MARKS.search(text) is not None) << 3


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column(2).to_pylist()]
        bits, digests = [failures(t) for t in texts], [hashlib.sha256(t).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "bits", "digest"])


def masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, mask (bit k: the document fails the k-th filter), good, toxic: one row per document."""
    prepared(docs.sparkSession)
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    rows = written(slim.mapInArrow(_judged, "doc_id long, part string, bits int, digest binary"), "audit-bits")
    first = rows.groupBy("digest").agg(F.count("*").alias("many"), F.min("doc_id").alias("first")).where("many > 1")
    total = rows.count()
    again = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    marked = looked_up(rows, "digest", first, total=total).select("doc_id", "part", F.col("bits").bitwiseOR(F.when(again, 1 << 4).otherwise(0)).alias("mask"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    return marked.join(known, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def interactions(cells: DataFrame) -> DataFrame:
    """part, filter_order, step and metrics from cells: part, mask, n, good, toxic (counts)."""
    orders = F.explode(F.array(*map(F.lit, ORDERS)))
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))
    long = cells.select("*", orders.alias("filter_order")).select("*", steps.alias("step")).withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    bit = F.get(F.array(*[F.lit(1 << k) for k in range(len(FILTERS))]), F.instr(F.lit(FILTERS), F.col("filter")) - 1)
    earlier = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    own = long.withColumn("bit", bit).withColumn("own", F.col("mask").bitwiseAND(F.col("bit")))
    seen = own.withColumn("gone", F.coalesce(F.bit_or("own").over(earlier), F.lit(0)) != 0)
    fails, gone = F.col("own") != 0, F.col("gone")
    count = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0))
    each = seen.groupBy("part", "filter_order", "step", "filter").agg(
        count(~fails & ~gone).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"), count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(fails & ~gone, "good").alias("good_lost"), count(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return each.select("part", "filter_order", "step", *METRICS, F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"))  # a row an order


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step, zeros included: documents kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts are empty; a null part and an empty one are the part "". A document is a repeat (filter E) if its whole text, by SHA-256,
    stands under a smaller id; rows of one id aren't repeats of each other, and a null id is no repeat and makes none. A document is good, or toxic, if any label of its id says so;
    without labels none is. Very long texts are taken whole, repeated rows count each, an empty table gives no rows, and further columns
    are ignored, whatever their names.
    """
    each = masks(docs, labels, doc_id, text, part)
    cells = written(each.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic")), "audit-cells")
    return interactions(cells)


#: The query's rows as DuckDB SQL.
SQL = """
WITH RECURSIVE w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (SELECT part, doc_id, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
  coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS f FROM w),
l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT f.*, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
p AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || c FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(filter_order, c)),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, ascii(substr(filter_order, step, 1)) - 64 AS k, list_transform(range(1, step), lambda i: ascii(substr(filter_order, i, 1)) - 64) AS before
  FROM p, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5),
c AS (SELECT part, f, good, toxic, count(*) AS n FROM d GROUP BY ALL),
x AS (SELECT part, filter_order, step, k, n, good, toxic, f[k] AS fails, len(list_filter(before, lambda i: f[i])) > 0 AS gone, len(list_filter(f, lambda b: b)) AS many FROM c, s),
a AS (SELECT part, filter_order, step, k, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails AND many = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost FROM x GROUP BY part, filter_order, step, k)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM a
"""
