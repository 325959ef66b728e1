"""The most repeated word runs of a group by frequent-items summaries: counters of bounded number in each task, then an exact count of the few candidates.

A task counts a group's runs until it has too many, then takes the same number from all counters and drops those that fall to zero (Misra and Gries). What
it took in all, its shortfall, bounds what any count lacks, of dropped runs too. Counters and shortfalls of all tasks add up, so a run's true
count lies between its sum and its sum plus the group's shortfall. Only runs that can reach the group's top are counted once more, exactly. Where
the last of the top is above the shortfall no run outside the counters can be among them; where it isn't, the group is counted in full.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stylespark.functions.text import WORD
from stylespark.runtime import settled, ship

#: Counters of a group in a task, and of all groups of a task; candidates that go to all tasks at once.
COUNTERS, TASK_COUNTERS, CANDIDATES = 20_000, 400_000, 200_000

_words = re.compile(WORD).findall


def word_runs(text: str) -> list[str]:
    """The two- and three-word runs of a text in lower case."""
    w = [x.lower() for x in _words(text)]
    two = list(map("%s %s".__mod__, zip(w, islice(w, 1, None))))  # noqa: B905
    return two + list(map("%s %s".__mod__, zip(two, islice(w, 2, None))))  # noqa: B905


def cut_back(counts: Counter, keep: int) -> int:
    """Take so much from all counters that at most `keep` stay above zero; returns how much."""
    if len(counts) <= keep:
        return 0
    values = np.fromiter(counts.values(), np.int64, len(counts))
    least = int(np.partition(values, len(values) - keep - 1)[len(values) - keep - 1])
    left = {run: n - least for run, n in counts.items() if n > least}
    counts.clear()
    counts.update(left)
    return least


def _summary_of(keys: int, schema: T.StructType, most: int, all_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, Counter] = {}
        short: Counter = Counter()
        held = 0

        def rows() -> Iterator[tuple]:
            for key, counts in groups.items():
                yield (*key, None, short[key])
                for text, n in counts.items():
                    yield (*key, text, n)

        for batch in batches:
            *by, texts = [c.to_pylist() for c in batch.columns]
            for key, text in zip(zip(*by, strict=True) if by else [()] * len(texts), texts, strict=True):
                counts = groups.setdefault(key, Counter())
                held -= len(counts)
                counts.update(word_runs(text or ""))
                if len(counts) > 2 * most:
                    short[key] += cut_back(counts, most)
                held += len(counts)
                if held > 2 * all_:
                    room = max(1, all_ // len(groups))
                    for k, c in groups.items():
                        short[k] += cut_back(c, room)
                    held = sum(map(len, groups.values()))
        own, source = to_arrow_schema(schema), rows()
        while part := list(islice(source, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), own, strict=True)], names=own.names)

    return run


def _exact_of(keys: int, schema: T.StructType, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Counter] = {}
        for batch in batches:
            *by, texts = [c.to_pylist() for c in batch.columns]
            for key, text in zip(zip(*by, strict=True) if by else [()] * len(texts), texts, strict=True):
                if own := wanted.value.get(key):
                    found.setdefault(key, Counter()).update(filter(own.__contains__, word_runs(text or "")))
        out = to_arrow_schema(schema)
        rows = [(*key, text, n) for key, counts in found.items() for text, n in counts.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], names=out.names)

    return run


def top_runs(docs: DataFrame, keys: list[str], top: int, least: int, text: str = "text", counters: int = COUNTERS, candidates: int = CANDIDATES) -> DataFrame:
    """keys, gram, n, idx: each group's `top` most repeated runs of two and three words, of `least` occurrences or more, ties by text; never across texts.

    Null texts have none, null keys are groups of their own. Summaries shuffle at most `counters` rows a task and group, full counts only groups whose shortfall reaches their top."""
    spark = ship(docs.sparkSession)
    own = [f"_k{i}" for i in range(len(keys))]
    rows = docs.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(text).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL("gram string, n long").fields])
    counted = rows.mapInArrow(_summary_of(len(keys), schema, counters, TASK_COUNTERS), schema).groupBy(*own, "gram").agg(F.sum("n").alias("n"))
    summed = settled(counted, "runs")
    short = summed.where("gram is null").select(*[F.col(o).alias(f"_s{o}") for o in own], F.col("n").alias("short"))
    same = [F.col(o).eqNullSafe(F.col(f"_s{o}")) for o in own]
    known = summed.where("gram is not null").join(short, same or F.lit(True)).select(*own, "gram", "n", "short")  # without keys, one row
    order = Window.partitionBy(*own).orderBy(F.desc("n"), "gram")
    best = known.withColumn("idx", F.row_number().over(order)).where(F.col("idx") <= top)
    sure = best.where("short = 0").where(F.col("n") >= least).select(*own, "gram", "n", "idx")
    unsure = settled(short.where("short > 0"), "short")
    if unsure.isEmpty():
        done = sure
    else:
        last = best.where("short > 0").groupBy(*own).agg(F.when(F.count("*") == top, F.min("n")).otherwise(0).alias("last")).select(*[F.col(o).alias(f"_l{o}") for o in own], "last")
        at_last = [F.col(o).eqNullSafe(F.col(f"_l{o}")) for o in own]
        maybe = settled(known.where("short > 0").join(last, at_last or F.lit(True)).where(F.col("n") + F.col("short") >= F.greatest("last", F.lit(least))).select(*own, "gram", "short"), "candidates")
        wanted: dict[tuple, set] = {}
        if maybe.limit(candidates + 1).count() <= candidates:
            for r in maybe.select(*own, "gram").toLocalIterator():
                wanted.setdefault(tuple(r)[:-1], set()).add(r.gram)
        shared = spark.sparkContext.broadcast(wanted)
        again = rows.mapInArrow(_exact_of(len(keys), schema, shared), schema).groupBy(*own, "gram").agg(F.sum("n").alias("n"))
        ranked = settled(again.withColumn("idx", F.row_number().over(order)).where(F.col("idx") <= top), "exact")
        ends = ranked.groupBy(*own).agg(F.when(F.count("*") == top, F.min("n")).otherwise(0).alias("end")).select(*[F.col(o).alias(f"_e{o}") for o in own], "end")
        at_end = [F.col(f"_s{o}").eqNullSafe(F.col(f"_e{o}")) for o in own]
        state = settled(unsure.join(ends, at_end or F.lit(True), "left").select(*[f"_s{o}" for o in own], (F.coalesce("end", F.lit(0)) > F.col("short")).alias("proven")), "proofs")
        good, rest = state.where("proven"), state.where("not proven")
        done = sure.unionByName(ranked.join(good, same or F.lit(True), "left_semi").where(F.col("n") >= least).select(*own, "gram", "n", "idx"))
        if not rest.isEmpty():
            runs_of = F.udf(word_runs, "array<string>", useArrow=True)
            full = rows.join(F.broadcast(rest) if rest.limit(candidates + 1).count() <= candidates else rest, same or F.lit(True), "left_semi")
            all_ = full.select(*own, F.explode(runs_of(F.coalesce("_text", F.lit("")))).alias("gram")).groupBy(*own, "gram").agg(F.count("*").alias("n")).where(F.col("n") >= least)
            done = done.unionByName(all_.withColumn("idx", F.row_number().over(order)).where(F.col("idx") <= top).select(*own, "gram", "n", "idx"))
    return done.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], "gram", "n", "idx")
