"""Best-fit packing: non-negative least squares over few-document length patterns, residuals by best fit.

Lengths are the only input of the plan, so it works on a histogram of at most `capacity` bins:

1. Every length is counted over all pieces (one aggregate of at most `capacity` rows).
2. Patterns of two or three lengths that fill a sequence exactly are enumerated; accelerated projected
   gradients fit their non-negative repeat counts to the histogram; counts are rounded down as far as
   pieces remain.
3. What is left goes by best fit, longest first, into the sequences with the least room, in whole runs
   of equal pieces, so that the work depends on the number of lengths and not on that of pieces.

The plan is a table of runs: ranks [first, first + many) of a length go to consecutive sequences. A piece's
rank within its length is its place in its file plus the pieces of that length in the files before,
so no length is ever gathered or sorted in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylespark.llm.common import prepared, written
from stylespark.llm.encoders import byte_bpe

CAPACITY = 2048
#: Gradient steps of the fit. Fewer leave more pieces to best fit.
STEPS = 60
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


def patterns(capacity: int, present: np.ndarray) -> np.ndarray:
    """Rows (a >= b >= c) of lengths that occur and fill a sequence exactly; c may be 0 for two pieces."""
    lengths = np.flatnonzero(present[: capacity + 1])
    lengths = lengths[lengths > 0]
    found = [np.zeros((0, 3), np.int64)]
    for a in lengths[lengths < capacity]:
        b = lengths[(lengths <= a) & (lengths <= capacity - a)]
        c = capacity - a - b
        ok = (c <= b) & ((c == 0) | present[np.maximum(c, 0)].astype(bool))
        found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(found)


def fit(rows: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that minimises |A x - counts|, A's columns being the patterns: projected gradients with momentum.
    Every pattern is weighed by the rarest of its lengths at first, so large groups of equal lengths start near."""
    if not len(rows):
        return np.zeros(0)
    size = len(counts)
    used = np.ones(rows.shape)
    used[rows == 0] = 0
    flat, weight = rows.ravel(), used.ravel()
    apply = lambda x: np.bincount(flat, np.repeat(x, 3) * weight, size)
    back = lambda r: (r[flat] * weight).reshape(-1, 3).sum(1)
    target = counts.astype(float)
    # Diagonal preconditioning: the step for a pattern is one over the patterns that its lengths share.
    share = apply(np.ones(len(rows)))
    step = 1.0 / np.maximum(1.0, back(share))
    x = np.zeros(len(rows))
    y, t = x.copy(), 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - step * back(apply(y) - target))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, how many, sequence, offset, per sequence) and the number of sequences, for counts[length]."""
    left, taken = counts.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64)
    left[0] = 0
    runs: list[tuple[int, int, int, int, int, int]] = []
    total = 0
    #: Room left -> classes [first sequence, how many sequences, offset] that have it.
    room: dict[int, list[list[int]]] = {}

    def put(length: int, many: int, sequence: int, offset: int, per: int = 1) -> None:
        runs.append((length, int(taken[length]), many, sequence, offset, per))
        taken[length] += many
        left[length] -= many

    if left[capacity]:
        n = int(left[capacity])
        put(capacity, n, total, 0)
        total += n
    rows = patterns(capacity, left > 0)
    wish = fit(rows, left)
    for k in np.argsort(-wish, kind="stable"):
        a, b, c = map(int, rows[k])
        if wish[k] < 0.5:
            break
        need: dict[int, int] = {}
        for x in (a, b, c):
            if x:
                need[x] = need.get(x, 0) + 1
        n = min(int(wish[k] + 0.5), *(int(left[x]) // m for x, m in need.items()))
        if n <= 0:
            continue
        offset = 0
        for x in (a, b, c):
            if x:
                put(x, n, total, offset)
                offset += x
        total += n
    for length in range(capacity, 0, -1):
        while left[length]:
            best = min((r for r in room if r >= length), default=None)
            if best is None:
                per = capacity // length
                n = int(left[length])
                first, offset, bins = total, 0, -(-n // per)
                total += bins
            else:
                first, bins, offset = room[best].pop()
                if not room[best]:
                    del room[best]
                per, n = best // length, int(left[length])
                want = -(-n // per)
                if want < bins:
                    room.setdefault(best, []).append([first + want, bins - want, offset])
                    bins = want
            full, rest = divmod(min(n, bins * per), per)
            if full:
                put(length, full * per, first, offset, per)
                if r := capacity - offset - per * length:
                    room.setdefault(r, []).append([first, full, offset + per * length])
            if rest:
                put(length, rest, first + full, offset, rest)
                if r := capacity - offset - rest * length:
                    room.setdefault(r, []).append([first + full, 1, offset + rest * length])
    return np.array(runs, np.int64).reshape(-1, 6), total


def _pieces(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        tool = byte_bpe()
        end = np.zeros(1, np.uint32)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi, found, edges in tool.encoded(texts):
                out: list[tuple] = []
                for doc, x, y in zip(ids[lo:hi], edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    own = np.concatenate((found[x:y], end)).astype("<u4", copy=False)
                    n, head = len(own), len(own) % capacity or capacity
                    a = 0
                    for piece, b in enumerate(range(head, n + 1, capacity)):
                        length = b - a
                        out.append((doc, piece, a, length, zlib.crc32(own[a:b]), part, int(seen[length])))
                        seen[length] += 1
                        a = b
                columns = list(zip(*out, strict=True)) or [()] * 7
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every document, with each piece's place among those of its length in its file (part, local)."""
    prepared(docs.sparkSession)
    return written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_pieces(capacity), PIECES), "pieces")


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces(). Rows: one per piece."""
    spark = cut.sparkSession
    per_file = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_file.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r.length] = r.n
    runs, _ = plan(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    share = spark.sparkContext.broadcast(runs)  # bounded by the number of lengths and patterns, not by the input
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_file.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = share.value
        key = table[:, 0] * (1 << 44) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            row = table[np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1]
            within = rank - row[:, 1]
            sequence, offset = row[:, 3] + within // row[:, 5], row[:, 4] + within % row[:, 5] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pack every document into sequences of at most `capacity` tokens.

    A document is its token ids and the end id 0. Longer ones are cut; the first piece takes the remainder.
    Null or empty texts are the end id alone. Repeated rows are packed each. Very long texts are encoded whole, one
    at a time. An empty table gives no rows. Further columns of docs are ignored, whatever their names; doc_id may be null. Ties in length are broken by file order.
    """
    return packed(pieces(docs, doc_id, text, capacity), capacity)


def fill(result: DataFrame, capacity: int = CAPACITY) -> Column:
    """The share of the packed sequences that holds tokens, as an aggregate of best_fit_packing()'s rows."""
    return F.sum("length") / (F.countDistinct("sequence_id") * F.lit(capacity))
