"""Near-duplicates of a batch: MinHash bands for candidates, exact Jaccard to confirm, components, earliest member.

Equal shingle sets are one class, so exact copies make no pairs of their own: a class stands for its members, and a
pair of classes for all pairs between theirs. Classes are compared by a 64-bit digest of their set; shingles are never kept for all items: those of classes
that some pair needs are made anew from the texts.

Sets of a band that don't reach the threshold (short texts with a common ending, say) are as many pairs as the square of their number. They are
ruled out in memory, by their sizes and by a sketch of each set that bounds what two sets can share, so only pairs near the threshold are written.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stylespark.functions.text import WS
from stylespark.operators.components import components
from stylespark.runtime import looked_up, release, settled, ship

# Fixed values.
SHINGLE, BANDS, ROWS, THRESHOLD = 5, 32, 4, 0.75
#: Shingles that are permuted at a time.
PART = 4096
#: Members of a band that one task compares with as many others.
BLOCK = 2048
#: Counters of a sketch, of a byte each; a set with a counter that doesn't fit has FULL in all of them.
COUNTERS, FULL = 256, 255
#: Hashes of ids that are broadcast to find the texts of the sets that pairs need (8 bytes each); more are joined.
MOST_NEEDED = 1_000_000

_words = re.compile(f"[^{WS[1:-1]}]+").findall
_draw = np.random.default_rng(12345)
_FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct five-word runs of a lower-cased text; of all its words where they are fewer; none without words."""
    import xxhash

    words = _words(text or "")
    runs = [" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []
    return np.unique(np.array([xxhash.xxh3_64_intdigest(r) for r in runs], np.uint64).view(np.int64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of ROWS minimum hashes each, from permutations of the hashes by multiplying and adding."""
    own, least = hashes.view(np.uint64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(own), PART):
        least = np.minimum(least, (own[a : a + PART, None] * _FACTORS + _SHIFTS).min(0))
    least = (least ^ least >> np.uint64(31)) * _FACTORS  # mixed with its place, so that a key names its band
    return (least ^ least >> np.uint64(29)).reshape(BANDS, ROWS).sum(1, dtype=np.uint64).view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """How many of the hashes end in each byte. The lesser counters of two sets add up to no less than what the sets share."""
    own = np.bincount(hashes.view(np.uint64) % np.uint64(COUNTERS), minlength=COUNTERS)
    return (own if own.max() < FULL else np.full(COUNTERS, FULL)).astype(np.uint8).tobytes()


def may_link(x: np.ndarray, y: np.ndarray, x_size: np.ndarray, y_size: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of these sketches (rows of counters) and sizes may reach the threshold; never false where they do."""
    least = np.minimum(x_size, y_size)
    common = np.minimum(np.minimum(x, y).sum(1, dtype=np.int64), least)
    common = np.where((x[:, 0] == FULL) & (y[:, 0] == FULL), least, common)
    return common * (1 + threshold) >= threshold * (x_size + y_size) - 1e-6


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COUNTERS)


def _hashed(bands: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                part = batch.slice(a, 100)
                sets = [shingle_hashes(t) for t in part.column(0).to_pylist()]
                kind = pa.list_(pa.int64())
                made = {"sh": pa.array(sets, kind)}
                if bands:
                    made |= {"bands": pa.array([band_keys(s) if len(s) else [] for s in sets], kind), "sketch": pa.array([sketch(s) for s in sets], pa.binary())}
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made.values()], names=[*part.schema.names[1:], *made])

    return run


def with_shingles(items: DataFrame, bands: bool = True) -> DataFrame:
    """items (text and others) with sh and, unless they aren't wanted, bands and sketch in place of text."""
    ship(items.sparkSession)
    rest = [c for c in items.columns if c != "text"]
    made = T.StructType.fromDDL("sh array<long>, bands array<long>, sketch binary").fields[: 3 if bands else 1]
    return items.select(F.lower("text").alias("text"), *rest).mapInArrow(_hashed(bands), T.StructType([*[items.schema[c] for c in rest], *made]))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def _sizes_fit(a: Column, b: Column, threshold: float) -> Column:
    return F.least(a, b) >= threshold * F.greatest(a, b) - 1e-6


def _bands(sets: DataFrame, threshold: float) -> DataFrame:
    """item, size, key, own, n, head, head_size: the bands of two sets or more, cut by size; n is how many sets a cut has, head the least of them. sets: item, size, bands; equal sets may come more than once.

    Sets of one class of sizes or of neighbouring ones may link. So a set stands in the cut of its class, which is its own, and in the next one."""
    keys = settled(sets.select("item", "size", F.explode("bands").alias("key")).distinct(), "bands")
    shared = keys.groupBy("key").agg(F.count("*").alias("many"), F.lit(True).alias("shared")).where("many > 1")
    both = settled(looked_up(keys, "key", shared).where("shared").drop("shared"), "shared-bands")
    release(keys)
    kind = F.floor(F.log("size") / -math.log(threshold)).cast("int") if threshold < 1 else F.col("size")
    cut = both.withColumn("kind", kind).withColumn("up", F.explode(F.array(F.lit(0), F.lit(1)))).select("item", "size", F.xxhash64("key", F.col("kind") + F.col("up")).alias("key"), (F.col("up") == 0).alias("own"))
    least = F.min(F.struct("item", "size"))
    heads = cut.groupBy("key").agg(F.count("*").alias("many"), F.count("*").alias("n"), least["item"].alias("head"), least["size"].alias("head_size"), F.max("own").alias("any")).where("many > 1 and any").drop("any")
    live = settled(looked_up(cut, "key", heads).where("n is not null"), "cut-bands")
    release(both)
    return live


PAIR = "a long, b long"


def _pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])


def _compared(threshold: float):
    """Pairs of each run of rows of equal key, i and j that may link and that no other run has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            key, i, j, block, item, size, own, root = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "block", "item", "size", "own", "root"))
            marks = _sketches(rows.column("sketch"))
            starts = np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            group = np.cumsum(starts)
            for d in range(1, int(np.bincount(group).max())):
                x = np.flatnonzero(group[d:] == group[:-d])
                y = x + d
                fits = (item[x] != item[y]) & (root[x] != root[y]) & (own[x] | own[y]) & ((i[x] == j[x]) | (block[x] != block[y]))
                fits &= np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]) - 1e-6
                x, y = x[fits], y[fits]
                may = may_link(marks[x], marks[y], size[x], size[y], threshold)
                if may.any():
                    yield _pairs(item[x[may]], item[y[may]])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows again, so that rows of equal key, i and j come together."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (pa.concat_tables([kept, rows]) if kept is not None else rows).combine_chunks()
        if not rows.num_rows:
            continue
        last = np.logical_and.reduce([(c := rows.column(n).to_numpy()) == c[-1] for n in ("key", "i", "j")])
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        kept = rows.slice(cut)
        if cut:
            yield rows.slice(0, cut)
    if kept is not None and kept.num_rows:
        yield kept


def _within(rows: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a > b: pairs of items of a cut, of different roots, whose sketches let them link. A cut is dealt over tasks by blocks of its members."""
    ship(rows.sparkSession)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    marked = rows.join(classes.select(F.col("digest").alias("item"), "sketch"), "item")
    dealt = marked.withColumn("block", F.pmod(F.xxhash64("item"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "item", "size", "own", "root", "sketch")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compared(threshold), PAIR).distinct()


def candidate_pairs(sets: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): every pair of sets that share a band and may reach the threshold, a > b. sets: item, size, bands; classes: digest, sketch."""
    return _within(_bands(sets, threshold).withColumn("root", F.col("item")), classes, threshold)


def _alike(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x_size, y_size = (batch.column(c).to_numpy() for c in ("a", "b", "x_size", "y_size"))
            may = may_link(_sketches(batch.column("x")), _sketches(batch.column("y")), x_size, y_size, threshold)
            yield _pairs(a[may], b[may])

    return run


def alike(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sketches let them link. classes: digest, size, sketch."""
    ship(pairs.sparkSession)
    left = pairs.join(classes.select(F.col("digest").alias("a"), F.col("size").alias("x_size"), F.col("sketch").alias("x")), "a")
    return left.join(classes.select(F.col("digest").alias("b"), F.col("size").alias("y_size"), F.col("sketch").alias("y")), "b").mapInArrow(_alike(threshold), PAIR)


def confirmed(pairs: DataFrame, items: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """a, b, jaccard of the pairs that reach the threshold. items: id, text; classes: digest, least. Only the texts of sets of a pair are read for their shingles, one a set, and only these are shuffled."""
    pairs = settled(pairs, "candidates")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    needed = settled(classes.join(ends, "digest", "left_semi").select(F.xxhash64("least").alias("at")), "needed")
    few = needed.limit(MOST_NEEDED + 1).count() <= MOST_NEEDED
    texts = items.select("text", F.xxhash64("id").alias("at")).join(F.broadcast(needed) if few else needed, "at", "left_semi").select("text")
    own = settled(with_shingles(texts, bands=False).select(F.xxhash64("sh").alias("item"), "sh"), "needed-sets")
    left = pairs.join(own.select(F.col("item").alias("a"), F.col("sh").alias("x")), "a")
    both = left.join(own.select(F.col("item").alias("b"), F.col("sh").alias("y")), "b")
    found = settled(both.select("a", "b", similarity(F.col("x"), F.col("y")).alias("jaccard")).where(F.col("jaccard") >= threshold).distinct(), "confirmed")
    for made in (own, needed, pairs):
        release(made)
    return found


def cluster_roots(banded: DataFrame, classes: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """node, root: components of the sets that are linked, as if every pair that shares a band had been compared. banded: item, size, bands; classes: digest, least, size, sketch; items: id, text.

    Each set is first compared with the least one of its bands, which links most of a group of near copies. A pair
    inside one component changes nothing, so what remains are the pairs of a band in different components."""
    live = _bands(banded, threshold)
    led = live.where((F.col("item") != F.col("head")) & _sizes_fit(F.col("size"), F.col("head_size"), threshold)).select(F.col("item").alias("a"), F.col("head").alias("b")).distinct()
    forest = components(confirmed(alike(led, classes, threshold), items, classes, threshold).select("a", "b"))
    rooted = live.join(forest.withColumnRenamed("node", "item"), "item", "left").select("key", "item", "size", "own", "n", F.coalesce("root", "item").alias("root"))
    rooted = settled(rooted, "rooted")
    release(live)
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("many")).where("lo <> hi").select("key", "many", F.lit(True).alias("mixed"))
    rest = looked_up(rooted, "key", mixed).where("mixed")
    more = settled(confirmed(_within(rest, classes, threshold), items, classes, threshold).select("a", "b"), "links")
    release(rooted)
    if not more.limit(1).count():
        return forest
    return components(forest.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def _sets(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each item with the digest of its set (null where that is empty); the classes: digest, the least id in it, how many, size and sketch of the set; and item (the digest) with size and bands, a row an item."""
    digest = F.when(F.size("sh") > 0, F.xxhash64("sh"))
    full = settled(with_shingles(items).withColumn("digest", digest).withColumn("size", F.size("sh").cast("long")).drop("sh"), "digests")
    some = full.where("digest is not null")
    classes = settled(some.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("many"), F.first("size").alias("size"), F.first("sketch").alias("sketch")), "classes")
    return full.drop("bands", "sketch", "size"), classes, some.select(F.col("digest").alias("item"), "size", "bands")


def duplicate_pairs(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, jaccard, links: pairs of classes, a >= b, that reach the threshold, by the least id of each. items: id, text.

    links is how many pairs of items a row stands for: all between two classes, or all within one (a = b, of two members or more)."""
    _, classes, banded = _sets(items)
    found = confirmed(candidate_pairs(banded, classes, threshold), items, classes, threshold)
    small = classes.select("digest", "least", "many")
    between = found.join(small.toDF("a", "least_a", "x"), "a").join(small.toDF("b", "least_b", "y"), "b")
    between = between.select(F.greatest("least_a", "least_b").alias("a"), F.least("least_a", "least_b").alias("b"), "jaccard", (F.col("x") * F.col("y")).alias("links"))
    n = F.col("many")
    within = classes.where("many > 1").select(F.col("least").alias("a"), F.col("least").alias("b"), F.lit(1.0).alias("jaccard"), (n * (n - 1) / 2).cast("long").alias("links"))
    return between.unionByName(within)


def duplicate_links(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, class_id (the least id of equal sets), links (how many other items reach the threshold with it); one row per item."""
    own, classes, banded = _sets(items)
    pairs = confirmed(candidate_pairs(banded, classes, threshold), items, classes, threshold).select("a", "b")
    ends = pairs.toDF("digest", "to").unionByName(pairs.select(F.col("b").alias("digest"), F.col("a").alias("to")))
    far = ends.join(classes.select(F.col("digest").alias("to"), F.col("many").alias("x")), "to").groupBy("digest").agg(F.sum("x").alias("far"))
    links = classes.join(far, "digest", "left").select("digest", "many", "least", (F.coalesce("far", F.lit(0)) + F.col("many") - 1).alias("links"))
    return looked_up(own, "digest", links).select("id", F.coalesce("least", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicates(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, dedup_cluster_id, is_canonical: clusters are transitive, the earliest timestamp (then least id) names its cluster. items: id, text, timestamp."""
    own, classes, banded = _sets(items)
    roots = cluster_roots(banded, classes, items, threshold)
    firsts = own.where("digest is not null").groupBy("digest").agg(F.min(F.struct("timestamp", "id")).alias("first"), F.count("*").alias("many"))
    rooted = settled(firsts.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest")).withColumnRenamed("many", "copies"), "rooted-classes")
    earliest = rooted.groupBy("root").agg(F.min("first")["id"].alias("dedup_cluster_id"), F.count("*").alias("many"))
    named = settled(looked_up(rooted.select("digest", "root", "copies"), "root", earliest).select("digest", "dedup_cluster_id", F.col("copies").alias("many")), "named")
    found = looked_up(own, "digest", named).withColumn("dedup_cluster_id", F.coalesce("dedup_cluster_id", "id"))
    return found.select("id", "dedup_cluster_id", (F.col("id") == F.col("dedup_cluster_id")).alias("is_canonical"))
