"""N-gram Jaccard join: an exact self-join of documents' shingle sets, and its components.

The join is a prefix-filtered index join that skips by set relations, at two levels:

* Index level. The shingles of a set are put in one global order, rare ones first. A set is listed under its
  first n - ceil(t n) + 1 shingles (t is the threshold), with its size and the shingle's position. Entries of a list fall
  into blocks of equal size and position. Whole pairs of blocks are skipped where the size
  or the position rules out enough common shingles.
* Answer level. In each list the set with the lowest position is a leader. Every other set of the list is
  compared with it first, and the size of their intersection is kept as the leader's answer. The answers of the others are derived
  from it: two sets of the list share at least common(x, leader) + common(y, leader) - size(leader) shingles, and
  at most min(common) + min(size - common). Pairs that the first proves are links, pairs that the second rules out are skipped, and pairs inside a
  component need no answer. Of what is left, sets are counted by SKETCH hash buckets: two sets share at most the sum of the lesser counts, which
  rules out nearly all pairs of a large group of near copies that miss the threshold. Only the rest is compared, which completes the answer exactly.

Equal sets are one entity (the 64-bit hash of the set), so exact copies cost nothing beyond their first pass.
The global order is by counts of all shingles of all documents, kept in BUCKETS hashed counters of fixed
size, which partitions sum up as a tree; it decides what is compared, never what is found. Lists that are expected to be long are dealt over
several tasks by salt, and compared block against block. No list is gathered on the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylespark.llm.common import looked_up, prepared, release, slices, written
from stylespark.operators.components import stars

#: Words of a shingle and threshold of the op5 query: two sets link when 100 * |intersection| >= PERCENT * |union|.
SHINGLE, PERCENT = 4, 85
BUCKETS = 1 << 22
#: Bits of a shingle hash that are not its bucket.
BELOW = 64 - 22
#: Partitions whose counters one task sums up.
FAN = 32
CHUNK = 1 << 14
#: Bits of the filter of sets that are to be compared: so many a set, within bounds. Beyond the upper one, 2 ** 26 sets, more sets pass that aren't needed.
FILTER_A_SET, LEAST_FILTER, MOST_FILTER = 16, 1 << 24, 1 << 30
#: Entries of a list that go to one task.
LIST = 1024
#: Equal sets that a task remembers, to list them once.
SEEN = 300_000
#: Pairs of a block that are formed at a time.
GRID = 1 << 20
#: Buckets by which a set's shingles are counted, a byte each, and pairs that are bounded by them at a time.
SKETCH, BOUNDED = 512, 1 << 13

FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
BASE = 0x9E3779B97F4A7C15
MIX = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX[0]
    x = (x ^ (x >> U(27))) * MIX[1]
    return x ^ (x >> U(31))


class Powers:
    """BASE ** j and its inverse modulo 2 ** 64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 1 << 22)
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, U), np.full(m, b, U))), dtype=U) for b in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up, self.down


POWERS = Powers()


def shingle_sets(texts: list[str | None], shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: every run of `shingle` words, or all words where there are fewer."""
    raw = [(t or "").encode("utf-8", "replace").translate(FOLD) for t in texts]
    for a, b in slices([len(r) for r in raw]):
        joined = b" " + b" ".join(raw[a:b]) + b" "
        data = np.frombuffer(joined, np.uint8)
        is_word = data != 32
        edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
        begin, end = edge[::2], edge[1::2]
        up, down = POWERS.upto(len(data))
        total = np.cumsum((data.astype(U) + U(1)) * up[: len(data)], dtype=U)
        words = mixed((total[end - 1] - total[begin - 1]) * down[begin] ^ (end - begin).astype(U) * MIX[2])
        at = np.concatenate(([1], 1 + np.cumsum([len(r) + 1 for r in raw[a:b]])))
        first = np.searchsorted(begin, at)
        grams = words[:0]
        if len(words) >= shingle:
            n = len(words) - shingle + 1
            grams = words[:n].copy()
            for k in range(1, shingle):
                grams = grams * MIX[3] + words[k : n + k]
            grams = mixed(grams)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= shingle:
                yield np.unique(grams[lo : hi - shingle + 1])
            elif hi > lo:
                own = U(hi - lo)
                for w in words[lo:hi]:
                    own = U((int(own) * int(MIX[2]) + int(w)) & 0xFFFFFFFFFFFFFFFF)
                yield mixed(np.array([own], U))
            else:
                yield words[:0]


def entity(own: np.ndarray) -> int:
    """A 64-bit hash of a set of hashes."""
    total = np.array([own.sum(dtype=U), np.bitwise_xor.reduce(mixed(own + MIX[2]))], U)
    return int(mixed(total * MIX[3] + U(len(own)))[0] ^ mixed(total)[1]) - (1 << 63)


def needed(sizes: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of sets of these sizes that link."""
    return -(-percent * (sizes + others) // (100 + percent))


def listed(n: int, percent: int) -> int:
    """How many shingles of a set of n are listed."""
    return n - -(-percent * n // 100) + 1


def size_class(n: np.ndarray, percent: int) -> np.ndarray:
    """Sets of one class differ in size by less than the threshold allows."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent)).astype(np.int32)


def batch_of(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


# Hashed counters and bitmaps, dense arrays of fixed size that are merged by chunk.


def chunks(dense: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for k, part in enumerate(dense.reshape(-1, CHUNK)):
        if part.any():
            yield k, zlib.compress(part.tobytes(), 1)


def _parts(got: list[tuple[int, bytes]]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """chunk, part (this partition) and data."""
    part = TaskContext.get().partitionId()
    return pa.array([k for k, _ in got], pa.int32()), pa.array([part] * len(got), pa.int32()), pa.array([d for _, d in got], pa.binary())


def _summed(combine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(zlib.decompress(data), np.uint32)
                at = (k, part // FAN)
                total[at] = combine(total[at], own) if at in total else own
        yield batch_of(["chunk", "part", "data"], pa.array([k for k, _ in total], pa.int32()), pa.array([p for _, p in total], pa.int32()), pa.array([zlib.compress(v.astype(np.uint32).tobytes(), 1) for v in total.values()], pa.binary()))

    return run


def merged(parts: DataFrame, size: int, combine=np.add) -> np.ndarray:
    """Dense uint32 arrays given as (chunk, part, data), combined over all parts; `size` numbers come to the driver.

    Chunks of FAN parts at a time meet in a task, level after level, so that no task reads more than a few chunks of FAN parts."""
    out = np.zeros((size // CHUNK, CHUNK), np.uint32)
    now = parts.select("chunk", "part", "data")
    left = 1 + (now.agg(F.max("part")).first()[0] or 0)
    while left > 1:
        left = -(-left // FAN)
        tasks = max(1, min(left * len(out), int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        now = written(now.repartition(tasks, "chunk", F.floor(F.col("part") / FAN)).mapInArrow(_summed(combine), "chunk int, part int, data binary"), "counters")
    for r in now.groupBy("chunk").agg(F.collect_list("data").alias("data")).toLocalIterator():
        for data in r.data:  # one: a single part is left
            out[r.chunk] = combine(out[r.chunk], np.frombuffer(zlib.decompress(data), np.uint32))
    return out.ravel()


FIRST = "doc_id long, n_shingles long, ent long, chunk int, part int, data binary"


def _first(shingle: int):
    """Each document's set size and entity; then the partition's counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.uint32)
        names = [x.split()[0] for x in FIRST.split(", ")]
        for batch in batches:
            size, ent = [], []
            for own in shingle_sets(batch.column(1).to_pylist(), shingle):
                size.append(len(own))
                ent.append(entity(own) if len(own) else None)
                np.add.at(seen, (own >> U(BELOW)).astype(np.int64), np.uint32(1))
            n = len(size)
            yield batch_of(names, batch.column(0), pa.array(size, pa.int64()), pa.array(ent, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()))
        got = list(chunks(seen))
        yield batch_of(names, *(pa.nulls(len(got), pa.int64()) for _ in range(3)), *_parts(got))

    return run


POSTINGS = "key long, salt int, ent long, size int, pos int"


def _postings(levels, salts, shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, salt = levels.value, salts
        seen: set[int] = set()
        for batch in batches:
            key, ent, size, pos = [], [], [], []
            for own in shingle_sets(batch.column(0).to_pylist(), shingle):
                if not len(own) or (e := entity(own)) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(e)
                n, many = len(own), listed(len(own), percent)
                order = level[(own >> U(BELOW)).astype(np.int64)].astype(U) << U(56) | own >> U(8)
                if many < n:
                    order = np.partition(order, many - 1)[:many]
                order.sort()
                key.append(order)
                ent.append(np.full(many, e, np.int64))
                size.append(np.full(many, n, np.int32))
                pos.append(np.arange(many, dtype=np.int32))
            if not key:
                continue
            key, ent, size, pos = (np.concatenate(x) for x in (key, ent, size, pos))
            spread = salt[(key >> U(56)).astype(np.int64)]
            yield batch_of([x.split()[0] for x in POSTINGS.split(", ")], key.view(np.int64), (ent % spread).astype(np.int32), ent, size, pos)

    return run


def _lists(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """Whole lists (runs of equal first `columns` columns) of sorted rows, many at a time, as columns."""
    kept: list[np.ndarray] | None = None
    for batch in batches:
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if kept is not None:
            own = [np.concatenate(x) for x in zip(kept, own, strict=True)]
        if not len(own[0]):
            continue
        last = np.logical_and.reduce([c == c[-1] for c in own[:columns]])
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        kept = [c[cut:] for c in own]
        if cut:
            yield [c[:cut] for c in own]
    if kept is not None and len(kept[0]):
        yield kept


LED = "key long, ent long, size int, pos int, lead long, lead_size int"


def _led(spread: np.ndarray, percent: int):
    return lambda batches: _lead(batches, spread, percent)


def _lead(batches: Iterator[pa.RecordBatch], spread: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Entries of lists of two sets or more, but pairs that can't link. lead: a set to compare with first, or the entry itself."""
    for key, salt, ent, size, pos in _lists(batches, 2):
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (ent[1:] != ent[:-1]) | (pos[1:] != pos[:-1])))  # one entry per entity
        key, salt, ent, size, pos = (c[new] for c in (key, salt, ent, size, pos))
        kind = size_class(size, percent)
        order = np.lexsort((ent, pos, kind, salt, key))
        first = np.concatenate(([True], np.any([c[order][1:] != c[order][:-1] for c in (key, salt, kind)], axis=0)))
        head = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
        lead, lead_size = np.empty_like(ent), np.empty_like(size)
        led = may_link(size[order], pos[order], size[head], pos[head], percent)
        lead[order], lead_size[order] = np.where(led, ent[head], ent[order]), np.where(led, size[head], size[order])
        start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))))
        many = np.diff(np.append(start, len(key)))
        two = start[many == 2]
        keep = np.repeat(many > 2, many)
        keep[two] = keep[two + 1] = may_link(size[two], pos[two], size[two + 1], pos[two + 1], percent)
        # A salted list has its other entries in other tasks.
        keep |= spread[(key.view(U) >> U(56)).astype(np.int64)] > 1
        yield batch_of([x.split()[0] for x in LED.split(", ")], *(c[keep] for c in (key, ent, size, pos, lead, lead_size)))


def may_link(sa: np.ndarray, pa_: np.ndarray, sb: np.ndarray, pb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that share a shingle at these positions may link."""
    sa, pa_, sb, pb = (x.astype(np.int64) for x in (sa, pa_, sb, pb))
    need = needed(sa, sb, percent)
    return (np.minimum(sa, sb) >= need) & (np.minimum(sa - pa_, sb - pb) >= need)


def possible(sa, pa_, sb, pb, percent: int) -> Column:
    """Whether sets of these sizes that share a shingle at these positions may link."""
    need = F.ceil(F.lit(percent) * (sa + sb) / F.lit(100 + percent))
    return (F.least(sa, sb) >= need) & (F.least(sa - pa_, sb - pb) >= need)


def filter_bits(sets: int) -> int:
    """The filter's bits for so many sets: a power of two."""
    return min(MOST_FILTER, max(LEAST_FILTER, 1 << max(0, FILTER_A_SET * sets - 1).bit_length()))


def _bits(size: int):
    below = U(65 - size.bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 32, np.uint32)
        for batch in batches:
            own = batch.column(0).to_numpy().view(U) >> below
            np.bitwise_or.at(bits, (own >> U(5)).astype(np.int64), (U(1) << (own & U(31))).astype(np.uint32))
        yield batch_of(["chunk", "part", "data"], *_parts(list(chunks(bits))))

    return run


def _members(shared, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        below = 65 - (32 * len(bits)).bit_length()
        for batch in batches:
            ent, data = [], []
            for own in shingle_sets(batch.column(0).to_pylist(), shingle):
                if not len(own):
                    continue
                e = entity(own)
                at = (e & 0xFFFFFFFFFFFFFFFF) >> below
                if bits[at >> 5] >> np.uint32(at & 31) & np.uint32(1) and e not in seen:
                    if len(seen) < SEEN:
                        seen.add(e)
                    ent.append(e)
                    data.append(own.tobytes())
            yield batch_of(["ent", "data"], pa.array(ent, pa.int64()), pa.array(data, pa.binary()))

    return run


def sets_of(texts: DataFrame, ents: DataFrame, shingle: int) -> DataFrame:
    """ent, data (its shingles) of the entities in ents, and perhaps of others; each once. The sets are made anew from the texts: only those are shuffled."""
    size = filter_bits(ents.count())
    bits = merged(written(ents.select("ent").mapInArrow(_bits(size), "chunk int, part int, data binary"), "bits"), size // 32, np.bitwise_or)
    shared = texts.sparkSession.sparkContext.broadcast(bits)  # at most MOST_FILTER bits
    return texts.select("text").mapInArrow(_members(shared, shingle), "ent long, data binary").groupBy("ent").agg(F.first("data").alias("data"))


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common, total = [], []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
            both = np.concatenate((x, y))
            both.sort()
            common.append(int(np.count_nonzero(both[1:] == both[:-1])))
            total.append(len(both))
        yield batch_of(["u", "v", "common", "total"], batch.column(0), batch.column(1), pa.array(common, pa.int32()), pa.array(total, pa.int32()))


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) with common, their sets' intersection, and total, the sum of their sizes. sets: ent, data."""
    left = pairs.join(sets.select(F.col("ent").alias("u"), F.col("data").alias("x")), "u")
    both = left.join(sets.select(F.col("ent").alias("v"), F.col("data").alias("y")), "v").select("u", "v", "x", "y")
    return both.mapInArrow(_common, "u long, v long, common int, total int")


def sketch(own: np.ndarray) -> bytes | None:
    """How many of a set's hashes fall into each of SKETCH buckets; none where a byte can't hold one of the counts."""
    counts = np.bincount((own >> U(65 - SKETCH.bit_length())).astype(np.int64), minlength=SKETCH)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch_of(["ent", "sketch"], batch.column(0), pa.array([sketch(np.frombuffer(v.as_buffer(), U)) for v in batch.column(1)], pa.binary()))


def bounds(sketches: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """What the sets of these places share at most; no bound where one has no sketch. sketches: bytes or None."""
    known = np.array([x is not None for x in sketches], bool)
    counts = np.frombuffer(b"".join(x or bytes(SKETCH) for x in sketches), np.uint8).reshape(-1, SKETCH)
    out = np.full(len(u), np.iinfo(np.int64).max)
    for a in range(0, len(u), BOUNDED):
        x, y = u[a : a + BOUNDED], v[a : a + BOUNDED]
        out[a : a + BOUNDED][known[x] & known[y]] = np.minimum(counts[x], counts[y]).sum(1, dtype=np.int64)[known[x] & known[y]]
    return out


def linked(percent: int) -> Column:
    return F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("total") - F.col("common"))


def _open(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Pairs of a list in different components that may link, by blocks of equal size and position: the block's entities, places of the pairs in it,
    what they need to share, whether their leader's answers prove it, and the block's sketches, if they are given."""
    for rows in _lists(batches, 3):
        key, i, j, block, ent, size, pos, root, lead, lead_size, common = rows[:11]
        start = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in (key, i, j)], axis=0))))
        for a, b in zip(start, np.append(start[1:], len(key)), strict=True):
            if b - a < 2:
                continue
            order = a + np.lexsort((pos[a:b], size[a:b]))
            e, s, p, r, own = ent[order], size[order].astype(np.int64), pos[order].astype(np.int64), root[order], block[order]
            head, head_size, m = lead[order], lead_size[order].astype(np.int64), common[order].astype(np.int64)
            sketches = rows[11][order] if len(rows) > 11 else None
            cell = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (p[1:] != p[:-1]))))
            ends = np.append(cell[1:], len(s))
            cs, cp = s[cell], p[cell]
            cross = i[a] != j[a]
            for c in range(len(cell)):
                far = np.searchsorted(cs, cs[c] * 100 // percent, side="right")  # larger sizes can't link
                need = needed(cs[c], cs[c:far], percent)
                ok = np.flatnonzero((np.minimum(cs[c] - cp[c], cs[c:far] - cp[c:far]) >= need) & (cs[c] >= need)) + c
                for d in ok:
                    for f in range(cell[c], ends[c], max(1, GRID // (ends[d] - cell[d]))):
                        x = np.arange(f, min(ends[c], f + max(1, GRID // (ends[d] - cell[d]))))
                        y = np.arange(cell[d], ends[d])
                        hit = r[x][:, None] != r[y][None, :]
                        if c == d:
                            hit &= x[:, None] < y[None, :]
                        if cross:
                            hit &= own[x][:, None] != own[y][None, :]
                        u, v = np.nonzero(hit)
                        u, v = x[u], y[v]
                        # What two sets share, bounded by what they share with the same leader (m < 0: not known).
                        same = (head[u] == head[v]) & (m[u] >= 0) & (m[v] >= 0)
                        least, most = np.where(same, m[u] + m[v] - head_size[u], 0), np.where(same, np.minimum(m[u], m[v]) + np.minimum(s[u] - m[u], s[v] - m[v]), s[u])
                        enough = needed(s[u], s[v], percent)
                        open_ = most >= enough
                        if open_.any():
                            yield e, u[open_], v[open_], enough[open_], (least >= enough)[open_], sketches


def _between(percent: int):
    """The open pairs of lists that their sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e, u, v, enough, sure, sketches in _open(batches, percent):
            stay = sure | (bounds(sketches, u, v) >= enough)
            u, v = e[u[stay]], e[v[stay]]
            yield batch_of(["u", "v", "sure"], np.maximum(u, v), np.minimum(u, v), sure[stay])

    return run


def _ends(percent: int):
    """The entities of open pairs, each once a task or a few times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for e, u, v, *_ in _open(batches, percent):
            new = [x for x in e[np.unique(np.concatenate((u, v)))].tolist() if x not in seen]
            if new:
                seen = seen if len(seen) < SEEN else set()
                seen.update(new)
                yield batch_of(["ent"], pa.array(new, pa.int64()))

    return run


LISTED = ["ent", "size", "pos", "root", "lead", "lead_size", "common"]


def _dealt(opened: DataFrame, columns: list[str], tasks: int) -> DataFrame:
    """The rows of lists, dealt over tasks by pairs of their blocks. opened: key, s (blocks of the list) and the columns, ent among them."""
    dealt = opened.withColumn("block", F.pmod(F.xxhash64("ent"), F.col("s")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *columns)
    return dealt.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")


def entity_links(texts: DataFrame, first: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(u, v): each entity that is linked with others, but the smallest, and its component's smallest entity."""
    spark = texts.sparkSession
    counts = merged(first.where("chunk is not null"), BUCKETS)
    level = np.concatenate([np.minimum(255, np.floor(8 * np.log2(part.astype(np.float64) + 1))).astype(np.uint8) for part in counts.reshape(-1, CHUNK)])
    del counts
    salts = np.maximum(1, np.ceil(2 ** (np.arange(256) / 8) / LIST)).astype(np.int64)
    # Entries of a list are at most the documents; BUCKETS bytes are broadcast.
    shared = spark.sparkContext.broadcast(level)
    postings = texts.select("text").mapInArrow(_postings(shared, salts, shingle, percent), POSTINGS)
    led = written(postings.repartition("key", "salt").sortWithinPartitions("key", "salt", "pos", "ent").mapInArrow(_led(salts, percent), LED), "lists")
    leads = led.where("ent = lead").select("key", "ent", "size", "pos")
    heads = leads.groupBy("key").agg(F.min(F.struct("pos", "ent", "size")).alias("h"), F.countDistinct("ent").alias("n"), F.count("*").alias("many")).where("n > 1").drop("n")
    chief = looked_up(leads, "key", heads).where(F.col("h").isNotNull() & possible(F.col("size"), F.col("pos"), F.col("h.size"), F.col("h.pos"), percent) & (F.col("ent") != F.col("h.ent"))).select(F.col("ent").alias("a"), F.col("h.ent").alias("b"))
    pairs = led.where("ent <> lead").select(F.col("ent").alias("a"), F.col("lead").alias("b")).unionByName(chief)
    pairs = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "pairs")
    ends = written(pairs.select(F.explode(F.array("u", "v")).alias("ent")).distinct(), "ends")
    answers = written(overlaps(pairs, sets_of(texts, ends, shingle)), "answers")
    forest = stars(answers.where(linked(percent)).select("u", "v"))
    rooted = led.join(forest.select(F.col("u").alias("ent"), F.col("v").alias("root")), "ent", "left").withColumn("root", F.coalesce("root", "ent"))
    rooted = written(rooted, "rooted")
    lists = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("many")).where("lo <> hi").select("key", "many", F.ceil(F.col("many") / LIST).cast("int").alias("s"))
    opened = looked_up(rooted, "key", lists).where("s is not null")
    opened = opened.withColumn("u", F.greatest("ent", "lead")).withColumn("v", F.least("ent", "lead")).join(answers.select("u", "v", "common"), ["u", "v"], "left")
    opened = opened.withColumn("common", F.when(F.col("ent") == F.col("lead"), F.col("size")).otherwise(F.coalesce("common", F.lit(-1))))
    opened = written(opened.select("key", "s", *LISTED), "opened")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = written(_dealt(opened, LISTED, tasks).mapInArrow(_ends(percent), "ent long").distinct(), "ends")
    if not ends.limit(1).count():
        return forest
    sets = written(sets_of(texts, ends, shingle), "sets")
    sketched = opened.join(sets.mapInArrow(_sketched, "ent long, sketch binary"), "ent")
    between = _dealt(sketched, [*LISTED, "sketch"], tasks).mapInArrow(_between(percent), "u long, v long, sure boolean")
    rest = written(between.groupBy("u", "v").agg(F.max("sure").alias("sure")), "pairs")
    proven = rest.where("sure").select("u", "v")
    more = written(proven.unionByName(overlaps(rest.where("not sure").select("u", "v"), sets).where(linked(percent)).select("u", "v")), "links")
    release(sets)
    release(opened)
    return stars(forest.unionByName(more)) if more.limit(1).count() else forest


def components(sized: DataFrame, links: DataFrame) -> DataFrame:
    """sized (doc_id, n_shingles, ent) with component_id: the smallest doc_id of all documents of all linked entities.

    Documents are reduced to entities and entities to components by partial aggregates; what comes back to a large group of either goes by broadcast."""
    ents = written(sized.where("ent is not null").groupBy("ent").agg(F.min("doc_id").alias("first"), F.count("*").alias("many")), "entities")
    rooted = written(ents.join(links.select(F.col("u").alias("ent"), F.col("v").alias("root")), "ent", "left").withColumn("root", F.coalesce("root", "ent")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("many"))
    labels = written(looked_up(rooted.select("ent", "root", F.col("many").alias("copies")), "root", least).select("ent", "least", F.col("copies").alias("many")), "labels")
    return looked_up(sized, "ent", labels).select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links); one row per row.

    Words are maximal runs of characters other than space and U+0009 to U+000D, with A-Z lowered. Null or empty
    texts have the empty set and are linked with nothing, not even each other. Texts of fewer than `shingle`
    words have one shingle. Sets link when 100 * |intersection| >= percent * |union|. Equal sets are linked. Repeated rows are kept, with equal values. Null doc_ids
    take part but never are a component's id unless it has no other. Very long texts are taken whole, a document
    at a time. An empty table gives no rows. Further columns are ignored, whatever their names.
    """
    prepared(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    first = written(rows.mapInArrow(_first(shingle), FIRST), "sizes")
    links = entity_links(rows, first, shingle, percent)
    return components(first.where("chunk is null").select("doc_id", "n_shingles", "ent"), links)
