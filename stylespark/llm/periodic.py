"""Periodic runs of words by the runs theorem.

A run is a maximal stretch whose smallest period fits twice into it. Every run has a Lyndon root that is the longest Lyndon word at its place in the order of the
letters or in the reverse one; the longest Lyndon word at a place ends before the next place whose suffix is smaller. So next-smaller values
of the inverse suffix array, in both orders, give at most two candidates a place; each is extended to the right by the longest common prefix of two suffixes, a minimum
over the LCP array by a sparse table, and to the left by the same on the reversed words.

Everything works on numpy arrays of a slice of documents, one after another with an end mark of its own for each. Documents without a repeated window
of WINDOW words are left out before: a run of LEAST words or more, of period q, repeats windows of max(q, LEAST - q) >= WINDOW words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylespark.llm.common import prepared, slices

#: Words of the shortest run, and of the windows that any such run repeats.
LEAST, WINDOW = 12, 6
#: Words of documents that are worked on together; a longer document is on its own, with about 300 bytes a word.
SLICE_WORDS = 200_000
RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def suffix_ranks(letters: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The inverse suffix array, and before it the ranks of all windows of 1, 2, 4, ... letters, by doubling.

    Equal windows have equal ranks, as the first place of their group in order. Only places that aren't told apart yet are sorted again. letters: as ranks of their own from 0 on, below their
    number; windows that hold an end mark must be unique, as they are where each end mark is."""
    n = len(letters)
    order = np.argsort(letters, kind="stable")
    same = np.empty(n, bool)
    same[:1], same[1:] = False, letters[order][1:] == letters[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    levels = [rank]
    open_ = order[same | np.append(same[1:], False)]
    step = 1
    while len(open_):
        key = rank[open_] * n + rank[open_ + step]
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        old, at = rank[open_], np.arange(len(open_))
        first_old = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        fresh = np.append(True, key[1:] != key[:-1])
        rank = rank.copy()
        rank[open_] = old + np.maximum.accumulate(np.where(fresh, at, 0)) - first_old
        levels.append(rank)
        open_ = open_[~fresh | np.append(~fresh[1:], False)]
        step *= 2
    return rank, levels


def sparse_table(values: np.ndarray, least=np.minimum) -> list[np.ndarray]:
    """Level k: least() of values[i : i + 2 ** k]."""
    table, width = [values], 1
    while 2 * width <= len(values):
        table.append(least(table[-1][:-width], table[-1][width:]))
        width *= 2
    return table


class CommonPrefixes:
    """Lengths of the longest common prefixes of suffixes: a minimum of the LCP array by its sparse table."""

    def __init__(self, letters: np.ndarray):
        self.rank, levels = suffix_ranks(letters)
        self.places = np.empty(len(letters), np.int64)
        self.places[self.rank] = np.arange(len(letters))
        a, b = self.places[:-1].copy(), self.places[1:].copy()
        lcp = np.zeros(len(a), np.int32)
        for k in range(len(levels) - 2, -1, -1):  # the last level tells all apart
            equal = levels[k][a] == levels[k][b]
            lcp[equal] += 1 << k
            a[equal] += 1 << k
            b[equal] += 1 << k
        self.table = sparse_table(lcp)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of different places."""
        x, y = self.rank[i], self.rank[j]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.table[k][low[own]], self.table[k][high[own] - (1 << int(k))])
        return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one of a smaller value, their number if there is none. values: all different.

    Near ones are looked for one by one; the others go up the sparse table of minima while a block holds none, and down to the place."""
    n = len(values)
    out, open_ = np.full(n, n), np.arange(n)
    for k in range(1, 5):
        inside = open_[open_ + k < n]
        hit = values[inside + k] < values[inside]
        out[inside[hit]] = inside[hit] + k
        open_ = inside[~hit]
    at = open_ + 5
    table = sparse_table(values)
    for k in range(len(table) - 1, -1, -1):  # greedily the widest block without a smaller value, each width at most once
        fits = at + (1 << k) <= n
        skip = np.zeros(len(at), bool)
        skip[fits] = table[k][at[fits]] > values[open_[fits]]
        at[skip] += 1 << k
    out[open_] = at
    return out


def runs(letters: np.ndarray, ends: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs of `least` letters or more, by start and period. letters: documents' letters, each document
    with an end mark behind it; end marks, at the places `ends`, are 0, 1, 2, ... and all letters are above them."""
    n = len(letters)
    right = CommonPrefixes(letters)
    i = np.arange(n)
    limit = ends[np.searchsorted(ends, i)]
    pairs = []
    for rank in (right.rank, n - 1 - right.rank):
        j = next_smaller(rank)
        own = j < limit  # words with an end mark in them, or up to it, aren't a run's first root
        pairs.append(i[own] * n + j[own])
    i, j = np.divmod(np.unique(np.concatenate(pairs)), n)
    length = right(i, j)
    own = (length > 0) & (length + 2 * (j - i) > least)  # before a run's first root stands less than a period
    i, j, length = i[own], j[own], length[own]
    if not len(i):
        return np.empty((0, 3), np.int64)
    # Backwards, a document's letters end at the mark of the document before; the first one's at a mark added here.
    left = CommonPrefixes(np.append(letters[::-1], letters.max() + 1))
    start, end, period = i - left(n - i, n - j), j + length, j - i
    own = end - start >= np.maximum(2 * period, least)
    return np.unique(np.stack([start[own], end[own], period[own]], 1), axis=0)


def with_repeated_windows(codes: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Documents, by number, that hold a window of WINDOW words twice, by 64-bit hashes; too many at worst. doc: each word's document, ends: where its words end."""
    n = max(0, len(codes) - WINDOW + 1)
    at = np.flatnonzero(np.arange(n) + WINDOW <= ends[doc[:n]])
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = doc[at].astype(np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0xD1342543DE82EF95) + mixed[at + k]
    order = np.argsort(h)
    again = h[order][1:] == h[order][:-1]
    return np.unique(doc[at[order[1:][again]]])


def planted(words: int, doc_id: int | None) -> np.ndarray | None:
    """Numbers of the words that stand at each place where the test's rule repeats a part of the text; null if it leaves the text as it is."""
    h = 0 if doc_id is None else zlib.crc32(b"%d" % doc_id)
    if doc_id is None or h % 10 or not words:
        return None
    g = h // 10
    a = g % words
    at = np.arange(words)
    at[a:] = a + (at[a:] - a) % (1 + (words - a) // (3 + g % 8))
    return at


def analysed(ids: list, texts: pa.Array, plant: bool) -> list[tuple]:
    """The rows of RUNS for a slice of documents, doc_id apart."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0)
    offsets = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[offsets - offsets[0]]
    flat = flat.filter(real)
    if plant:
        take = np.arange(len(flat))
        for k, i in enumerate(ids):
            if (at := planted(int(offsets[k + 1] - offsets[k]), i)) is not None:
                take[offsets[k] : offsets[k + 1]] = offsets[k] + at
        flat = flat.take(pa.array(take))
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    sizes, first, ends = np.diff(offsets), offsets[:-1], offsets[1:]
    some = with_repeated_windows(codes, np.repeat(np.arange(len(sizes)), sizes), ends)
    found: dict[int, np.ndarray] = {}
    kept = np.ones(len(flat), bool)
    if len(some):
        own = np.concatenate([np.arange(first[k], ends[k]) for k in some])
        marks = np.cumsum(sizes[some] + 1) - 1
        letters = np.empty(len(own) + len(some), np.int64)
        place = np.delete(np.arange(len(letters)), marks)
        letters[marks], letters[place] = np.arange(len(some)), codes[own] + len(some)
        got = runs(letters, marks)
        of = np.searchsorted(marks, got[:, 0])
        gone = np.zeros(len(letters) + 1, np.int64)
        np.add.at(gone, got[:, 0] + got[:, 2], 1)
        np.add.at(gone, got[:, 1], -1)
        kept[own] = np.cumsum(gone)[place] == 0
        begins = marks - sizes[some]
        for k in np.unique(of):
            mine = got[of == k] - [begins[k], begins[k], 0]
            found[int(some[k])] = np.stack([mine[:, 0], mine[:, 1] - mine[:, 0], mine[:, 2]], 1)
    left = np.append(0, np.cumsum(kept))[offsets]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(kept))), " ").cast(pa.binary())
    out = []
    for k, text in enumerate(joined.to_pylist()):
        mine = found.get(k, np.empty((0, 3), np.int64))
        lines = "".join("%d,%d,%d\n" % tuple(r) for r in mine.tolist())
        best = min(mine.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=[None] * 3)
        out.append((len(mine), *best, 1000 * best[1] // best[2] if best[2] else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
    return out


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256 (all runs), collapsed_sha256 (the words that stay joined by one space).

    A run of period q is collapsed to its first q words. Null, empty and blank texts have no words and no runs. Ties for the longest run go to the
    smallest start, then period. Repeated rows each give a row, null ids stay null, an empty table gives none. Very long texts are taken whole. Further columns are
    ignored, whatever their names. plant: repeat a part of some texts by their ids first, as the query op12 asks for; not of rows with a null id.
    """
    prepared(docs.sparkSession)
    names = [n.split()[0] for n in RUNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for a, b in slices(sizes, 6 * SLICE_WORDS):
                rows = list(zip(*analysed(ids[a:b].to_pylist(), texts[a:b], plant), strict=True))
                types = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([ids[a:b], *map(pa.array, rows, types)], names=names)

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, RUNS)
