"""Language identification by string kernels with Nyström landmarks and one-versus-rest kernel ridge regression.

A text is the set of its byte n-grams (N of them) after A-Z are lowered and runs of other ASCII than
letters become a space; n-grams are hashed to DIM places. The blended presence kernel is

    k(x, z) = |P(x) & P(z)| / sqrt(|P(x)| |P(z)|)

Landmarks are a bounded sample of the training documents. Training documents are mapped by
k(x, landmarks) K^(-1/2); a ridge regression on that map is fitted for each language. As the kernel is
an inner product of presence vectors, landmarks and weights fold into one DIM x languages matrix, and a
batch of documents is scored by one matrix product. A text of more than PART characters is cut into equal parts of PART at most, and
its vector is the mean of theirs, in training as in scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stylespark.llm.common import prepared, quoted, slices, widened

N = (2, 3, 4)
DIM = 1 << 14
#: Bounds of the sample: landmarks and training documents of a language. Every language is learnt.
LANDMARKS, TRAIN = 64, 800
#: With more languages than MANY each has fewer, so that the sample doesn't grow, but no fewer than these.
MANY, LEAST_LANDMARKS, LEAST_TRAIN = 64, 4, 50
RIDGE = 1e-3
#: Documents of a matrix product.
BLOCK = 256
#: Characters of a text that are looked at together, as presence fills up with length.
PART = 20_000
#: Sharpness of the score.
SHARP = 6.0
UND = "und"
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def presence(texts: list[str | None]) -> np.ndarray:
    """(texts, DIM) booleans; whole texts."""
    out = np.zeros((len(texts), DIM), bool)
    flat = out.reshape(-1)
    folded = [b" " + b" ".join((t or "").encode("utf-8", "replace").translate(FOLD).split()) + b" " for t in texts]
    for a, b in slices([len(f) for f in folded], 1 << 20):
        data = np.frombuffer(b"\0\0\0".join(folded[a:b]) + b"\0\0\0", np.uint8).astype(np.uint32)
        rows = np.repeat(np.arange(a, b, dtype=np.int64) * DIM, [len(f) + 3 for f in folded[a:b]])
        gram = data.copy()
        for n in range(2, max(N) + 1):
            gram = gram[:-1] * np.uint32(0x01000193) ^ data[n - 1 :]
            if n in N:
                ok = data[n - 1 :] != 0  # none reaches into the next text
                ok &= data[: len(ok)] != 0
                key = (gram * np.uint32(0x9E3779B1) ^ np.uint32(n * 0x45EBCA6B & 0xFFFFFFFF)) >> np.uint32(18)
                flat[rows[: len(ok)][ok] + key[ok]] = True
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of presence as unit vectors, so that inner products are kernel values."""
    x = rows.astype(np.float32)
    return x / np.sqrt(np.maximum(1.0, x.sum(1, keepdims=True)))


def parts_of(text: str | None) -> list[str]:
    """Equal parts of PART characters at most; one of an empty text."""
    text = text or ""
    n = max(1, -(-len(text) // PART))
    return [text[len(text) * k // n : len(text) * (k + 1) // n] for k in range(n)]


class Packed:
    """Training vectors in little space: bits of presence, or for texts of several parts the mean of their vectors as half floats."""

    def __init__(self, rows: list[bytes]) -> None:
        self.rows = rows

    @staticmethod
    def of(texts: list[str | None]) -> Iterator[bytes]:
        for a in range(0, len(texts), BLOCK):
            for text in texts[a : a + BLOCK]:
                own = parts_of(text)
                if len(own) == 1:
                    yield np.packbits(presence(own)[0]).tobytes()
                else:
                    sums = sum(len(part) * unit(presence([part]))[0] for part in own)
                    yield (sums / len(text)).astype("<f2").tobytes()

    def __getitem__(self, which: np.ndarray) -> np.ndarray:
        out = np.empty((len(which), DIM), np.float32)
        for k, i in enumerate(which):
            row = np.frombuffer(self.rows[i], np.uint8)
            out[k] = unit(np.unpackbits(row)[None, :])[0] if len(row) == DIM // 8 else row.view("<f2")
        return out


def bound(most: int, least: int, languages: int) -> int:
    """Landmarks or training documents of each of so many languages."""
    return max(least, min(most, most * MANY // max(1, languages)))


def fit(rows: Packed, languages: list[str]) -> tuple[list[str], np.ndarray]:
    """Names and the DIM x languages matrix, from texts' vectors and their languages. The first LANDMARKS rows of a language (fewer where there are many languages) are landmarks."""
    names = sorted(set(languages))
    place = {v: k for k, v in enumerate(names)}
    y = np.array([place[v] for v in languages], np.int64)
    if not names:
        return [], np.zeros((DIM, 0), np.float32)
    most = bound(LANDMARKS, LEAST_LANDMARKS, len(names))
    marks = np.concatenate([np.flatnonzero(y == k)[:most] for k in range(len(names))])
    z = rows[marks]
    values, vectors = np.linalg.eigh(z.astype(np.float64) @ z.T)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    gram, right = np.zeros((keep.sum(), keep.sum())), np.zeros((keep.sum(), len(names)))
    sizes = np.bincount(y, minlength=len(names))
    for a in range(0, len(y), BLOCK):
        own = y[a : a + BLOCK]
        phi = (rows[np.arange(a, a + len(own))] @ z.T).astype(np.float64) @ root
        weight = (len(y) / len(names) / sizes[own])[:, None]
        gram += phi.T @ (phi * weight)
        right += (phi * weight).T @ (2.0 * (own[:, None] == np.arange(len(names))) - 1)
    solved = np.linalg.solve(gram + RIDGE * len(y) * np.eye(len(gram)), right)
    return names, (z.T.astype(np.float64) @ (root @ solved)).astype(np.float32)


def _values(parts: list[str | None], matrix: np.ndarray) -> np.ndarray:
    out = []
    for a in range(0, len(parts), BLOCK):
        rows = presence(parts[a : a + BLOCK])
        out.append(rows.astype(np.float32) @ matrix / np.sqrt(np.maximum(1, np.count_nonzero(rows, axis=1)))[:, None])
    return np.concatenate(out)


def scores(texts: list[str | None], names: list[str], matrix: np.ndarray) -> Iterator[tuple[str, float]]:
    """(language, score) of each text. The score, 0.5 to 1, grows with the lead of the best value over the second one, whatever the number of languages."""
    for a in range(0, len(texts), BLOCK):
        own = texts[a : a + BLOCK]
        if not names:
            yield from ((UND, 0.0) for _ in own)
            continue
        cuts = [parts_of(t) for t in own]
        parts = [part for cut in cuts for part in cut]
        sizes = np.array([len(part) for part in parts], np.float32)[:, None]
        sizes[[k for k, cut in zip(np.cumsum([0, *map(len, cuts)])[:-1], cuts, strict=True) if len(cut) == 1]] = 1
        first = np.cumsum([0, *map(len, cuts)])[:-1]
        value = np.add.reduceat(_values(parts, matrix) * sizes, first) / np.add.reduceat(sizes, first)
        top = value.argmax(1)
        best = value[np.arange(len(own)), top]
        value[np.arange(len(own)), top] = -np.inf
        second = np.maximum(value.max(1), -1.0)  # -1 is what the regression aims at for a text of another language
        for t, k, s in zip(own, top, 1 / (1 + np.exp(-SHARP * (best - second))), strict=True):
            yield (names[k], float(s)) if has_letter(t) else (UND, 0.0)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5; 0 is held out."""
    return F.crc32(F.col(quoted(doc_id)).cast("string").cast("binary")) % 5


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(Packed.of(texts)), pa.binary())], names=["doc_id", "lang", "bits"])


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Fit on a bounded sample of the documents that aren't held out, at most about TRAIN + 4 sqrt(TRAIN) of each language."""
    own = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(lang)).alias("lang"), F.col(quoted(text)).alias("text"), F.coalesce(fold(doc_id), F.lit(1)).alias("fold"))
    rows = own.where("lang is not null and text is not null and fold <> 0").drop("fold")
    counts = rows.groupBy("lang").count().collect()  # one row per language
    if not counts:
        return fit(Packed([]), [])
    most = bound(TRAIN, LEAST_TRAIN, len(counts))
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, most / r["count"])) for r in counts], "lang string, rate double")
    place = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(rates), "lang").where(place < F.col("rate")).select("doc_id", "lang", "text").mapInArrow(_features, "doc_id long, lang string, bits binary").collect()
    sample.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.lang, bytes(r.bits)))
    return fit(Packed([bytes(r.bits) for r in sample]), [r.lang for r in sample])


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: tuple | None = None) -> DataFrame:
    """Adds held_out, lang_pred and score to all columns of docs but those of these names in any case; one row per row, no shuffle.

    Null texts and texts without a letter are `und` with score 0, as is every text where nothing was
    learnt. Otherwise the score is 0.5 (a tie, which goes to the first name in order) to 1. Null doc_ids are not held out; null languages
    aren't learnt from. Repeated rows are kept. Very long texts are taken whole, in equal parts. Names of further columns may hold dots or differ in case only. An empty table gives no rows.
    lang, source and doc_id aren't read for a prediction.
    """
    spark = prepared(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model or train(docs, doc_id, text, lang))  # DIM floats a language
    kept = [c for c in docs.columns if c.lower() not in ("held_out", "lang_pred", "score")]
    base = docs.select(*map(quoted, kept), F.coalesce(fold(doc_id) == 0, F.lit(False)).alias("held_out"))
    at = base.columns.index(text)

    def judged(batch: pa.RecordBatch) -> list[pa.Array]:
        found = list(scores(batch.column(at).to_pylist(), *shared.value))
        return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

    return widened(base, judged, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
