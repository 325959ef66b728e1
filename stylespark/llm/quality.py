"""Quality classifier by co-training.

Two views of a document: its text (byte frequencies, shares of capitals, marks, repeats, n-gram variety) and its
page metadata (source, language, length). A logistic regression for each view starts from the labelled
rows; in each round either view labels the unlabelled documents that it is surest of and hands them to
the other. Both are calibrated on labelled rows kept aside and combined by adding their log odds.

Fitting takes bounded samples (LABELLED and POOL rows); scoring takes every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stylespark.llm.common import prepared, quoted, slices, widened

#: Bounds of the samples to fit on.
LABELLED, POOL = 12_000, 8_000
ROUNDS, CONFIDENT, SURE = 4, 200, 0.95
#: Of good labelled rows kept aside, at most this share may be rejected.
FALSE_REJECTION = 0.005
SOURCES, LANGS = 64, 16
CLASSES = 128
#: Rows that fitting widens at a time.
ROWS = 2048
TEXT_DIM, META_DIM = 256 + 10, SOURCES + LANGS + 8


def text_features(texts: list[str | None]) -> np.ndarray:
    """(texts, TEXT_DIM): byte frequencies and ten shares; whole texts."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    out = np.zeros((len(raw), TEXT_DIM), np.float32)
    for a, b in slices([len(r) for r in raw], 1 << 21):
        sizes = np.array([len(r) for r in raw[a:b]])
        data = np.frombuffer(b"".join(raw[a:b]), np.uint8)
        rows = np.repeat(np.arange(b - a), sizes)
        hist = np.bincount(rows * 256 + data, minlength=(b - a) * 256).reshape(-1, 256).astype(np.float64)
        n = np.maximum(1, sizes)
        out[a:b, :256] = np.sqrt(hist / n[:, None])
        upper, lower, digit = hist[:, 65:91].sum(1), hist[:, 97:123].sum(1), hist[:, 48:58].sum(1)
        space, line, high = hist[:, 32] + hist[:, 9:14].sum(1), hist[:, 10], hist[:, 128:].sum(1)
        marks = n - upper - lower - digit - space - high
        for i, r in enumerate(raw[a:b]):
            own = r.split()
            out[a + i, 256:] = (
                np.log1p(sizes[i]) / 10, upper[i] / n[i], marks[i] / n[i], digit[i] / n[i], space[i] / n[i], np.log1p(line[i]) / 5,
                len(set(own)) / max(1, len(own)), len(set(zip(own, own[1:], strict=False))) / max(1, len(own) - 1),
                sum(x == y for x, y in zip(own, own[1:], strict=False)) / max(1, len(own) - 1), n[i] / max(1, len(own)) / 20,
            )
    return out


def meta_features(sources: list, langs: list, lengths: list) -> np.ndarray:
    """(rows, META_DIM): hashed source and language, and length as steps. Nulls are a value of their own."""
    out = np.zeros((len(sources), META_DIM), np.float32)
    for i, (s, v, n) in enumerate(zip(sources, langs, lengths, strict=True)):
        out[i, zlib.crc32(repr(s).encode()) % SOURCES] = 1
        out[i, SOURCES + zlib.crc32(repr(v).encode()) % LANGS] = 1
        out[i, SOURCES + LANGS + min(7, max(0, (n or 0).bit_length() // 2 - 2))] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 15) -> np.ndarray:
    """Weights with the intercept last, by Newton's method; classes weigh alike. Rows are widened to float64 a block at a time."""
    share = np.array([weight[y == c].sum() for c in (0, 1)])
    weight = weight * np.where(y == 1, 0.5 / share[1], 0.5 / share[0]) * len(y)
    w, penalty = np.zeros(x.shape[1] + 1), np.full(x.shape[1] + 1, ridge * len(y) / 100)
    penalty[-1] = 1e-6
    for _ in range(steps):
        gradient, hessian = penalty * w, np.diag(penalty)
        for a in range(0, len(y), ROWS):
            own, k = np.hstack([x[a : a + ROWS].astype(np.float64), np.ones((len(x[a : a + ROWS]), 1))]), weight[a : a + ROWS]
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            gradient += own.T @ (k * (p - y[a : a + ROWS]))
            hessian += (own * (k * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ own
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


class Model:
    """views: weights; calibration: (slope, offset) of each view's log odds; prior: log odds of a good document; cut: reject below."""

    def __init__(self, views: list[np.ndarray], calibration: list[tuple[float, float]], prior: float, cut: float, rounds: list[int]) -> None:
        self.views, self.calibration, self.prior, self.cut, self.rounds = views, calibration, prior, cut, rounds

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        odds = self.prior + sum(a * logit(x, w) + b - self.prior for x, w, (a, b) in zip((text, meta), self.views, self.calibration, strict=True))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def platt(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make the log odds probabilities on rows kept aside; prior smoothing keeps them finite."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([odds, np.ones_like(odds)], 1)
    w = np.array([1.0, 0.0])
    loss = lambda v: float(np.sum(np.logaddexp(0, x @ v) - target * (x @ v)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + 1e-9 * np.eye(2)
        gradient = x.T @ (p - target)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-9 and loss(w - size * step) > loss(w) - 1e-4 * size * float(gradient @ step):  # a whole step may leap over the minimum
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return max(0.0, float(w[0])), float(w[1]) if w[0] > 0 else float(np.log((good + 1) / (bad + 1)))


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, aside: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray) -> Model | None:
    """Fit on labelled rows and an unlabelled pool; rows in aside calibrate. None unless both classes are on both sides."""
    if len({*y[~aside]}) < 2 or len({*y[aside]}) < 2:
        return None
    own, pool = [text, meta], [pool_text, pool_meta]
    x = [v[~aside] for v in own]
    labels = [y[~aside].astype(float)] * 2
    taken = [np.zeros(len(pool_text), bool) for _ in own]
    rounds = []
    for turn in range(ROUNDS + 1):
        views = [logistic(x[k], labels[k], np.ones(len(labels[k]))) for k in (0, 1)]
        if turn == ROUNDS:
            break
        given = 0
        for k in (0, 1):  # view k teaches the other one
            a, b = platt(logit(own[k][aside], views[k]), y[aside])
            p = 1 / (1 + np.exp(-(a * logit(pool[k], views[k]) + b)))
            free = ~taken[1 - k]
            for c, sure in ((1, p), (0, 1 - p)):
                pick = np.flatnonzero(free & (sure >= SURE))
                pick = pick[np.argsort(-sure[pick], kind="stable")][:CONFIDENT]
                x[1 - k] = np.vstack([x[1 - k], pool[1 - k][pick]])
                labels[1 - k] = np.concatenate([labels[1 - k], np.full(len(pick), float(c))])
                taken[1 - k][pick] = True
                given += len(pick)
        rounds.append(given)
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    model = Model(views, [platt(logit(v[aside], w), y[aside]) for v, w in zip(own, views, strict=True)], prior, 0.0, rounds)
    good = np.sort(model.score(text[aside], meta[aside])[y[aside] == 1])
    model.cut = float(min(0.5, good[int(FALSE_REJECTION * len(good))]))
    return model


COLUMNS = ["source", "lang", "n_chars"]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = [batch.column(k).to_pylist() for k in range(6)]
        text, meta = text_features(c[2]), meta_features(c[3], c[4], c[5])
        both = [np.concatenate(r).astype("<f4").tobytes() for r in zip(text, meta, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.binary())], names=["doc_id", "quality", "x"])


def _narrow(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, text and the metadata, null where a column is missing."""
    have = {c: t for c, t in docs.dtypes}
    pick = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    return docs.select(F.col("doc_id").cast("long"), F.col(quoted(text)).cast("string").alias("text"), pick("source", "string"), pick("lang", "string"), pick("n_chars", "long"))


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model | None:
    """Co-train on about LABELLED labelled and POOL unlabelled documents, chosen by a hash of doc_id."""
    rows = _narrow(docs, text)
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    n_known, n_docs = known.count(), docs.count()
    chosen = known.where(place < min(1.0, LABELLED / max(1, n_known)))
    pool = rows.select("doc_id").where(place < min(1.0, POOL / max(1, n_docs))).distinct().join(known, "doc_id", "left_anti").select("doc_id", F.lit(None).cast("int").alias("quality"))
    # At most LABELLED + POOL ids and a few standard deviations more, so their size is bounded.
    named = rows.join(F.broadcast(chosen.unionByName(pool)), "doc_id")
    # One row of a repeated doc_id, so that rows are bounded too: that of the least hash.
    one = F.struct("quality", "text", "source", "lang", "n_chars")
    sample = named.groupBy("doc_id").agg(F.min_by(one, F.xxhash64("text", "source", "lang", "n_chars")).alias("r")).select("doc_id", "r.*")
    got = sample.select("doc_id", "quality", "text", "source", "lang", "n_chars").mapInArrow(_sampled, "doc_id long, quality int, x binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    x = np.stack([np.frombuffer(r.x, "<f4") for r in got])
    y = np.array([-1 if r.quality is None else r.quality for r in got])
    aside = np.array([zlib.crc32(str(r.doc_id).encode()) % 4 == 0 for r in got])
    del got
    has = y >= 0
    return co_train(x[has, :TEXT_DIM], x[has, TEXT_DIM:], y[has], aside[has], x[~has, :TEXT_DIM], x[~has, TEXT_DIM:])


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """Adds quality_score (0 to 1) and kept to all columns of docs but those of these names in any case; one row per row, no shuffle of texts.

    Without labels of both classes every document has score 1 and is kept. Null texts count as empty, nulls in
    source, lang and n_chars as values of their own, missing columns as null. Repeated rows are kept; a
    doc_id with both labels counts as bad. A score at the cutoff is kept. Very long texts are taken whole; an empty table gives no rows.
    """
    spark = prepared(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model or train(docs, labels, text))
    kept = [c for c in docs.columns if c.lower() not in ("quality_score", "kept")]
    base = docs.select(*map(quoted, kept))
    at = {c: base.columns.index(c) for c in [text, *COLUMNS] if c in base.columns}

    def judged(batch: pa.RecordBatch) -> list[pa.Array]:
        n, fitted = batch.num_rows, shared.value
        if fitted is None:
            score, cut = np.ones(n), 0.0
        else:
            source, lang, chars = (batch.column(at[c]).to_pylist() if c in at else [None] * n for c in COLUMNS)
            score, cut = fitted.score(text_features(batch.column(at[text]).to_pylist()), meta_features(source, lang, chars)), fitted.cut
        return [pa.array(score), pa.array(score >= cut)]

    return widened(base, judged, [T.StructField("quality_score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
