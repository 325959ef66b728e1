"""SentencePiece encoding and decoding by a table of distinct marked words (see encoders.PieceBpe)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylespark.llm.common import prepared
from stylespark.llm.encoders import piece_bpe

END_ID = 2
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _ended(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """For runs of texts: all ids with each text's end id, the edges of each text's ids, and the decoded texts."""
    tool = piece_bpe()
    for a, b, ids, edges in tool.encoded(texts):
        ids = np.insert(ids.astype(np.int32), edges[1:], END_ID)
        edges = edges + np.arange(b - a + 1)
        yield ids, edges, [tool.model.decode(ids[lo : hi - 1]) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


@cache
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of the numbers below n, a space after them, as rows of bytes; and which bytes count."""
    table = np.array([f"{i} " for i in range(n)], "S").view(np.uint8).reshape(n, -1)
    return table, table > 0


def decimals(ids: np.ndarray, edges: np.ndarray, n: int) -> Iterator[memoryview]:
    """For each run of ids between edges: their decimals joined by one space."""
    table, used = _decimals(n)
    here = used[ids]
    ends = np.concatenate(([0], np.cumsum(here.sum(1, dtype=np.int64))))[edges]
    text = memoryview(table[ids][here])
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        yield text[lo : hi - 1]


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for ids, edges, back in _ended(batch.column(1).to_pylist()):
            n = len(back)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids)), pa.array(back, pa.string())], names=["doc_id", "ids", "decoded"])
            at += n


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, own, back = [], [], []
        for ids, edges, texts in _ended(batch.column(1).to_pylist()):
            n += np.diff(edges).tolist()
            own += [hashlib.sha256(d).hexdigest() for d in decimals(ids, edges, len(piece_bpe().model))]
            back += [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _columns(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    prepared(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def piece_encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (the end id last), decoded. One row per row, in place: no shuffle.

    Null or empty texts are the end id alone and decode to the empty text. Repeated rows, null ids and
    very long texts are kept; further columns are ignored.
    """
    return _columns(docs, doc_id, text).mapInArrow(_encoded, "doc_id long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As piece_encode(), but digests of the ids and of the decoded text."""
    return _columns(docs, doc_id, text).mapInArrow(_digests, DIGEST)
