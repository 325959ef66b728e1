"""Corpus files as a data source: JSON arrays of texts, a partition a file, read as a stream.

    spark.dataSource.register(CorpusFiles)
    spark.read.format("stylespark_corpus").load("file:///corpus")

A file's rows are decoded one after another from a window of its text, so memory is bounded by its largest row, however long the array. The
first bad row fails the read, with the file, the row's number and what is wrong.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "medium string, source_uri string, timestamp string, text string"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
MEDIA = ("slack", "claude")
#: Characters that are read at a time, and the most that one row may have; rows of a batch.
WINDOW, MOST_ROW, BATCH = 1 << 20, 1 << 28, 1000

_time = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z").fullmatch
_space = re.compile(r"[ \t\n\r]*").match


class BadRow(ValueError):
    """A file that isn't a corpus: where and why."""


def checked(row: object) -> tuple[str, ...]:
    """The row's fields; raises ValueError with what is wrong."""
    if not isinstance(row, dict):
        raise ValueError("not an object")
    for name in FIELDS:
        if not isinstance(row.get(name), str):
            raise ValueError(f"{name}: a string is needed")
        if not row[name]:
            raise ValueError(f"{name}: empty")
    if row["medium"] not in MEDIA:
        raise ValueError(f"medium: one of {', '.join(MEDIA)} is needed")
    try:
        if not _time(row["timestamp"]):
            raise ValueError
        datetime.fromisoformat(row["timestamp"][:19])
    except ValueError:
        raise ValueError("timestamp: an ISO-8601 time in UTC is needed") from None
    return tuple(row[name] for name in FIELDS)


def array_items(stream, window: int = WINDOW, most: int = MOST_ROW) -> Iterator[object]:
    """The items of a JSON array, from a binary stream; raises ValueError where it isn't one. Holds one item and a window of text."""
    decode, decoder = codecs.getincrementaldecoder("utf-8")().decode, json.JSONDecoder()
    text, at, ended = "", 0, False

    def more() -> bool:
        nonlocal text, at, ended
        if ended:
            return False
        data = stream.read(max(window, len(text) - at))  # twice as much each time for a long row
        ended = not data
        text, at = text[at:] + decode(data, ended), 0
        return True

    def mark() -> str:
        nonlocal at
        while True:
            at = _space(text, at).end()
            if at < len(text):
                return text[at]
            if not more():
                return ""

    if mark() != "[":
        raise ValueError("not an array")
    at += 1
    first = True
    while True:
        got = mark()
        if got == "]" and first:
            at += 1
            break
        while True:
            try:
                item, end = decoder.raw_decode(text, at)
                if end < len(text) or ended:  # a number at the end of the window may go on
                    break
            except ValueError:
                if ended or len(text) - at > most:
                    raise ValueError("invalid JSON") from None
            if not more():
                break
        at, first = end, False
        yield item
        got = mark()
        if got not in (",", "]"):
            raise ValueError("invalid JSON after it")
        at += 1
        if got == "]":
            break
    if mark():
        raise ValueError("text after the array")


def rows_of(name: str, stream, window: int = WINDOW, most: int = MOST_ROW) -> Iterator[tuple[str, ...]]:
    """The checked rows of one file."""
    n, items = 0, array_items(stream, window, most)
    while True:
        try:
            item = next(items)
            yield checked(item)
        except StopIteration:
            return
        except ValueError as e:
            raise BadRow(f"{name}: row {n}: {e}") from None
        n += 1


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class CorpusReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        fs, at = _at(self.path)
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type != pafs.FileType.Directory:
            return [InputPartition(at)]
        return [InputPartition(f.path) for f in sorted(fs.get_file_info(pafs.FileSelector(at, recursive=True)), key=lambda f: f.path) if f.type == pafs.FileType.File and f.path.endswith(".json")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:  # a folder without files
            return
        fs, _ = _at(self.path)
        with fs.open_input_stream(partition.value, compression=None) as stream:
            batch: list[tuple] = []
            for row in rows_of(partition.value, stream):
                batch.append(row)
                if len(batch) == BATCH:
                    yield _batch(batch)
                    batch = []
            if batch:
                yield _batch(batch)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=FIELDS)


class CorpusFiles(DataSource):
    """A JSON file, or the .json files below a folder."""

    @classmethod
    def name(cls) -> str:
        return "stylespark_corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CorpusReader:
        return CorpusReader(self.options["path"])
