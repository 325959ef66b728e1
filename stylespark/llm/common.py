"""Settings and small helpers for the operators of this subpackage."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stylespark.runtime import looked_up, release, ship
from stylespark.runtime import settled as written
from stylespark.runtime import shared_path as shared_dir

__all__ = ["documents", "looked_up", "opened", "prepared", "quoted", "release", "shared_dir", "slices", "tokenizer_path", "widened", "written"]

#: Rows of an Arrow batch to a Python worker: a batch of long documents must fit a small executor.
ARROW_ROWS = 1000
#: Bytes of one, but for a single longer row.
ARROW_BYTES = 16 << 20
#: Characters that a worker splits into words at a time.
SLICE_CHARS = 2_000_000


def prepared(spark: SparkSession) -> SparkSession:
    """Hold Arrow batches to ARROW_ROWS rows and ARROW_BYTES bytes (larger settings of the session are lowered) and ship this package to the workers."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if now is None or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))
    return ship(spark)


def opened(path: str, mode: str):
    """A file of the shared folder, by any file system that pyarrow knows."""
    fs, at = pafs.FileSystem.from_uri(path)
    if mode == "w":
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        return fs.open_output_stream(at, compression=None)
    return fs.open_input_file(at)


def slices(sizes: list[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of neighbours [a, b) whose sizes sum to at most limit, or one row."""
    a = total = 0
    for b, n in enumerate(sizes):
        if b > a and total + n > limit:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def quoted(name: str) -> str:
    """A column's name that may hold dots."""
    return "`" + name.replace("`", "``") + "`"


def widened(docs: DataFrame, function: Callable[[pa.RecordBatch], list[pa.Array]], added: list[T.StructField]) -> DataFrame:
    """docs with further columns that function gives for each of its batches. Columns have plain names meanwhile, so those of docs may hold dots or differ in case only."""
    plain = [f"c{k}" for k in range(len(docs.columns) + len(added))]
    fields = [T.StructField(n, f.dataType) for n, f in zip(plain, [*docs.schema.fields, *added], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *function(batch)], names=plain)

    return docs.toDF(*plain[: len(docs.columns)]).mapInArrow(run, T.StructType(fields)).toDF(*docs.columns, *[f.name for f in added])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file lies; STYLESPARK_TOKENIZERS names another folder."""
    if folder := os.environ.get("STYLESPARK_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
