"""What every operator needs of its session: this package on the workers, a shared folder, and joins that hot keys don't hold up."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that are looked up by broadcast: at most this many can hold more than 1 / MOST_HOT of all rows, or more than COLD rows.
MOST_HOT, COLD = 100_000, 1000
#: Characters of a plan that the driver keeps: iterations make many and long ones.
PLAN_CHARS = 20_000
#: Setting by which a query's shuffle files are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add this package to the session's Python files, once per application, and keep plans short in the driver's history of queries."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_CHARS))
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        top = Path(__file__).resolve().parent
        if top.is_dir():
            folder = os.path.realpath(tempfile.mkdtemp(prefix="stylespark-"))  # the driver serves it until the application ends
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            name = f"{folder}/{top.name}.zip"
            with zipfile.ZipFile(name, "w") as out:
                for p in sorted(top.rglob("*.py")):
                    out.write(p, p.relative_to(top.parent))
            context.addPyFile(name)
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, below a temporary folder in local mode, else beside the warehouse's tables."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("stylespark.shared.dir", None)
    if not root:
        if conf.get("spark.master", "local").startswith("local[") or conf.get("spark.master", "local") == "local":
            folder = tempfile.mkdtemp(prefix="stylespark-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            root = f"file://{folder}"
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("stylespark.shared.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage and survives lost executors. Deleted when the application ends, if not released before.

    Its shuffle files go as soon as it is written, not when the driver happens to collect its garbage."""
    path, conf = shared_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    if before != "true":
        conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if before != "true":
            conf.set(CLEANUP, before)
    _file_system(df.sparkSession, path).deleteOnExit(df.sparkSession._jvm.org.apache.hadoop.fs.Path(path))
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.settled_at = path
    return back


def release(df: DataFrame) -> None:
    """Delete what settled() wrote for df, once nothing will read it again."""
    files, path = _file_system(df.sparkSession, df.settled_at), df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_at)
    files.delete(path, True)
    files.cancelDeleteOnExit(path)


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def looked_up(rows: DataFrame, key: str, table: DataFrame, total: int | None = None, most: int | None = None) -> DataFrame:
    """rows left-joined with table on key. table: key (each once), many (how many rows have it, one at least) and values.

    No task gets a hot key's rows: keys of more rows than COLD and than total / most are joined by broadcast, of
    which there are at most `most` (MOST_HOT; fewer where values are large); all others by shuffling. Rows without a key go
    round both. Of `most` rows or fewer the whole table, which can't have more, is broadcast. total: the number of rows, counted if not given."""
    total, most = rows.count() if total is None else total, most or MOST_HOT
    values = [c for c in table.columns if c not in (key, "many")]
    out = [*rows.columns, *values]
    if total <= most:
        return rows.join(F.broadcast(table.drop("many")), key, "left").select(*out)
    least = max(COLD, total // most)
    hot = table.where(F.col("many") > least).select(key, F.struct(*values).alias("_hot"))
    first = rows.join(F.broadcast(hot), key, "left")
    by_hot = first.where("_hot is not null").select(*rows.columns, *[F.col(f"_hot.{v}").alias(v) for v in values])
    cold = first.where(F.col("_hot").isNull() & F.col(key).isNotNull()).select(*rows.columns).join(table.where(F.col("many") <= least).drop("many"), key, "left").select(*out)
    types = dict(table.dtypes)
    none = rows.where(F.col(key).isNull()).select(*rows.columns, *[F.lit(None).cast(types[v]).alias(v) for v in values])
    return by_hot.unionByName(cold).unionByName(none)


def with_text(df: DataFrame, name: str, inputs: list[str], function, kind: str = "string") -> DataFrame:
    """df with a column (text, unless its kind is given) computed row by row on Arrow batches: function(*values).

    A step of its own in the plan, so that later expressions may use the column inside lambdas."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    base = ship(df.sparkSession) and df.drop(name)
    at = [base.columns.index(c) for c in inputs]
    field = T.StructType.fromDDL(f"value {kind}")[0].dataType
    arrow = to_arrow_type(field)

    def run(batches):
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in at]
            new = pa.array([function(*row) for row in zip(*columns, strict=True)], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=[*batch.schema.names, name])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(name, field)]))
