"""The rate limit on live streams against the batch form, with a restart, late requests and forgotten keys."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from stylespark.streaming.limits import limited, limited_stream, state_store

SCHEMA = "k string, t long, i long"


def ran(spark, where, window_ms, most, delay="0 seconds"):
    """Everything that lies in the folder now, one file a micro-batch; from the checkpoint on."""
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    with state_store(spark):
        query = limited_stream(source, "k", "t", "i", window_ms, most, delay).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{where}/out").collect(), query.lastProgress


def put(spark, where, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{where}/in")


def test_stream_with_a_restart_equals_the_batch_form(spark, tmp_path):
    where = f"file://{tmp_path}"
    rng = np.random.default_rng(4)
    times = np.cumsum(rng.choice([0, 3, 40, 400, 1500], 600))
    rows = [("busy" if rng.random() < 0.4 else f"k{rng.integers(0, 8)}" if rng.random() < 0.95 else None, int(t), k) for k, t in enumerate(times)]
    parts = [rows[a : a + 150] for a in range(0, 600, 150)]
    for part in parts[:2]:
        put(spark, where, part)
    half, _ = ran(spark, where, 1000, 3)
    assert Counter(r.limited for r in half) and len(half) == 300
    for part in parts[2:]:
        put(spark, where, part)
    got, progress = ran(spark, where, 1000, 3)
    want = limited(spark.createDataFrame(rows, SCHEMA).withColumn("k", F.coalesce("k", F.lit(""))), "k", "t", "i", 1000, 3).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and any(r.limited for r in got)
    assert progress["stateOperators"][0]["numRowsTotal"] < 60  # windows that are over are forgotten


def test_late_requests(spark, tmp_path):
    where = f"file://{tmp_path}"
    put(spark, where, [("a", 10_000, 0), ("a", 10_500, 1), ("b", 30_000, 2)])
    ran(spark, where, 1000, 1, "10 seconds")
    put(spark, where, [("c", 30_100, 3)])  # the watermark is 20,000 from here on
    put(spark, where, [("b", 29_900, 4), ("a", 19_000, 5), ("b", 31_000, 6)])
    got, _ = ran(spark, where, 1000, 1, "10 seconds")
    assert {r.tie: r.limited for r in got} == {0: False, 1: True, 2: False, 3: False, 4: True, 6: False}  # 5 is late
