"""Rate limits over fixed windows that are anchored at a request, as a fold over each key's requests in time order."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stylespark.runtime import looked_up, ship

# Fixed values.
MOST, WINDOW_MS = 120, 60_000


def is_limited(state: tuple[int, int] | None, now: int, window_ms: int = WINDOW_MS, most: int = MOST) -> tuple[tuple[int, int], bool]:
    """The window (start, count) after a request, and whether the request is over the limit."""
    start, count = state if state is not None and now - state[0] < window_ms else (now, 0)
    return (start, count + 1), count + 1 > most


def _chains(rows: DataFrame, window_ms: int) -> DataFrame:
    """slot (key and window-long slice of time), many, chain: slices of a key without an empty slice between them.

    Two requests with an empty slice between them are over a window apart, so the later one always starts anew."""
    slots = rows.groupBy("slot").agg(F.count("*").alias("many"))
    by = Window.partitionBy("slot.key").orderBy("slot.at")
    new = (F.col("slot.at") - F.lag("slot.at").over(by)).isNull() | (F.col("slot.at") - F.lag("slot.at").over(by) > 1)
    return slots.withColumn("new", new.cast("int")).withColumn("chain", F.sum("new").over(by)).drop("new")


def limited(requests: DataFrame, key: str, at_ms: str, tie: str, window_ms: int = WINDOW_MS, most: int = MOST) -> DataFrame:
    """key, at, tie, limited: every request with the window's verdict.

    A key's requests are cut where a pause makes the window begin anew, so that a hot key's chains go to several tasks.
    Each chain is sorted on disk where it is long and folded as a stream: a task keeps one window at a time."""
    ship(requests.sparkSession)
    rows = requests.select(F.col(key).cast("string").alias("key"), F.col(at_ms).cast("long").alias("at"), F.col(tie).cast("long").alias("tie"))
    rows = rows.withColumn("slot", F.struct(F.coalesce("key", F.lit("")).alias("key"), F.floor(F.col("at") / F.lit(window_ms)).alias("at")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            out = []
            for k, now, chain in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "chain")), strict=True):
                if (k, chain) != last:
                    last, state = (k, chain), None
                state, over = is_limited(state, now, window_ms, most)
                out.append(over)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.bool_())], names=["key", "at", "tie", "limited"])

    chained = looked_up(rows, "slot", _chains(rows, window_ms)).select("key", "at", "tie", "chain")
    return chained.repartition("key", "chain").sortWithinPartitions("key", "chain", "at", "tie").mapInArrow(run, "key string, at long, tie long, limited boolean")


class KeyWindow(StatefulProcessor):
    """A key's window as value state, and a timer that forgets it once no request that may still come can fall into it."""

    def __init__(self, window_ms: int = WINDOW_MS, most: int = MOST) -> None:
        self.window_ms, self.most = window_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", T.StructType([T.StructField(n, T.LongType()) for n in ("start", "count")]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        state = tuple(self.window.get()) if self.window.exists() else None
        before = state
        for r in sorted(rows, key=lambda r: (r.at, r.tie)):  # a micro-batch's requests of a key
            state, over = is_limited(state, r.at, self.window_ms, self.most)
            yield Row(key=key[0], at=r.at, tie=r.tie, limited=over)
        if before is not None and before[0] != state[0]:
            self.handle.deleteTimer(before[0] + self.window_ms)
        if before is None or before[0] != state[0]:
            self.handle.registerTimer(state[0] + self.window_ms)
        self.window.update(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        # A request from here on is at the watermark or behind it, so its window would begin anew.
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession):
    """The state store that value state and timers need, for queries that are started inside."""
    name, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, own)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def limited_stream(requests: DataFrame, key: str, at_ms: str, tie: str, window_ms: int = WINDOW_MS, most: int = MOST, delay: str = "0 seconds") -> DataFrame:
    """key, at, tie, limited of a stream of requests: each has its verdict with the micro-batch that it comes in. Start the query inside state_store().

    Requests of a micro-batch are taken in order of time; one that comes in a later micro-batch than a younger one of its key counts in the window that is open
    then. A request that is behind the watermark, `delay` behind the youngest request of all earlier micro-batches, is late: it gets no verdict and counts in no window.
    Null keys are the key "". State is one window a key, and only of keys with a request less than a window and the delay ago; a restart goes
    on from the checkpoint. Where requests come in order of time, the rows equal those of limited()."""
    ship(requests.sparkSession)
    rows = requests.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(at_ms).cast("long").alias("at"), F.col(tie).cast("long").alias("tie"))
    timed = rows.withColumn("time", F.timestamp_millis("at").cast("timestamp")).withWatermark("time", delay)
    return timed.groupBy("key").transformWithState(KeyWindow(window_ms, most), "key string, at long, tie long, limited boolean", "append", "eventTime")
