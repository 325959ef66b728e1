"""Running sums and ranks over any number of rows in order, also of a single group.

Rows are dealt to tasks by ranges of (group, order); each task sums its own rows, and what the tasks before it hold of the same group
is added from a table of one row per task and group. So one group spreads over all tasks, and no window runs over all of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stylespark.runtime import settled


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """rows with, for each (name, column) of sums, the sum of the column over the rows of its group that stand before it in order.

    (keys, order) must be unique: rows that tie would meet in one task, so aggregate them first. Nulls come first and are a value of their own;
    empty tables stay empty. parts: tasks, spark.sql.shuffle.partitions if not given."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(rows.repartitionByRange(parts, *keys, *order).withColumn("_rank_part", F.spark_partition_id()), "ranges")
    held = dealt.groupBy("_rank_part", *keys).agg(*[F.sum(c).alias(f"_rank_own_{name}") for name, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_rank_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task and group
    before = held.select(F.col("_rank_part").alias("_rank_at"), *[F.col(k).alias(f"_rank_key{i}") for i, k in enumerate(keys)], *[F.coalesce(F.sum(f"_rank_own_{name}").over(earlier), F.lit(0)).alias(f"_rank_before_{name}") for name in sums])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_rank_key{i}")) for i, k in enumerate(keys)], F.col("_rank_part") == F.col("_rank_at"))
    inside = Window.partitionBy("_rank_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_rank_inside_{name}") for name, c in sums.items()])
    return local.join(before, same).select(*rows.columns, *[(F.col(f"_rank_before_{name}") + F.col(f"_rank_inside_{name}")).alias(name) for name in sums])
