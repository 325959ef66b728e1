"""Retrieval: nearest neighbours on two axes, fused by weighted reciprocal ranks, or the most recent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stylespark.functions.vectors import cosine_distance

# Fixed values.
RRF_K, POOL, DEFAULT_K, WEIGHTS = 60, 4, 5, {"style": 2.0, "content": 1.0}
REGISTERS = ("chat", "email", "longform")


def checked_register(register: str) -> str:
    if register not in REGISTERS:
        raise ValueError(f"unknown register: {register}")
    return register


def nearest(rows: DataFrame, vector: str, seed: list[float], k: int, key: str = "id") -> DataFrame:
    """The k rows nearest to the seed by cosine distance, ties by key; exact, without a full sort."""
    point = F.array(*[F.lit(float(x)) for x in seed])
    return rows.where(F.col(vector).isNotNull()).withColumn("distance", cosine_distance(F.col(vector), point)).orderBy("distance", key).limit(k)


def ranked(rows: DataFrame, name: str, weight: float, key: str = "id") -> DataFrame:
    """(list, key, rank, weight) of rows that have a distance. For a pool of a few rows."""
    return rows.select(F.lit(name).alias("list"), key, F.row_number().over(Window.orderBy("distance", key)).alias("rank"), F.lit(weight).alias("weight"))


def fuse(lists: DataFrame, key: str = "id", rrf_k: int = RRF_K) -> DataFrame:
    """key, score: the sum of weight / (rrf_k + rank) over lists; best first, ties by key."""
    return lists.groupBy(key).agg(F.sum(F.col("weight") / (F.col("rank") + rrf_k)).alias("score")).orderBy(F.desc("score"), key)


def recent(rows: DataFrame, k: int = DEFAULT_K, at: str = "authored_at", key: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(at), key).limit(k)


def recent_per(rows: DataFrame, keys: list[str], k: int, at: str = "authored_at", key: str = "id") -> DataFrame:
    """The k most recent rows of each group; groups are cut before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), key))).where(F.col("_n") <= k).drop("_n")


def retrieve(exemplars: DataFrame, register: str, k: int = DEFAULT_K, style: list[float] | None = None, content: list[float] | None = None, author: str | None = None) -> DataFrame:
    """The k best canonical exemplars of a register, with their fused score; the most recent ones without a seed."""
    rows = exemplars.where((F.col("register") == checked_register(register)) & F.col("is_canonical"))
    rows = rows.where(F.col("author_id") == author) if author is not None else rows
    seeds = [(n, v) for n, v in (("style", style), ("content", content)) if v is not None]
    if not seeds:
        return recent(rows, k)
    pools = [ranked(nearest(rows, f"{n}_embedding", v, max(POOL * k, k)), n, WEIGHTS[n]) for n, v in seeds]
    lists = pools[0] if len(pools) == 1 else pools[0].unionByName(pools[1])
    best = fuse(lists).limit(k)
    return rows.join(F.broadcast(best), "id").orderBy(F.desc("score"), "id")  # best has k rows


def mean_vector(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, centroid: element-wise mean over rows that have a vector; ragged vectors fail."""
    own = rows.where(F.col(vector).isNotNull())
    each = own.select(*keys, F.size(vector).alias("_dim"), F.posexplode(vector).alias("pos", "v"))
    means = each.groupBy(*keys, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"), F.min("_dim").alias("lo"), F.max("_dim").alias("hi"))
    flat = means.groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("a"))  # one entry per dimension
    centroid = F.transform("a", lambda x: x["m"])
    return flat.select(*keys, F.when(F.col("lo") == F.col("hi"), centroid).otherwise(F.raise_error(F.lit("ragged vectors")).cast("array<double>")).alias("centroid"))
