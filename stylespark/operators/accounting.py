"""Volume and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
READY_WORDS, PROFILE_WORDS, PROFILE_SAMPLES, PROFILE_EXEMPLARS = 1000, 100_000, 100, 50


def account_volume(records: DataFrame) -> DataFrame:
    """Words and samples of canonical records per author and register, and their tier."""
    own = records.where("is_canonical").groupBy("author_id", "register").agg(F.sum("word_count").cast("long").alias("word_count"), F.count("*").alias("sample_count"))
    tier = F.when((F.col("word_count") >= PROFILE_WORDS) | (F.col("sample_count") >= PROFILE_SAMPLES), "profile-grade").when(F.col("word_count") >= READY_WORDS, "generation-ready").otherwise("insufficient")
    return own.withColumn("tier", tier).orderBy("author_id", "register")


def readiness(exemplars: Column) -> Column:
    return F.when(exemplars >= PROFILE_EXEMPLARS, "profile-grade").otherwise("generation-ready")


def coverage(exemplars: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), exemplars / F.lit(float(PROFILE_EXEMPLARS))))
