"""Verdicts: where a score stands among a profile's scores, and what that means at a strictness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylespark.operators.ranks import running
from stylespark.runtime import looked_up, settled

# Fixed values.
THRESHOLD = {"lenient": 0.25, "normal": 0.40, "strict": 0.60}
BAND, LEAST_WORDS, LEAST_WORDS_B = 0.10, 20, 250
GATE_B_PROB = {"high": 0.85, "low": 0.4, "none": 0.0}


def strictness_of(name: Column) -> Column:
    return F.when(name.isNull() | (name == "standard"), F.lit("normal")).otherwise(name)


def percentiles(candidates: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """candidates with percentile: the share of a group's scores at or below theirs; 0 for a group without scores.

    Both sides are counted by distinct score and ranked in one order that is dealt to tasks by ranges. Candidates of one score meet
    its rank by a lookup that keeps hot scores out of the shuffle; no candidate meets every score."""
    given = [f"_k{i}" for i in range(len(keys))]
    by = F.struct(*[F.col(k).alias(g) for k, g in zip(keys, given, strict=True)], F.col("score").alias("_score"))
    own = settled(candidates.withColumn("_at", F.when(F.col("score").isNotNull(), by)), "candidates")
    rows = own.select("_at", F.lit(1).cast("long").alias("c"), F.lit(0).cast("long").alias("n"))
    counted = rows.unionByName(scores.select(by.alias("_at"), F.lit(0).cast("long").alias("c"), F.lit(1).cast("long").alias("n")))
    each = counted.where("_at is not null").groupBy("_at").agg(F.sum("c").alias("many"), F.sum("n").alias("n")).select("_at.*", "many", "n")
    total = scores.groupBy(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("total"))
    same = [F.col(g).eqNullSafe(F.col(f"_t{i}")) for i, g in enumerate(given)]
    ranked = running(each, given, ["_score"], {"before": "n"}).join(total, same or F.lit(True)).where("many > 0")  # without keys, one row
    table = ranked.select(F.struct(*given, "_score").alias("_at"), "many", ((F.col("before") + F.col("n")) / F.col("total")).alias("percentile"))
    return looked_up(own, "_at", settled(table, "ranks")).drop("_at").withColumn("percentile", F.coalesce("percentile", F.lit(0.0)))


def verdict(percentile: Column, words: Column, low_separation: Column, strictness: str = "normal") -> Column:
    """Too short or close to the threshold: REVIEW. Above it: PASS, unless the profile hardly separates. Else FAIL."""
    t = F.lit(THRESHOLD[strictness])
    return F.when(words < LEAST_WORDS, "REVIEW").when(F.abs(percentile - t) <= F.lit(BAND), "REVIEW").when(percentile >= t, F.when(low_separation, "REVIEW").otherwise("PASS")).otherwise("FAIL")


def gate_b(words: Column) -> Column:
    return F.struct(F.lit("none").alias("flag"), (words < LEAST_WORDS_B).alias("abstained"))


def gate_result(verdict_: Column, gate_a: Column, percentile: Column, flag: Column, cold_start: Column, extras: Column) -> Column:
    """The service's answer: extra failures turn PASS to REVIEW; failed lists all that failed in a fixed order."""
    final = F.when((F.size(extras) > 0) & (verdict_ == "PASS"), "REVIEW").otherwise(verdict_)
    failed = F.concat(extras, F.filter(F.array(F.when(~gate_a, "gate_a"), F.when(flag != "none", "gate_b"), F.when(cold_start, "cold_start")), lambda x: x.isNotNull()))
    similarity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), percentile))
    prob = F.coalesce(*[F.when(flag == k, F.lit(v)) for k, v in GATE_B_PROB.items()])
    return F.struct(final.alias("verdict"), (final == "PASS").alias("passed"), similarity.alias("similarity"), similarity.alias("register_fit"), prob.alias("detector_prob"), failed.alias("failed"))
