"""Units to records: clean, identify, count, classify, validate, collapse, cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylespark.functions import text as T
from stylespark.functions.nfc import with_nfc
from stylespark.operators.dedup import near_duplicates
from stylespark.runtime import looked_up, settled
from stylespark.sources.messages import ISO

MEDIA, REGISTERS, VERSION = ("email", "matrix", "slack", "claude"), ("chat", "email", "longform"), "1"
#: Repeated records that are broadcast to be left out; more are joined.
MOST_LATER = 1_000_000
RECORD = ["id", "author_id", "medium", "register", "source_uri", "thread_id", "timestamp", "text_clean", "word_count", "dedup_cluster_id", "is_canonical", "ingest_version"]


def to_records(units: DataFrame, version: str = VERSION) -> DataFrame:
    """One record per unit, without its raw text, each a cluster of its own as yet. An invalid record fails the batch and names its source_uri."""
    own = units.withColumn("text_clean", T.strip_code(T.strip_for(F.col("medium"), F.col("raw_text"))))
    cleaned = with_nfc(own, "text_clean").withColumn("text_clean", T.drop_controls(F.col("text_clean")))
    named = cleaned.withColumn("id", T.stable_id(*[F.col(c) for c in ("author_id", "medium", "source_uri", "text_clean")])).withColumn("word_count", T.count_words(F.col("text_clean")))
    full = named.withColumn("register", T.classify_register(F.col("medium"), F.col("text_clean"), F.col("word_count"))).withColumns({"dedup_cluster_id": F.col("id"), "is_canonical": F.lit(True), "ingest_version": F.lit(version)})
    filled = [F.length(c) > 0 for c in ("id", "author_id", "source_uri", "ingest_version")]
    ok = filled[0]
    for f in [*filled[1:], F.col("medium").isin(*MEDIA), F.col("register").isin(*REGISTERS), F.col("timestamp").rlike(ISO), F.col("word_count") >= 0]:
        ok = ok & f
    checked = F.when(F.coalesce(ok, F.lit(False)), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("invalid record: "), F.coalesce("source_uri", F.lit("?")))).cast("string"))
    return full.withColumn("id", checked).drop("raw_text")


def collapse(records: DataFrame, order: str = "timestamp") -> DataFrame:
    """Records with text, the first of each id in the given order. Rows of repeated ids are told apart by ids and times alone; texts aren't shuffled or sorted."""
    rows = settled(records.where(~T.is_blank(F.col("text_clean"))).withColumn("_row", F.monotonically_increasing_id()), "records")
    place = F.struct(F.col(order).alias("order"), "source_uri", "_row")
    firsts = rows.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("many")).where("many > 1").select("id", "many", F.col("first._row").alias("kept"))
    later = settled(looked_up(rows.select("id", "_row"), "id", firsts).where("_row <> kept").select("_row"), "later-records")
    few = later.limit(MOST_LATER + 1).count() <= MOST_LATER
    return rows.join(F.broadcast(later) if few else later, "_row", "left_anti").drop("_row")


def ingest(units: DataFrame, version: str = VERSION, order: str = "timestamp") -> DataFrame:
    """Records stamped with their near-duplicate cluster; none is dropped for being a copy."""
    own = collapse(to_records(units, version), order)
    clusters = near_duplicates(own.select("id", F.col("text_clean").alias("text"), "timestamp"))
    return own.drop("dedup_cluster_id", "is_canonical").join(clusters, "id", "left").select(*RECORD)
