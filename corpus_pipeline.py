"""Documents to packed training sequences: quality, language, boilerplate lines, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All of them take nulls in any column, empty
and very long texts, repeated rows and further columns of any name, which only COLUMNS outlive; an empty table stays empty. What becomes of such
rows, each stage states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylespark.llm import jaccard, language, lines, packing, quality
from stylespark.llm.common import prepared, release, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose best language leads the second one by less than this score says are rejected with those of no language; 0.5 is no lead.
LEAST_LANGUAGE_SCORE = 0.55
#: Near copies share this part of their shingles of so many words. op5_ngram_jaccard_join has values of its own.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; null texts count as empty ones. Without labels of both classes all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_scores(docs, labels).where("kept").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; lang becomes the predicted one. Texts that are null or have no letter go."""
    found = language.language_id(docs).where((F.col("lang_pred") != language.UND) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows of documents, written, with a number of each."""
    return written(docs.select(F.monotonically_increasing_id().alias("_row"), *COLUMNS), name)


def _near(rows: DataFrame, name: str) -> DataFrame:
    """_row, n_shingles and component_id (a _row) of rows that are linked as near copies."""
    linked = jaccard.jaccard_join(rows, "_row", shingle=NEAR_SHINGLE, percent=NEAR_PERCENT)
    return written(linked.select(F.col("doc_id").alias("_row"), "n_shingles", "component_id"), name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their sites' boilerplate lines, on sites of any size; n_chars follows the text. Those left empty stay, as do null texts (n_chars null) and documents without a source.

    Near copies count as one page, as copies do: they are left to the next stage, and make no line boilerplate.
    """
    rows = _numbered(docs, "pages")
    groups = _near(rows, "page-groups").select("_row", F.col("component_id").alias("page"))
    return lines.drop_boilerplate(rows, row="_row", groups=groups).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones, that of the smallest doc_id (nulls last). Rows of empty texts stay."""
    rows = _numbered(docs, "rows")
    groups = _near(rows, "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    first = groups.where("n_shingles > 0").join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(order).alias("first"))
    stay = first.select("first._row").unionByName(groups.where("n_shingles = 0").select("_row"))
    return rows.join(stay, "_row", "left_semi").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences; null and empty texts are one token."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("best_fit_packing", best_fit_packing),
]
#: Classifiers and exact set joins aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has read is deleted when its own rows are written."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
            if k:
                release(before)
    return docs
