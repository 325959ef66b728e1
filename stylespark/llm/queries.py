"""The driver's queries for the operators of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stylespark.llm import audit, frames, jaccard, language, licenses, lines, media, mixing, packing, periodic, pieces, quality, rules
from stylespark.llm.common import documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(documents(spark, sf_dir))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.quality_rules(documents(spark, sf_dir), _labels(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_dropped")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), _labels(spark, sf_dir)).select("doc_id", "quality_score", "kept")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.token_files(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return language.language_id(docs).select("doc_id", "held_out", "lang_pred", "score")


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(documents(spark, sf_dir))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(documents(spark, sf_dir), plant=True)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(documents(spark, sf_dir), _labels(spark, sf_dir))


def base_media_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op2's rows: the payload as it is read back from the images."""
    return op2_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def base_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op3's rows all but the verdict."""
    return op3_quality_rules(spark, sf_dir).drop("kept")


def base_license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op6's rows what the phrases give."""
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_media_columns, op3_quality_rules, op4_line_dedup, op5_ngram_jaccard_join, op6_license_scan, op7_quality_classifier, op8_token_files, op9_language_id, op10_piece_codec, op11_source_mixing, op12_periodic_runs, op13_filter_audit, base_media_bytes, base_quality_counts, base_license_places)
}

_LINE_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, CASE WHEN text IS NULL THEN CAST([] AS VARCHAR[]) ELSE string_split(text, chr(10)) END AS ls FROM documents),
lines AS (SELECT rid, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
page AS (SELECT rid, source, dense_rank() OVER (ORDER BY text) AS page FROM d WHERE source IS NOT NULL),
pages AS (SELECT source, count(DISTINCT page) AS pages FROM page GROUP BY source),
boiler AS (
  SELECT source, key FROM (SELECT DISTINCT page.page, lines.source, trim(line, ' ') AS key FROM lines JOIN page USING (rid) WHERE trim(line, ' ') <> '')
  JOIN pages USING (source) GROUP BY source, key, pages
  HAVING count(*) > 1 AND count(*) > CAST({lines.RATIO} AS DOUBLE) * pages),
kept AS (
  SELECT l.rid, string_agg(CASE WHEN b.key IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS text, count(*) AS n_lines, count(b.key) AS n_dropped
  FROM lines l LEFT JOIN boiler b ON l.source = b.source AND trim(l.line, ' ') = b.key GROUP BY l.rid)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN k.n_dropped = 0 THEN d.text ELSE coalesce(k.text, '') END AS text,
  coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM d LEFT JOIN kept k USING (rid)
"""

_MEDIA_BYTES = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT *, octet_length(b) AS n FROM b), p AS (SELECT *, greatest(64, (n + 63) // 64 * 64) AS padded FROM n)
SELECT doc_id, n AS n_bytes, padded AS payload_bytes, sha256(b || repeat('\\x00'::BLOB, CAST(padded - n AS BIGINT))) AS payload_sha256 FROM p
"""

_QUALITY_COUNTS = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
x AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM x QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
f AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w JOIN l USING (rid) LEFT JOIN c USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PLACES = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f'w[i + {k}] = {chr(39)}{word}{chr(39)}' if k else f'w[i] = {chr(39)}{word}{chr(39)}' for k, word in enumerate(phrase.split()))}) AS p{n}" for n, phrase in enumerate(licenses.PHRASES))
_LICENSE_PLACES = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {_PLACES} FROM w), a AS (SELECT *, list_concat(p0, list_concat(p1, p2)) AS p FROM p)
SELECT doc_id, n_words, len(p) AS n_base, list_min(p) - 1 AS first_word, list_max(p) - 1 AS last_word,
array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN len(p{n}) > 0 THEN '{label}' END" for n, label in enumerate(licenses.PHRASES.values()))}], lambda x: x IS NOT NULL)), ',') AS base_labels FROM a
"""

ORACLE = {
    "op4_line_dedup": _LINE_DEDUP, "op11_source_mixing": mixing.SQL, "op13_filter_audit": audit.SQL, "base_media_bytes": _MEDIA_BYTES, "base_quality_counts": _QUALITY_COUNTS, "base_license_places": _LICENSE_PLACES
}
