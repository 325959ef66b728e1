"""Unicode NFC, which Spark has no function for."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame

from stylespark.runtime import with_text


def composed(text: str | None) -> str | None:
    return text if text is None or text.isascii() else unicodedata.normalize("NFC", text)


def with_nfc(df: DataFrame, name: str) -> DataFrame:
    """df with a column in NFC."""
    return with_text(df.withColumnRenamed(name, "_raw"), name, ["_raw"], composed).drop("_raw")
