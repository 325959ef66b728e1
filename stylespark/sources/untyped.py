"""Messages as untyped records: one column of JSON or VARIANT, of which each field counts only where it has the right type.

A field of another type, an absent one and null are the same, field by field; a record that isn't JSON has no field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylespark.sources.messages import chat_units, mail_units

#: The largest epoch milliseconds that are a date.
LAST_MS = 8.64e15


def text_field(record: Column, path: str) -> Column:
    """The string at a path; null for anything else."""
    return F.when(_kind(record, path) == "STRING", F.try_variant_get(record, path, "string"))


def number_field(record: Column, path: str) -> Column:
    """The number at a path as a double; null for anything else, also for numbers in quotes."""
    kind = _kind(record, path)
    return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(record, path, "double"))


def _kind(record: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(record, path, "variant"))


def _records(rows: DataFrame, column: str) -> DataFrame:
    """rows with _record, a VARIANT."""
    is_text = rows.schema[column].dataType.simpleString() == "string"
    return rows.withColumn("_record", F.try_parse_json(F.col(column)) if is_text else F.col(column))


def mail_records(rows: DataFrame, author_id: str, addresses: list[str], column: str = "record") -> DataFrame:
    """Units of mail records; like mail_units of their string fields."""
    v = F.col("_record")
    fields = ("message_id", "folder", "from", "date", "thread_id", "body")
    return mail_units(_records(rows, column).select(*[text_field(v, f"$.{f}").alias(f) for f in fields]), author_id, addresses)


def chat_records(rows: DataFrame, author_id: str, senders: list[str], column: str = "record") -> DataFrame:
    """Units of chat events; like chat_units of their fields. The time is a number of epoch milliseconds, cut to whole ones."""
    v = F.col("_record")
    at = number_field(v, "$.origin_server_ts")
    relates = F.struct(*[text_field(v, f"$.content['m.relates_to'].{f}").alias(f) for f in ("rel_type", "event_id")])
    content = F.struct(text_field(v, "$.content.msgtype").alias("msgtype"), text_field(v, "$.content.body").alias("body"), relates.alias("m.relates_to"))
    whole = F.when(F.abs(at) <= LAST_MS, F.when(at < 0, F.ceil(at)).otherwise(F.floor(at)))
    typed = _records(rows, column).select(*[text_field(v, f"$.{f}").alias(f) for f in ("event_id", "type", "sender")], whole.alias("origin_server_ts"), content.alias("content"))
    return chat_units(typed, author_id, senders)
