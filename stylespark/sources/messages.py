"""Own-authored units from mail, chat events and corpus files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stylespark.functions.text import normalize_address
from stylespark.runtime import ship
from stylespark.sources.files import CorpusFiles

UNIT = "author_id string, author_address string, medium string, source_uri string, thread_id string, timestamp string, raw_text string"
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z"


def iso_millis(ms: Column) -> Column:
    """Epoch milliseconds as ISO-8601 in UTC with milliseconds; the empty text for null."""
    return F.coalesce(F.date_format(F.timestamp_millis(ms.cast("long")).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))


def mail_units(messages: DataFrame, author_id: str, addresses: list[str]) -> DataFrame:
    """Sent messages from one of the author's addresses; address is as configured, the first spelling winning."""
    known: dict[str, str] = {}
    for a in addresses:
        known.setdefault(a.strip().lower(), a)
    spelled = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else F.create_map().cast("map<string,string>")
    own = messages.where("folder = 'Sent'").withColumn("_address", spelled[normalize_address(F.col("from"))]).where("_address is not null")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return own.select(F.lit(author_id).alias("author_id"), F.col("_address").alias("author_address"), F.lit("email").alias("medium"), F.concat(F.lit("message-id:"), text("message_id")).alias("source_uri"), "thread_id", text("date").alias("timestamp"), text("body").alias("raw_text"))


def thread_of(content: str = "content") -> Column:
    relates = f"{content}.`m.relates_to`"
    return F.when(F.col(f"{relates}.rel_type") == "m.thread", F.col(f"{relates}.event_id"))


def chat_units(events: DataFrame, author_id: str, senders: list[str]) -> DataFrame:
    """Text messages whose sender is the author; senders are case-sensitive, edits carry no thread."""
    own = events.where((F.col("type") == "m.room.message") & (F.col("content.msgtype") == "m.text") & F.col("sender").isin(senders))
    return own.select(F.lit(author_id).alias("author_id"), F.col("sender").alias("author_address"), F.lit("matrix").alias("medium"), F.concat(F.lit("matrix-event:"), F.coalesce("event_id", F.lit(""))).alias("source_uri"), thread_of().alias("thread_id"), iso_millis(F.col("origin_server_ts")).alias("timestamp"), F.coalesce("content.body", F.lit("")).alias("raw_text"))


def corpus_file(spark: SparkSession, path: str, voice_id: str, address: str | None = None) -> DataFrame:
    """Units of a JSON array of texts, or of all such files of a folder; broken JSON or a bad row fails the whole read and names its place."""
    ship(spark).dataSource.register(CorpusFiles)
    rows = spark.read.format(CorpusFiles.name()).load(path)
    return rows.select(F.lit(voice_id).alias("author_id"), F.lit(address or voice_id).alias("author_address"), "medium", "source_uri", F.lit(None).cast("string").alias("thread_id"), "timestamp", F.col("text").alias("raw_text"))
