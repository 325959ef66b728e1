"""The provided tables in the shape of the engine's inputs, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stylespark.runtime import ship
from stylespark.sources.messages import iso_millis

EPOCH, STEP = 1704067200000, 60000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    medium = F.when(F.col("lang") == "en", "email").when(F.col("lang") == "de", "matrix").when(F.col("lang") == "fr", "slack").otherwise("claude")
    return d.select("doc_id", F.col("source").alias("author_id"), F.col("source").alias("author_address"), medium.alias("medium"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_uri"), F.lit(None).cast("string").alias("thread_id"), iso_millis(F.lit(EPOCH) + F.lit(STEP) * F.col("doc_id")).alias("timestamp"), F.col("text").alias("raw_text"))


UNITS = f"""p_units AS (SELECT doc_id, source AS author_id, source AS author_address, CASE lang WHEN 'en' THEN 'email' WHEN 'de' THEN 'matrix' WHEN 'fr' THEN 'slack' ELSE 'claude' END AS medium,
 'doc:' || doc_id AS source_uri, CAST(NULL AS VARCHAR) AS thread_id, strftime(epoch_ms({EPOCH} + {STEP} * doc_id), '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, text AS raw_text FROM documents)"""

#: doc_id modulo their number -> what stands before and after the text.
DIRT = {
    0: ("", "\n\nOn Tue, a friend wrote:\n> old words\n> and more"),
    1: ("", "\n\n-- \nsent from a train"),
    2: ("> quoted line\n> and more\n\n", "\n\n"),
    3: ("first\n```\ncode()\n```\n\n\nthen ", "\n~~~\nopen end"),
    4: ("it is a testament to this. ", " we delve into 42 things — and — then — done — ok. it's worth noting that Jane Doe agreed"),
    5: ("**bold** words. ", " in conclusion, we utilize https://a.example/x not just once but twice"),
    6: ("", "\aé\r\nend"),
    7: ("", ""),
    8: ("Of course! ", " The Intricate plan underscores a tapestry; Myriad ways. It’s important to note that all is well. I'd be happy to help you. So. Write to a@b.example, Jane Doe"),
    9: ("Certainly, ", " it plays a vital role in life. When it comes to that, in the realm of tea. I’d be happy to assist. They Play a key role in x, intricately tapestries Underscored"),
    10: (" It’s worth noting that ", " In summary, not only this but also that. DELVING and Utilizes it, a@b.example"),
    11: ("Absolutely. ", " stands as a testament to it, A testament to us and great question! yes"),
    12: ("Great question. ", " DELVE on; **more** — x — y"),
}


def soiled(doc_id: Column, text: Column) -> Column:
    """The text with what stands before and after it."""
    k = F.pmod(doc_id, F.lit(len(DIRT)))
    return F.coalesce(*[F.when(k == n, F.concat(F.lit(a), text, F.lit(b))) for n, (a, b) in DIRT.items()])


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, register, text: documents with quotes, signatures, fences, tells and controls around their texts."""
    d = table(spark, sf_dir, "documents")
    register = F.coalesce(*[F.when(F.pmod("doc_id", F.lit(3)) == n, F.lit(r)) for n, r in enumerate(("chat", "email", "longform"))])
    return d.select("doc_id", register.alias("register"), soiled(F.col("doc_id"), F.col("text")).alias("text"))


def _sql(text: str) -> str:
    out = "'" + text.replace("'", "''") + "'"
    for c, code in (("\n", 10), ("\a", 7), ("\r", 13), ("́", 769)):
        out = out.replace(c, f"' || chr({code}) || '")
    return out


DIRTY = "p_dirty AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'chat' WHEN 1 THEN 'email' ELSE 'longform' END AS register, CASE doc_id % " + str(len(DIRT)) + " " + " ".join(f"WHEN {n} THEN {_sql(a)} || text || {_sql(b)}" for n, (a, b) in DIRT.items()) + " END AS text FROM documents)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    register = F.coalesce(*[F.when(F.pmod("label", F.lit(3)) == n, F.lit(r)) for n, r in enumerate(("chat", "email", "longform"))])
    return e.select(F.col("vec_id").alias("id"), register.alias("register"), F.lit(True).alias("is_canonical"), F.lit("a").alias("author_id"), F.col("embedding").alias("style_embedding"), F.reverse("embedding").alias("content_embedding"), F.col("vec_id").alias("authored_at"))


VECTORS = "p_vec AS (SELECT vec_id AS id, CASE label % 3 WHEN 0 THEN 'chat' WHEN 1 THEN 'email' ELSE 'longform' END AS register, CAST(embedding AS DOUBLE[]) AS s, list_reverse(CAST(embedding AS DOUBLE[])) AS c FROM embeddings)"


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chat events: own messages are the user's, every third turn is an edit."""
    c = table(spark, sf_dir, "conversations")
    relation = F.struct(F.when(F.pmod("turn", F.lit(3)) == 2, "m.replace").otherwise("m.thread").alias("rel_type"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("event_id"))
    content = F.struct(F.when(F.pmod("turn", F.lit(5)) == 4, "m.image").otherwise("m.text").alias("msgtype"), F.col("text").alias("body"), relation.alias("m.relates_to"))
    return c.select(F.format_string("%d-%d", "conv_id", "turn").alias("event_id"), F.lit("m.room.message").alias("type"), F.concat(F.lit("@"), "role").alias("sender"), (F.lit(EPOCH) + F.col("conv_id") * STEP + F.col("turn") * 1000).alias("origin_server_ts"), content.alias("content"))


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.format_string("%d-%d", "conv_id", "turn").alias("message_id"), F.when(F.pmod("turn", F.lit(4)) == 3, "INBOX").otherwise("Sent").alias("folder"), F.concat(F.lit('"A B" <'), F.initcap("role"), F.lit("@Example.org>")).alias("from"), F.lit("2024-01-01T00:00:00Z").alias("date"), F.col("conv_id").cast("string").alias("thread_id"), F.col("text").alias("body"))


#: (conv_id + turn) modulo their number -> field -> JSON that stands there in place of a string.
WRONG = {1: {"thread_id": "7"}, 2: {"body": '["text"]'}, 3: {"from": '{"address": "user@example.org"}'}, 4: {"date": "true", "event_id": "null"}, 5: {"origin_server_ts": '"1704067200000"', "rel_type": "1"}}


def _json(fields: dict[str, Column]) -> Column:
    """A JSON object; fields' strings are quoted, but for rows that have something else there."""
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{.v.:(.*)\}$", 1)
    parts = []
    for name, value in fields.items():
        own = value if name in ("content", "origin_server_ts", "m.relates_to") else quoted(value)
        own = own.cast("string")
        for n, wrong in WRONG.items():
            own = F.when(k == n, F.lit(wrong[name])).otherwise(own) if name in wrong else own
        parts.append(F.concat(F.lit(f'"{name}":'), own))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def untyped_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail as JSON records, of which some have wrong types in a field and some, where the remainder is 6, are cut off."""
    m = mail(spark, sf_dir).withColumn("conv_id", F.col("thread_id").cast("long")).withColumn("turn", F.substring_index("message_id", "-", -1).cast("long"))
    record = _json({c: F.col(c) for c in ("message_id", "folder", "from", "date", "thread_id", "body")})
    return m.select(F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7)) == 6, F.left(record, F.length(record) - 1)).otherwise(record).alias("record"))


def untyped_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    event = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    relates = _json({"rel_type": F.when(F.pmod("turn", F.lit(3)) == 2, "m.replace").otherwise("m.thread"), "event_id": event})
    content = _json({"msgtype": F.when(F.pmod("turn", F.lit(5)) == 4, "m.image").otherwise("m.text"), "body": F.col("text"), "m.relates_to": relates})
    record = _json({"event_id": F.format_string("%d-%d", "conv_id", "turn"), "type": F.lit("m.room.message"), "sender": F.concat(F.lit("@"), "role"), "origin_server_ts": F.lit(EPOCH) + F.col("conv_id") * STEP + F.col("turn") * 1000, "content": content})
    return c.select(record.alias("record"))
