"""Exemplars and profiles as Parquet: append-only, idempotent, with activation as a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stylespark.functions.vectors import checked
from stylespark.operators.accounting import coverage, readiness
from stylespark.operators.retrieval import REGISTERS
from stylespark.runtime import release, settled
from stylespark.sources.messages import iso_millis

EXEMPLARS = "id string, author_id string, medium string, source_uri string, thread_id string, authored_at timestamp, ingested_at timestamp, text string, word_count int, dedup_cluster_id string, is_canonical boolean, ingest_version string, content_embedding array<float>, style_embedding array<float>, profile_version string, register string"
PROFILES = "author_id string, register string, version string, style_card string, stylometric_vector string, style_centroid array<float>, built_at timestamp, exemplar_count int"
ACTIVATIONS = "author_id string, register string, version string, seq long"


def last_of(batch: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in order; of rows that tie, the one with the greatest hash of its values. A partial aggregate: a hot key isn't sorted."""
    row = F.struct(F.col(order), F.xxhash64(*batch.columns).alias("_tie"), F.struct(*batch.columns).alias("_row"))
    return batch.groupBy(key).agg(F.max_by(row["_row"], F.struct(row[order], row["_tie"])).alias("_row")).select("_row.*")


def new_rows(batch: DataFrame, stored: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """What an insert-if-absent of the batch adds: its last row of each key that isn't stored."""
    return last_of(batch, key, order).join(stored.select(key), key, "left_anti")


class ConcurrentWrite(RuntimeError):
    """Another writer has changed the table, or is about to; nothing was written."""


class Turns:
    """Numbered writes to one table: a writer claims the number after the last one by creating its file, which only one can, and marks it as done.

    A write is based on what was read after turn(); it is refused where another writer has claimed a number since, or hasn't finished its own."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.root = self._path(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self) -> set[str]:
        return {f.getPath().getName() for f in self.fs.listStatus(self.root)} if self.fs.exists(self.root) else set()

    def last(self) -> int:
        """The number claimed last; 0 before the first."""
        return max((int(n) for n in self._names() if n.isdigit()), default=0)

    def turn(self) -> int:
        """The number to claim; raises while the one before it isn't done."""
        last = self.last()
        if last and f"{last}.done" not in self._names():
            raise ConcurrentWrite(f"write {last} to {self.root.getName()} isn't done; after a crash call abandon()")
        return last + 1

    def claim(self, turn: int) -> None:
        self.fs.mkdirs(self.root)
        if not self.fs.createNewFile(self._path(self.root, str(turn))):
            raise ConcurrentWrite(f"write {turn} to {self.root.getName()} was claimed by another writer")

    def done(self, turn: int) -> None:
        self.fs.createNewFile(self._path(self.root, f"{turn}.done"))

    def abandon(self) -> None:
        """Let writes go on after a writer's crash; what it had written in part stays invisible only as far as Spark's commit kept it so."""
        if last := self.last():
            self.done(last)


class Store:
    """Tables below one folder. Of writers that work at the same time one is let through, the others fail with ConcurrentWrite before they write."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def turns(self, table: str) -> Turns:
        return Turns(self.spark, f"{self.path}/_turns/{table}")

    def migrate(self) -> None:
        """Create the tables that are missing."""
        for name, schema, by in (("exemplars", EXEMPLARS, ["register"]), ("profiles", PROFILES, []), ("activations", ACTIVATIONS, [])):
            self.spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(f"{self.path}/{name}")

    def exemplars(self) -> DataFrame:
        return self.spark.read.schema(EXEMPLARS).parquet(f"{self.path}/exemplars")

    def profiles(self) -> DataFrame:
        return self.spark.read.schema(PROFILES).parquet(f"{self.path}/profiles")

    def activations(self) -> DataFrame:
        return self.spark.read.schema(ACTIVATIONS).parquet(f"{self.path}/activations")

    def upsert(self, records: DataFrame, embed=None, dim: int = 768, order: str = "timestamp") -> int:
        """Insert records that aren't stored; returns how many. Only canonical ones are embedded; stored rows never change."""
        turns = self.turns("exemplars")
        turn = turns.turn()
        fresh = new_rows(records, self.exemplars(), "id", order)
        none = F.lit(None).cast("array<float>")
        fields = ["id", "author_id", "medium", "source_uri", "thread_id", F.to_timestamp("timestamp").alias("authored_at"), F.current_timestamp().alias("ingested_at"), F.col("text_clean").alias("text"), "word_count", "dedup_cluster_id", "is_canonical", "ingest_version"]
        vectors = lambda v: [v.alias("content_embedding"), v.alias("style_embedding"), F.lit(None).cast("string").alias("profile_version"), "register"]
        rows = fresh.where("not is_canonical").select(*fields, *vectors(none))
        own = fresh.where("is_canonical")
        rows = rows.unionByName(own.select(*fields, *vectors(none if embed is None else checked(embed(F.col("text_clean")), dim))))
        before = self.exemplars().count()
        rows = settled(rows, "fresh")  # read and embedded before the claim, which others wait for
        turns.claim(turn)
        rows.write.mode("append").partitionBy("register").parquet(f"{self.path}/exemplars")
        turns.done(turn)
        release(rows)
        return self.exemplars().count() - before

    def records(self) -> DataFrame:
        """Exemplars as they are handed out: times as ISO-8601 in UTC, without vectors."""
        iso = lambda c: F.when(F.col(c).isNotNull(), iso_millis(F.unix_millis(c))).alias(c)
        return self.exemplars().select(*[iso(c) if c in ("authored_at", "ingested_at") else c for c in self.exemplars().columns if not c.endswith("_embedding")])

    def by_id(self, key: str) -> DataFrame:
        return self.exemplars().where(F.col("id") == key)

    def by_ids(self, keys: DataFrame) -> DataFrame:
        return self.exemplars().join(keys.select("id"), "id", "left_semi")

    def write_profile(self, row: DataFrame) -> None:
        """Insert inactive; a version that exists is left as it is."""
        turns = self.turns("profiles")
        turn = turns.turn()
        fresh = row.join(self.profiles().select("author_id", "register", "version"), ["author_id", "register", "version"], "left_anti")
        turns.claim(turn)
        fresh.write.mode("append").parquet(f"{self.path}/profiles")
        turns.done(turn)

    def activate(self, author: str, register: str, version: str) -> None:
        """Make a version the active one; an unknown version fails and changes nothing."""
        if not self.profile(author, register, version).limit(1).count():
            raise KeyError(f"no profile {author}/{register}/{version}")
        turns = self.turns("activations")
        seq = turns.turn()
        turns.claim(seq)
        self.spark.createDataFrame([(author, register, version, seq)], ACTIVATIONS).coalesce(1).write.mode("append").parquet(f"{self.path}/activations")
        turns.done(seq)

    def profile(self, author: str, register: str, version: str) -> DataFrame:
        """One version of a profile, active or not."""
        return self.profiles().where((F.col("author_id") == author) & (F.col("register") == register) & (F.col("version") == version))

    def active(self) -> DataFrame:
        return active_profiles(self.profiles(), self.activations())


def active_profiles(profiles: DataFrame, activations: DataFrame) -> DataFrame:
    """The profile that each author's register last activated."""
    keys = ["author_id", "register"]
    return profiles.join(activations.groupBy(*keys).agg(F.max_by("version", "seq").alias("version")), [*keys, "version"])


def versions(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy(F.desc("built_at"), F.desc("version"))


def voices(active: DataFrame) -> DataFrame:
    """author_id and its active registers in order."""
    return active.groupBy("author_id").agg(F.sort_array(F.collect_set("register")).alias("registers")).orderBy("author_id")


def status(authors: DataFrame, active: DataFrame, exemplars: DataFrame) -> DataFrame:
    """Each register of each author: exemplars, readiness, coverage and last_eval (null without a profile)."""
    spark = authors.sparkSession
    constant = F.broadcast(spark.createDataFrame([(r,) for r in REGISTERS], "register string"))
    keys = ["author_id", "register"]
    counted = exemplars.where("is_canonical").groupBy(*keys).agg(F.count("*").alias("n"))
    rows = authors.select("author_id").distinct().crossJoin(constant).join(active.select(*keys, "exemplar_count", F.col("built_at").alias("last_eval"), F.lit(True).alias("has")), keys, "left").join(counted, keys, "left")
    n = F.coalesce(F.col("exemplar_count").cast("long"), F.col("n"), F.lit(0))
    return rows.select(*keys, n.alias("exemplars"), F.when(F.col("has"), readiness(n)).otherwise("insufficient").alias("readiness"), coverage(n).alias("coverage"), "last_eval")


def other_authors(exemplars: DataFrame, author: str, register: str, limit: int = 200) -> DataFrame:
    """Texts of other authors in a register, by id."""
    return exemplars.where((F.col("author_id") != author) & (F.col("register") == register) & F.col("is_canonical")).orderBy("id").limit(limit)
