import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stylespark.operators.ingest import ingest
from stylespark.operators.service import hashed_embedder
from stylespark.operators.store import ConcurrentWrite, Store, new_rows, voices
from stylespark.sources.messages import UNIT, corpus_file


def units(spark, rows):
    return spark.createDataFrame([("me", "me@x", m, u, None, t, x) for m, u, t, x in rows], UNIT)


def test_ingest_and_upsert_twice(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [("email", "a", "2024-01-02T00:00:00Z", long), ("email", "b", "2024-01-01T00:00:00Z", long.upper()), ("matrix", "c", "2024-01-01T00:00:00Z", "> q"), ("slack", "d", "2024-01-01T00:00:00Z", "é\r!")]
    got = {r.source_uri: r for r in ingest(units(spark, rows)).collect()}
    assert set(got) == {"a", "b", "d"}
    assert got["a"].dedup_cluster_id == got["b"].id and got["b"].is_canonical and not got["a"].is_canonical
    assert got["d"].text_clean == "é!"
    store = Store(spark, str(tmp_path))
    store.migrate()
    records = ingest(units(spark, rows))
    assert store.upsert(records, hashed_embedder(8), 8) == 3
    assert store.upsert(records, hashed_embedder(8), 8) == 0
    assert store.exemplars().where("not is_canonical").first().style_embedding is None


def test_a_second_writer_is_refused(spark, tmp_path, monkeypatch):
    """Two writers that read the same state: one adds its rows, the other fails and adds none; so too with activations, and after a crash."""
    from stylespark.operators import store as module

    records = ingest(units(spark, [("slack", "d", "2024-01-01T00:00:00Z", "some words")]))
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    one.migrate()
    own = module.settled

    def slow(df, name):  # the second writer works between the first one's read and its claim
        monkeypatch.setattr(module, "settled", own)
        assert two.upsert(records) == 1
        return own(df, name)

    monkeypatch.setattr(module, "settled", slow)
    with pytest.raises(ConcurrentWrite, match="claimed by another"):
        one.upsert(records)
    assert one.exemplars().count() == 1 and one.upsert(records) == 0
    seq = one.turns("activations").turn()
    two.turns("activations").claim(seq)  # a writer that has crashed
    one.write_profile(spark.sql("select 'me' author_id, 'chat' register, '1' version, '{}' style_card, '{}' stylometric_vector, cast(null as array<float>) style_centroid, timestamp'2024-01-01' built_at, 3 exemplar_count"))
    with pytest.raises(ConcurrentWrite, match="isn't done"):
        one.activate("me", "chat", "1")
    one.turns("activations").abandon()
    one.activate("me", "chat", "1")
    one.activate("me", "chat", "1")
    assert [r.seq for r in one.activations().orderBy("seq").collect()] == [seq + 1, seq + 2]


def test_invalid_record_names_its_source(spark):
    with pytest.raises(Exception, match="bad-uri"):
        ingest(units(spark, [("email", "bad-uri", "yesterday", "text")])).collect()


def test_profiles(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.migrate()
    row = lambda v: spark.sql(f"select 'me' author_id, 'chat' register, '{v}' version, '{{}}' style_card, '{{}}' stylometric_vector, cast(null as array<float>) style_centroid, timestamp'2024-01-01' built_at, 3 exemplar_count")
    store.write_profile(row("1"))
    store.write_profile(row("1"))
    store.write_profile(row("2"))
    assert store.profiles().count() == 2 and store.active().count() == 0
    store.activate("me", "chat", "1")
    store.activate("me", "chat", "2")
    with pytest.raises(KeyError):
        store.activate("me", "chat", "9")
    assert [r.version for r in store.active().collect()] == ["2"]
    assert voices(store.active()).first().registers == ["chat"]


def test_corpus_file(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text('[{"medium": "slack", "source_uri": "s", "timestamp": "2024-01-01T00:00:00Z", "text": "hi"}]')
    assert corpus_file(spark, str(good), "v").first().raw_text == "hi"
    bad = tmp_path / "bad.json"
    bad.write_text('[{"medium": "email", "source_uri": "s", "timestamp": "2024-01-01T00:00:00Z", "text": "hi"}]')
    with pytest.raises(Exception, match="bad.json: row 0: medium"):
        corpus_file(spark, str(bad), "v").collect()


@pytest.mark.parametrize("most", [100_000, 20])
def test_lookups_of_hot_and_cold_keys(spark, monkeypatch, most):
    """Broadcast whole, or hot keys by broadcast, cold ones by shuffling and null ones round both: the same rows."""
    from stylespark import runtime

    monkeypatch.setattr(runtime, "MOST_HOT", most)
    monkeypatch.setattr(runtime, "COLD", 5)
    rows = [("hot", i) for i in range(200)] + [(f"k{i % 30}", i) for i in range(60)] + [(None, 7), ("lone", 1)]
    d = spark.createDataFrame(rows, "key string, n long")
    table = d.where("key is not null and key <> 'lone'").groupBy("key").agg(F.count("*").alias("many"), F.max("n").alias("top"))
    got = runtime.looked_up(d, "key", table).collect()
    top = {k: max(n for x, n in rows if x == k) for k, _ in rows if k not in (None, "lone")}
    assert sorted(map(repr, got)) == sorted(repr(Row(key=k, n=n, top=top.get(k))) for k, n in rows)


def test_finished_rounds_leave_no_files(spark, tmp_path, monkeypatch):
    from stylespark import runtime
    from stylespark.operators.components import components

    monkeypatch.setattr(runtime, "shared_path", lambda s, name: f"file://{tmp_path}/{name}-{uuid.uuid4().hex}")
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.root for r in components(edges).collect()} == {0, 100}
    assert len(list(tmp_path.iterdir())) == 1


def test_lookups_by_id_and_records(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.migrate()
    store.upsert(ingest(units(spark, [("slack", u, f"2024-01-0{i}T00:00:00Z", f"text {u} here") for i, u in enumerate("abc", 1)])), hashed_embedder(8), 8)
    ids = {r.source_uri: r.id for r in store.exemplars().collect()}
    assert [r.source_uri for r in store.by_id(ids["a"]).collect()] == ["a"] and store.by_id("none").count() == 0
    asked = spark.createDataFrame([(ids["a"],), (ids["c"],), (ids["c"],), ("none",)], "id string")
    assert sorted(r.source_uri for r in store.by_ids(asked).collect()) == ["a", "c"]
    got = {r.source_uri: r for r in store.records().collect()}
    assert got["b"].authored_at == "2024-01-02T00:00:00.000Z" and "style_embedding" not in store.records().columns


def test_ties_of_a_batch_are_settled_alike(spark):
    rows = [("k", 1, f"t{i}") for i in range(20)] + [("k", 0, "old"), ("m", 5, "x")]
    pick = lambda r: {x.id: x.text for x in new_rows(spark.createDataFrame(r, "id string, seq long, text string"), spark.createDataFrame([], "id string")).collect()}
    assert pick(rows) == pick(rows[::-1]) and pick(rows)["m"] == "x" and pick(rows)["k"] != "old"
