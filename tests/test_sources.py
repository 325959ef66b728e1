"""Untyped records field by field, and corpus files as a data source."""

import io
import json
import tracemalloc

import pytest
from pyspark.sql import functions as F

from stylespark.sources import files, untyped
from stylespark.sources.messages import UNIT, corpus_file

MAIL = {"message_id": "<m1>", "folder": "Sent", "from": '"Me" <ME@example.com>', "date": "2026-06-01T09:00:00.000Z", "thread_id": "t1", "body": "hello"}
CHAT = {"event_id": "$1", "type": "m.room.message", "sender": "@me:host", "origin_server_ts": 1717232400000, "content": {"msgtype": "m.text", "body": "hi", "m.relates_to": {"rel_type": "m.thread", "event_id": "$0"}}}
WRONG = [7, 1.5, True, None, ["a"], {"a": "b"}]


def records(spark, rows, variant):
    df = spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "record string")
    return df.withColumn("record", F.try_parse_json("record")) if variant else df


@pytest.mark.parametrize("variant", [False, True])
def test_mail_fields_of_wrong_types_are_absent(spark, variant):
    rows = [MAIL] + [{**MAIL, f: w, "message_id" if f != "message_id" else "body": f"{f}"} for f in MAIL for w in WRONG] + [{k: v for k, v in MAIL.items() if k != f} for f in MAIL] + ["{broken", "[]", "null", "3"]
    got = untyped.mail_records(records(spark, rows, variant), "me", ["me@example.com"])
    assert ", ".join(f"{n} {t}" for n, t in got.dtypes) == UNIT

    def plain(r):
        s = lambda k: r[k] if isinstance(r.get(k), str) else None
        if not isinstance(r, dict) or s("folder") != "Sent" or s("from") is None:
            return None
        return ("me", "me@example.com", "email", f"message-id:{s('message_id') or ''}", s("thread_id"), s("date") or "", s("body") or "")

    want = [u for r in rows if isinstance(r, dict) and (u := plain(r))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len(want) > 20


@pytest.mark.parametrize("variant", [False, True])
def test_chat_fields_of_wrong_types_are_absent(spark, variant):
    inner, relation = CHAT["content"], CHAT["content"]["m.relates_to"]
    rows = [CHAT] + [{**CHAT, f: w} for f in ("event_id", "type", "sender", "content") for w in WRONG] + [{**CHAT, "origin_server_ts": w} for w in ("1717232400000", True, [], 0, -1.5, 1717232400000.9, 9e15)]
    rows += [{**CHAT, "content": {**inner, f: w}} for f in inner for w in WRONG] + [{**CHAT, "content": {**inner, "m.relates_to": {**relation, f: w}}} for f in relation for w in WRONG]
    got = untyped.chat_records(records(spark, rows, variant), "me", ["@me:host"]).collect()
    kept = [r for r in rows if r["type"] == "m.room.message" and r["sender"] == "@me:host" and isinstance(r["content"], dict) and r["content"].get("msgtype") == "m.text"]
    assert len(got) == len(kept)
    times = {r.timestamp for r in got}
    assert times == {"2024-06-01T09:00:00.000Z", "", "1970-01-01T00:00:00.000Z", "1969-12-31T23:59:59.999Z"}
    assert sum(r.thread_id is None for r in got) == sum(not (isinstance(t := r["content"].get("m.relates_to"), dict) and t.get("rel_type") == "m.thread" and isinstance(t.get("event_id"), str)) for r in kept)
    assert sum(r.raw_text == "" for r in got) == sum(not isinstance(r["content"]["body"], str) for r in kept)
    assert sum(r.source_uri == "matrix-event:" for r in got) == len(WRONG)


ROW = {"medium": "slack", "source_uri": "s", "timestamp": "2024-01-01T00:00:00Z", "text": "hi ]},[{\\ \" é🙂"}


@pytest.mark.parametrize("window", [1, 7, 64, 1 << 20])
def test_arrays_are_read_by_windows_of_any_size(window):
    rows = [{**ROW, "text": f"{k} " + "x" * (k * 37 % 400) + '"], "', "more": [1, {"a": []}]} for k in range(40)]
    for text in (json.dumps(rows), json.dumps(rows, ensure_ascii=False, indent=3), " \n" + json.dumps(rows) + "\n"):
        assert list(files.array_items(io.BytesIO(text.encode()), window)) == rows
    assert list(files.array_items(io.BytesIO(b"[]"), window)) == [] and list(files.array_items(io.BytesIO(b"[1,22 , 333]"), window)) == [1, 22, 333]


@pytest.mark.parametrize(
    ("text", "where"),
    [
        ("{}", "row 0: not an array"), ("", "row 0: not an array"), ("[1]", "row 0: not an object"), (json.dumps([ROW, {**ROW, "medium": "email"}]), "row 1: medium"), (json.dumps([ROW, ROW, {**ROW, "text": ""}]), "row 2: text: empty"),
        (json.dumps([{**ROW, "timestamp": "2024-13-01T00:00:00Z"}]), "row 0: timestamp"), (json.dumps([{**ROW, "timestamp": "2024-01-01T00:00:00+01:00"}]), "row 0: timestamp"), (json.dumps([{**ROW, "source_uri": 3}]), "row 0: source_uri: a string"),
        (json.dumps([ROW])[:-1], "row 1: invalid JSON"), (json.dumps([ROW])[:-9], "row 0: invalid JSON"), (json.dumps([ROW]) + "x", "row 1: text after"), ("[" + json.dumps(ROW) + " " + json.dumps(ROW) + "]", "row 1: invalid JSON"), ("[" + json.dumps(ROW) + ",]", "row 1: invalid JSON"),
    ],
)
def test_the_first_bad_row_is_named(text, where):
    with pytest.raises(files.BadRow, match=f"f.json: {where}"):
        list(files.rows_of("f.json", io.BytesIO(text.encode()), 16))


class Endless(io.RawIOBase):
    """An array of many rows, made as it is read."""

    def __init__(self, rows):
        self.rows, self.made, self.left = rows, 0, b"["

    def read(self, size=-1):
        while len(self.left) < size and self.made < self.rows:
            self.left += (b"," if self.made else b"") + json.dumps({**ROW, "text": "t" * 1000}).encode()
            self.made += 1
            if self.made == self.rows:
                self.left += b"]"
        out, self.left = self.left[:size], self.left[size:]
        return out


def test_memory_is_bounded():
    tracemalloc.start()
    assert sum(1 for _ in files.rows_of("f", Endless(100_000), 1 << 16)) == 100_000  # 110 MB
    assert tracemalloc.get_traced_memory()[1] < 4e6
    tracemalloc.stop()


def test_a_folder_of_files(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"part{f}.json").write_text(json.dumps([{**ROW, "source_uri": f"{f}-{k}", "medium": files.MEDIA[k % 2]} for k in range(1500)]))
    (tmp_path / "notes.txt").write_text("no corpus")
    got = corpus_file(spark, f"file://{tmp_path}", "v", "me@example.com")
    assert got.rdd.getNumPartitions() == 3 and ", ".join(f"{n} {t}" for n, t in got.dtypes) == UNIT
    assert {r.source_uri for r in got.collect()} == {f"{f}-{k}" for f in range(3) for k in range(1500)}
    assert {r.author_address for r in corpus_file(spark, str(tmp_path / "part1.json"), "v").collect()} == {"v"}
    (tmp_path / "part3.json").write_text(json.dumps([ROW, {**ROW, "text": None}]))
    with pytest.raises(Exception, match="part3.json: row 1: text: a string is needed"):
        corpus_file(spark, f"file://{tmp_path}", "v").collect()
