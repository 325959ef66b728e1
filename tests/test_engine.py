import json
import time
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from stylespark.operators.engine import BUNDLED, Engine, judged, prose_of
from stylespark.operators.service import hashed_embedder
from stylespark.operators.store import Store
from stylespark.operators.tools import call
from stylespark.sources.messages import UNIT

PROSE = json.dumps({"voice_summary": "plain", "habits": ["short words", "never shouts"], "do_more_of": ["questions"]})


def model(prompt):
    if "JSON" in prompt:
        return f"```json\n{PROSE}\n```"
    if "pay 40" in prompt:
        return "the money is on its way"
    return "well i think we should go and see about the dog and then well we should go home and i think that is it for the day"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    store.migrate()
    e = Engine(store, model, embed=hashed_embedder(8), dim=8)
    base = "well i think we should go and see about the {} and then well we should go home and i think that is it"
    things = ["dog", "boat", "train", "garden", "roof", "river", "bridge"]
    rows = [("me", "me@x", "matrix", f"m{i}", None, f"2024-01-0{i + 1}T00:00:00Z", base.format(t) + f" number {t} {t}s " * i) for i, t in enumerate(things)]
    rows.append(("me", "me@x", "email", "mail", None, "2024-02-01T00:00:00Z", "one lonely mail about nothing much at all today"))
    e.result = e.build_voice("me", spark.createDataFrame(rows, UNIT), lambda r: f"{r}-1", "2024-03-01T00:00:00Z")
    return e


def test_build_skips_thin_registers(engine):
    assert engine.result == {"ingested": 8, "built_registers": ["chat"], "skipped_registers": ["email"]}
    p = engine.profile("me", "chat")
    assert p["version"] == "chat-1" and p["readiness"] == "generation-ready" and engine.profile("me", "email") is None
    assert p["blob"]["metrics"]["n_impostor"] == len(BUNDLED) and p["blob"]["metrics"]["roc_auc"] > 0.9


def test_scores_of_one_text_equal_the_plan(engine):
    blob = engine.profile("me", "chat")["blob"]
    n = len(blob["scores"])
    texts = [*engine.exemplars("me", "chat", 9), *BUNDLED]
    assert n == len(texts)
    assert sorted(judged(blob, t).percentile for t in texts) == [bisect_right(blob["scores"], x + 1e-9) / n for x in blob["scores"]]
    short = judged(blob, "well i think")
    assert short.verdict == "REVIEW"


def test_drafts(engine):
    got = engine.generate("me", "chat", "say hello", "the boat")
    assert got["verdict"] in ("PASS", "REVIEW") and got["voice_id"] == "me" and "cold_start" not in got["gate"]["failed_checks"]
    assert got["gate"]["passed"] == (got["verdict"] == "PASS")
    cold = engine.generate("me", "email", "say hello")
    assert cold["verdict"] == "REVIEW" and cold["gate"]["failed_checks"] == ["gate_a", "cold_start"]
    lost = engine.rewrite("me", "chat", "pay 40 to Jane Doe")
    assert lost["verdict"] != "PASS" and lost["gate"]["failed_checks"][0] == "meaning"


def test_prompt_leaves_out_negative_habits(engine):
    card = engine.profile("me", "chat")["style_card"]
    got = engine._prompt(card, ["x"], [], "go", None)
    assert "- short words" in got and "never shouts" not in got and got.count("\n\n---\n\n") == 2


def test_deai_result(engine):
    got = engine.deai("We delve into 42 things.", "chat")
    assert got["verdict"] == "PASS" and "delve" not in got["text"] and got["scores"]["register_fit"] == 1.0


def test_directory(engine):
    assert [(r.author_id, r.registers) for r in engine.list_voices().collect()] == [("me", ["chat"])]
    got = {r.register: (r.exemplars, r.readiness) for r in engine.voice_status("me").collect()}
    assert got["longform"] == (0, "insufficient") and got["chat"][1] == "generation-ready" and got["email"] == (1, "insufficient")
    assert {r.readiness for r in engine.voice_status("nobody").collect()} == {"insufficient"}


@pytest.mark.parametrize("reply", ["", "no", "[]", '{"voice_summary": "x", "habits": [1], "do_more_of": []}'])
def test_broken_prose(reply):
    with pytest.raises(ValueError):
        prose_of(["a"], lambda p: reply)


def test_tools_check_and_strip(engine):
    got = call(engine, "voice_generate", {"brief": "say hello", "voice_id": "me", "register": "chat", "knobs": {"grounding_query": "the boat", "other": 1}})
    assert set(got) == {"text", "verdict", "scores", "gate", "register", "voice_id"} and set(got["gate"]) == {"passed", "failed_checks"}
    assert set(call(engine, "voice_deai", {"text": "We delve.", "register": "chat", "strictness": "strict"})) == set(got) | {"ai_detector_prob_before", "ai_detector_prob_after"}
    assert call(engine, "voice_transform", {"text": "pay 40 to Jane Doe", "to_voice": "me", "register": "chat"})["gate"]["failed_checks"][0] == "meaning"
    assert call(engine, "voice_list", {}) == {"voices": [{"voice_id": "me", "registers_ready": ["chat"]}]}
    told = call(engine, "voice_status", {"voice_id": "me"})
    assert [set(r) for r in told["registers"]] == [{"register", "readiness", "coverage", "last_eval"}] * 3


@pytest.mark.parametrize(
    ("tool", "payload"),
    [
        ("voice_generate", {"brief": "", "voice_id": "me", "register": "chat"}),
        ("voice_generate", {"brief": "x" * 100_001, "voice_id": "me", "register": "chat"}),
        ("voice_generate", {"brief": "x", "voice_id": "me", "register": "letter"}),
        ("voice_generate", {"brief": "x", "voice_id": "m" * 257, "register": "chat"}),
        ("voice_rewrite", {"text": "x", "register": "chat"}),
        ("voice_rewrite", {"text": "x", "voice_id": "me", "register": "chat", "strictness": "normal"}),
        ("voice_add", {"voice_id": "me", "sources": []}),
        ("voice_add", {"voice_id": "me", "sources": ["email"] * 17}),
        ("voice_add", {"voice_id": "me", "sources": ["paper"]}),
        ("voice_status", "me"),
    ],
)
def test_tools_refuse_bad_input(tool, payload):
    with pytest.raises(ValueError):
        call(None, tool, payload)  # the engine isn't asked
    with pytest.raises(KeyError):
        call(None, "voice_remove", {})


def test_add_voice_by_the_tool(engine, spark):
    engine.corpora = lambda voice, sources, ref: spark.createDataFrame([(voice, "x@x", "email", "one", None, "2024-01-01T00:00:00Z", "hello there")], UNIT)
    job = call(engine, "voice_add", {"voice_id": "new", "sources": ["email"], "corpus_ref": "r"})["job_id"]
    for _ in range(600):
        if engine.jobs.get(job)["status"] != "running":
            break
        time.sleep(0.1)
    assert engine.jobs.get(job) == {"status": "succeeded", "result": {"ingested": 1, "built_registers": [], "skipped_registers": ["chat"]}}


def test_profiles_by_version_and_broken_cards(engine, spark):
    assert engine.store.profile("me", "chat", "chat-1").count() == 1 and engine.store.profile("me", "chat", "chat-2").count() == 0
    row = engine.store.profile("me", "chat", "chat-1").drop("author_id", "style_card").withColumns({"author_id": F.lit("odd"), "style_card": F.lit('{"targets": {}, "prose": {}}')})
    engine.store.write_profile(row)
    engine.store.activate("odd", "chat", "chat-1")
    with pytest.raises(ValueError):
        engine.profile("odd", "chat")


def test_facts_need_an_embedder(engine):
    bare = Engine(engine.store, model)
    assert bare.facts("me", "chat", "the boat") == []
