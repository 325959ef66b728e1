import re

import pytest
from pyspark.sql import functions as F

from stylespark.functions import text as T
from stylespark.functions import vectors
from stylespark.operators import deai, gate
from stylespark.operators.retrieval import fuse
from stylespark.operators.service import Jobs, Verdict, build_registers, generate
from stylespark.streaming.limits import is_limited


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("hi\n\nOn Mon, X wrote:\n> old", "hi"),
        ("hi\n--- Forwarded message ---\nold", "hi"),
        ("hi\n-- \nme", "hi"),
        ("hi\n--\nme", "hi\n--\nme"),
        ("  keep  inner  ", "  keep  inner  "),
        ("> only quote", ""),
        ("a\n\n\n", "a"),
        ("", ""),
    ],
)
def test_strip_email(spark, text, expected):
    assert one(spark, text, T.strip_email) == expected


@pytest.mark.parametrize("text,expected", [("no quote\n\n", "no quote\n\n"), ("> q\n> r\n\nown\n\n", "own"), ("> only", ""), ("a\n> later", "a\n> later")])
def test_strip_chat(spark, text, expected):
    assert one(spark, text, T.strip_chat) == expected


@pytest.mark.parametrize("text,expected", [("a\n```py\nx\n```\n\n\nb", "a\n\nb"), ("plain\n\n\ntext", "plain\n\n\ntext"), ("```\nx\n~~~\nb", "b"), ("a\n```\nopen", "a"), ("use `x` here", "use `x` here")])
def test_strip_code(spark, text, expected):
    assert one(spark, text, T.strip_code) == expected


def test_counts_and_ids(spark):
    assert one(spark, " a  b ", T.count_words) == 2
    assert one(spark, "", T.count_words) == 0
    assert one(spark, "don't stop 3", T.count_alpha_words) == 2
    assert one(spark, "\U0001f642", T.utf16_length) == 2
    assert one(spark, '"A" <Me@X.org>', T.normalize_address) == "me@x.org"
    assert one(spark, "a a b", lambda c: T.mattr(F.split(c, " "))) == pytest.approx(2 / 3)


def test_registers(spark):
    rows = [("email", "ok", 1), ("email", "w " * 20, 20), ("matrix", "w " * 130, 130), ("slack", "w " * 20, 20), ("claude", "a\n\nb\n\nc", 85)]
    got = spark.createDataFrame(rows, "m string, t string, n int").select(T.classify_register(F.col("m"), F.col("t"), F.col("n"))).collect()
    assert [r[0] for r in got] == ["chat", "email", "longform", "longform", "longform"]


def test_deai(spark):
    rows = [("It's worth noting that We delve into 42 things.", "email"), ("clean text", "chat"), ("a — b — c — d", "email"), ("is A testament to x", "chat")]
    got = deai.deai(spark.createDataFrame(rows, "text string, register string")).collect()
    assert got[0].output == "We look into 42 things." and got[0].verdict == "PASS"
    assert got[1].output == "clean text"
    assert got[2].output == "a — b, c, d" and got[2].verdict == "REVIEW"
    assert got[3].output == "shows x"


def test_meaning_guard(spark):
    b = spark.createDataFrame([("pay 40 to Jane Doe at a@b.co", "pay to jane")], "b string, a string")
    b = deai.with_breaches(b, "lost", "b", "a").first().lost
    assert set(b) == {"number:40", "entity:Jane Doe", "email:a@b.co"}


def test_gate(spark):
    rows = [(0.9, 100, False), (0.9, 100, True), (0.3, 10, False), (0.45, 100, False), (0.1, 100, False), (0.5, 100, False)]
    got = spark.createDataFrame(rows, "p double, w int, low boolean").select(gate.verdict(F.col("p"), F.col("w"), F.col("low"))).collect()
    assert [r[0] for r in got] == ["PASS", "REVIEW", "REVIEW", "REVIEW", "FAIL", "REVIEW"]


def test_fusion_ties(spark):
    lists = spark.createDataFrame([("s", "b", 1, 2.0), ("c", "a", 1, 2.0), ("c", "c", 2, 1.0)], "list string, id string, rank int, weight double")
    assert [r.id for r in fuse(lists).collect()] == ["a", "b", "c"]


def test_limits():
    state, over = None, []
    for t in (0, 10, 20, 59_999, 60_000):
        state, o = is_limited(state, t, 60_000, 3)
        over.append(o)
    assert over == [False, False, False, True, False]


def test_generation_and_jobs():
    verdicts = iter([Verdict("FAIL", 0.1, False), Verdict("FAIL", 0.3, False), Verdict("FAIL", 0.3, False)])
    got = generate(lambda n: n or "first", lambda p: p, lambda t: next(verdicts))
    assert got.attempts == 3 and got.verdict.percentile == 0.3  # all drafts that were made
    assert generate(lambda n: "x", lambda p: p, None).verdict.verdict == "REVIEW"
    jobs = Jobs()
    name, thread = jobs.start(lambda: 1 / 0)
    thread.join()
    assert name == "job_1" and jobs.get(name)["status"] == "failed" and jobs.get("job_9") is None
    assert build_registers({"chat": 9, "email": 2}, lambda r: None) == (["chat"], ["email"])


def test_long_texts_take_linear_time(spark):
    """100,000 lines with fences, and as many numbers, are done in seconds."""
    import time

    text = "\n".join(f"line {i}" if i % 10 else "```" for i in range(100_000))
    row = spark.createDataFrame([(text, text.replace("line 7", "line"))], "a string, b string")
    start = time.time()
    assert row.select(F.length(T.strip_code(F.col("a")))).first()[0] > 100_000
    assert "number:70001" in deai.with_breaches(row, "lost", "a", "b").first().lost
    assert time.time() - start < 30


def test_a_failing_pass_is_rolled_back(spark):
    def broken(text, register):
        raise RuntimeError("down")

    rows = spark.createDataFrame([("We delve into tea", "chat"), ("fine", "email")], "text string, register string")
    got = deai.deai(rows, "strict", rhythm=broken).collect()
    assert [(r.output, list(r.rolled_back), r.verdict, r.changed) for r in got] == [("We look into tea", ["rhythm"], "REVIEW", True), ("fine", ["rhythm"], "REVIEW", False)]
    louder = deai.deai(rows, "strict", rhythm=lambda t, r: t + "!").collect()
    assert [r.output for r in louder] == ["We look into tea!", "fine!"] and {r.registry_version for r in louder} == {"2026-06-26.1"}


def test_meaning_guard_counts_repeats(spark):
    rows = [("7 and 7 and 8", "8 and 7"), ("3 2 1", "1"), ("same 5", "same 5"), ("", "1"), ("a@b.co a@b.co", "a@b.co x")]
    got = [list(r.lost) for r in deai.with_breaches(spark.createDataFrame(rows, "b string, a string"), "lost", "b", "a").collect()]
    assert got == [["number:7"], ["number:3", "number:2"], [], [], ["email:a@b.co"]]


def test_tell_stems():
    from stylespark.operators.tells import STEMS, TELLS

    for name, _, pattern, _, _ in TELLS:
        for text in SAMPLES[name]:
            assert re.search(pattern, text, re.IGNORECASE) and STEMS[name] in text.lower(), name
    assert sum(bool(s) for s in STEMS.values()) == 17


SAMPLES = {
    "lex.delve": ["Delves"], "lex.intricate": ["intricately"], "lex.underscore": ["underscored"], "lex.tapestry": ["tapestries"], "lex.utilize": ["UTILIZING"], "lex.myriad": ["myriad"],
    "stock.testament": ["stands as a testament to", "A testament to"], "stock.vital_role": ["play an key role in", "Plays a vital role in"], "stock.when_it_comes_to": ["when it comes to"], "stock.in_the_realm_of": ["In the realm of"],
    "scaf.worth_noting": ["it’s worth noting that "], "scaf.important_to_note": ["it's important to note that"], "scaf.in_conclusion": ["in summary, "], "scaf.happy_to_help": ["id be happy to assist", "I’d be happy to help you."],
    "scaf.certainly_opener": ["Great question! "], "rhet.not_just_but": ["not only x but also"], "punct.bold": ["**b**"], "punct.em_dash": ["a — b"],
}


def test_vectors(spark):
    rows = spark.createDataFrame([("[1,2.5,-3]",), (None,)], "v string")
    assert [r[0] for r in rows.select(vectors.parse(F.col("v"))).collect()] == [[1.0, 2.5, -3.0], None]
    for bad in ([1.0], [1.0, float("nan")], [1.0, float("inf")], [1.0, None]):
        with pytest.raises(Exception, match="finite numbers"):
            spark.createDataFrame([(bad,)], "v array<float>").select(vectors.checked(F.col("v"), 2)).collect()
    assert spark.createDataFrame([([1.0, 2.0],)], "v array<float>").select(vectors.checked(F.col("v"), 2)).first()[0] == [1.0, 2.0]


def test_small_names(spark):
    rows = spark.createDataFrame([("standard",), (None,), ("strict",), ("lenient",)], "s string")
    assert [r[0] for r in rows.select(gate.strictness_of(F.col("s"))).collect()] == ["normal", "normal", "strict", "lenient"]
    texts = ["Do not shout", "never mind", "nonstop", "avoids", "keep on", "please STOP"]
    assert [one(spark, t, T.has_negative_directive) for t in texts] == [True, True, False, False, False, True]
    assert one(spark, "```json\n{}\n```", T.strip_json_fence) == "{}" and one(spark, " x ", T.strip_json_fence) == "x"


def test_words_at_edges(spark):
    """White space of any kind at either end, or alone, makes no words."""
    texts = ["", " ", "\n\u3000", "a", " a", "a ", "\ufeffa\u00a0", " a  b\tc\n", "a\x0bb", "\u200b", "é ü", None]
    blank = set("\t\n\x0b\x0c\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff") | {chr(c) for c in range(0x2000, 0x200B)}
    want = {t: None if t is None else len("".join(" " if c in blank else c for c in t).split(" ")) - "".join(" " if c in blank else c for c in t).split(" ").count("") for t in texts}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.n for r in rows.select("t", T.count_words(F.col("t")).alias("n")).collect()} == want
