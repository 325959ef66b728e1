"""Summaries that merge, frequent runs, distributed ranks and rounding against plain Python."""

import math
import random
import re
import statistics
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stylespark.functions import text as T
from stylespark.functions.numbers import round_binary
from stylespark.operators import frequent, gate, stylometry, summary

SF = "/root/testdata/sf0.01"
WORDS = re.compile("[A-Za-z]+(?:'[A-Za-z]+)?").findall


def plain_targets(texts):
    """The style targets as they are defined, in plain Python, rounded by round()."""
    joined = "\n".join(texts)
    words = [w.lower() for w in WORDS(joined)]
    total = max(len(words), 1)
    sentences = [s.strip() for s in re.split("[.!?]+", joined) if s.strip()]
    lengths = [n for n in (len(WORDS(s)) for s in sentences) if n]
    windows = [len(set(words[i : i + 50])) / 50 for i in range(len(words) - 49)]
    mattr = 0.0 if not words else len(set(words)) / len(words) if len(words) <= 50 else sum(windows) / len(windows)
    runs = Counter(" ".join(own[i : i + n]) for t in texts for own in [[w.lower() for w in WORDS(t)]] for n in (2, 3) for i in range(len(own) - n + 1))
    marks = {"em_dash": "—|--", "comma": ",", "period": r"\.", "exclamation": "!", "question": r"\?", "semicolon": ";", "colon": ":", "ellipsis": r"\.\.\.|…"}
    return {
        "sentence_len_mean": round(statistics.mean(lengths) if lengths else 0.0, 3), "sentence_len_variance": round(statistics.pvariance(lengths) if len(lengths) > 1 else 0.0, 3), "mattr": round(mattr, 4),
        "punctuation_profile": {k: round(len(re.findall(p, joined)) / total, 5) for k, p in marks.items()}, "contraction_rate": round(len(re.findall("[A-Za-z]+'[A-Za-z]+", joined)) / total, 5),
        "lowercase_start_rate": round(sum(s[:1].islower() for s in sentences) / max(len(sentences), 1), 4), "word_count": total, "sample_count": len(texts),
        "signature_ngrams": [g for g, n in sorted(runs.items(), key=lambda x: (-x[1], x[0])) if n >= 2][:8],
    }


def same(row, want):
    got = row.asDict()
    return {k: got[k] for k in want} == want


def test_text_features_equal_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = stylometry.text_features(docs).collect()
    wrong = [(r.doc_id, r.asDict(), want) for r in rows if not same(r, want := plain_targets([texts[r.doc_id]]))]
    assert not wrong and len(rows) == len(texts)
    assert "Exchange" not in docs.sparkSession._jvm.PythonSQLUtils.explainString(stylometry.text_features(docs)._jdf.queryExecution(), "simple")


PIECES = ["a", "B c", "d. e", "...", "? !", "\n", " ", "it's", "—", "--", "x y z", "W.", "é", "😀 ok", "-", ' "', " q", "\x1c"]


def some_text(rng, pieces):
    return "".join(rng.choice(PIECES) + rng.choice(["", " "]) for _ in range(pieces))


def test_summaries_merge_in_any_tree():
    rng = random.Random(3)
    for _ in range(1500):
        texts = [some_text(rng, rng.choice([0, 1, 2, 5, 30, 120])) for _ in range(rng.randrange(1, 6))]

        def fold(part):
            if len(part) == 1:
                return summary.summary(part[0])[0]
            k = rng.randrange(1, len(part))
            return summary.merged(fold(part[:k]), fold(part[k:]))

        got, want = fold(texts), summary.summary("\n".join(texts))[0]._replace(texts=len(texts))
        assert got == (want if want.closed else want._replace(tail=got.tail)), texts


def test_targets_of_many_texts(spark):
    """A group of 20,000 texts, in many tasks, beside small and null ones."""
    rng = random.Random(8)
    rows = [("big", k, some_text(rng, rng.randrange(5))) for k in range(20_000)] + [("small", k, some_text(rng, 40)) for k in range(3)] + [(None, 1, "a b. C"), (None, 0, None), ("blank", 0, " ")]
    df = spark.createDataFrame(rows, "g string, seq long, text string").repartition(6)
    got = {r.g: r for r in stylometry.compute_targets(df, ["g"]).collect()}
    for g, r in got.items():
        assert same(r, plain_targets([t or "" for x, _, t in sorted(rows, key=lambda r: r[1]) if x == g])), g
    assert set(got) == {"big", "small", "blank", None} and got["big"].sample_count == 20_000
    assert stylometry.compute_targets(df.where("false"), ["g"]).count() == 0


def test_sentences_span_texts(spark):
    df = spark.createDataFrame([("a", 1, "one two"), ("a", 2, "three. Four"), ("a", 3, "five!")], "g string, doc_id long, text string")
    r = stylometry.sentence_stats(df, ["g"]).first()
    assert (r.n_sentences, r.sentence_len_mean, r.sentence_len_variance, r.lowercase_start_rate) == (2, 2.5, 0.25, 0.5)


def test_mattr_is_linear(spark):
    rng = random.Random(2)
    for size in (0, 1, 49, 50, 51, 52, 99, 300):
        words = [rng.choice("abcdefgh") + rng.choice("xyz" * rng.randrange(1, 3)) for _ in range(size)]
        want = 0.0 if not words else len(set(words)) / size if size <= 50 else statistics.mean(len(set(words[i : i + 50])) / 50 for i in range(size - 49))
        got = spark.createDataFrame([(words,)], "t array<string>").select(T.mattr(F.col("t"))).first()[0]
        assert got == pytest.approx(want, abs=1e-12), size
    million = spark.createDataFrame([([f"w{rng.randrange(5000)}" for _ in range(1_000_000)],)], "t array<string>")
    start = time.time()
    assert 0.9 < million.select(T.mattr(F.col("t"))).first()[0] < 1
    assert time.time() - start < 30  # minutes by sets for every window


def test_rounding_equals_python(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 0.5, 1.5, 2.5, -0.5, 161.1275, 2.675, 1e-300, -1e-9, 3.5e10, math.inf, -math.inf, None]
    for _ in range(200_000):
        d = rng.randrange(6)
        tie = (rng.randrange(-(10**6), 10**6) + 0.5) / 10**d
        values += [tie, math.nextafter(tie, 9e9), math.nextafter(tie, -9e9), rng.uniform(-1000, 1000), rng.randrange(10**6) / rng.randrange(1, 10**4)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    for d in (0, 3, 4, 5):
        got = df.select("v", round_binary(F.col("v"), d).alias("r")).where("v is not null").collect()
        wrong = [(v, r, round(v, d)) for v, r in got if not (r == (v if math.isinf(v) else round(v, d)) and math.copysign(1, r) == math.copysign(1, v))]
        assert not wrong, (d, wrong[:5])
    assert df.where("v is null").select(round_binary(F.col("v"), 3)).first()[0] is None


@pytest.mark.parametrize(("counters", "candidates"), [(20_000, 200_000), (300, 200_000), (60, 200_000), (5, 200_000), (300, 0)])
def test_frequent_runs_equal_a_full_count(spark, counters, candidates):
    """Also with so few counters that candidates are counted again, or that nothing is proven and groups are counted in full."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text").unionByName(spark.createDataFrame([(None, "x y x y"), (None, None), ("none", "solo")], "lang string, text string")).repartition(3)
    want = {}
    for r in docs.collect():
        own = [w.lower() for w in WORDS(r.text or "")]
        want.setdefault(r.lang, Counter()).update(" ".join(own[i : i + n]) for n in (2, 3) for i in range(len(own) - n + 1))
    want = {(g, *x, k) for g, c in want.items() for k, x in enumerate(sorted(((t, n) for t, n in c.items() if n >= 2), key=lambda x: (-x[1], x[0]))[:8], 1)}
    got = frequent.top_runs(docs, ["lang"], 8, 2, counters=counters, candidates=candidates)
    assert {(r.lang, r.gram, r.n, r.idx) for r in got.collect()} == want


def test_counters_never_lack_more_than_their_shortfall():
    rng = random.Random(6)
    true, kept, short = Counter(), Counter(), 0
    for _ in range(300):
        more = [int(rng.paretovariate(0.7)) for _ in range(50)]
        true.update(more)
        kept.update(more)
        short += frequent.cut_back(kept, 20)
        assert len(kept) <= 20
        assert all(kept[x] <= n <= kept[x] + short for x, n in true.items())


def test_ranks_of_one_large_group(spark):
    """One group of a million distinct scores beside small, tied and null ones."""
    big = spark.range(1_000_000).select(F.lit("big").alias("g"), (F.col("id") * 3).cast("double").alias("score"), (F.col("id") % 2).alias("label"))
    small = spark.createDataFrame([("s", 1.0, 1), ("s", 1.0, 0), ("s", 2.0, 1), (None, 1.0, 1), (None, 0.0, 0), ("one", 1.0, 1)], "g string, score double, label long")
    got = {r.g: (r.n_pos, r.n_neg, r.roc_auc) for r in stylometry.roc_auc(big.unionByName(small), ["g"]).collect()}
    assert got == {"big": (500_000, 500_000, pytest.approx(0.500001)), "s": (2, 1, 0.75), None: (1, 1, 1.0), "one": (1, 0, None)}
    asked = spark.createDataFrame([("big", 3.0), ("big", 4.0), ("big", -1.0), ("s", 1.0), ("s", 1.5), (None, 0.5), ("new", 1.0), ("s", None)], "g string, score double")
    asked = asked.unionByName(spark.range(5000).selectExpr("'s' AS g", "0.0D AS score"))
    at = {(r.g, r.score): r.percentile for r in gate.percentiles(asked, big.unionByName(small), ["g"]).collect()}
    assert at == {("big", 3.0): 2e-6, ("big", 4.0): 2e-6, ("big", -1.0): 0.0, ("s", 1.0): 2 / 3, ("s", 1.5): 2 / 3, (None, 0.5): 0.5, ("new", 1.0): 0.0, ("s", None): 0.0, ("s", 0.0): 0.0}
    assert gate.percentiles(asked, small, ["g"]).count() == asked.count()
