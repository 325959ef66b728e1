"""The pipeline's stages where they meet: near copies on sites of any size, many languages, odd names, co-training against plain code."""

from collections import Counter

import numpy as np
import pytest

from stylespark.llm import language, lines, quality, rules

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def pages(spark, rows):
    return spark.createDataFrame([(k, t, "en", s, len(t)) for k, t, s in rows], COLUMNS)


@pytest.mark.parametrize("size", [2, 10, 31, 60])
def test_near_copies_leave_one_whole_text(spark, size):
    """Pages of a small site, the last a near copy of the first: what only the two share stays, what all share goes, one of the two stays."""
    import corpus_pipeline as p

    own = lambda k: [f"line {j} of page {k} says some{k} thing{j} of{k * j} its{j - k} own today" for j in range(10)]
    texts = ["\n".join(["the menu of the site", *own(k)]) for k in range(size - 1)]
    texts.append(texts[0].replace("line 5 of page 0", "line 5 of sheet 0"))
    docs = pages(spark, [(k, t, f"s{size}") for k, t in enumerate(texts)])
    cleaned = p.line_dedup(spark, docs, "")
    kept = {r.doc_id: r.text for r in cleaned.collect()}
    bare = lambda t: t if size == 2 else t.partition("\n")[2]  # noqa: E731  # two near copies alone are one page
    assert kept == {k: bare(t) for k, t in enumerate(texts)}
    left = {r.doc_id: r.text for r in p.ngram_jaccard_join(spark, cleaned, "").collect()}
    assert left == {k: bare(t) for k, t in enumerate(texts[:-1])}


def test_groups_count_once(spark):
    """Against plain Python: a page is its group."""
    rng = np.random.default_rng(9)
    rows = [(k, "\n".join(f"l{x}" for x in rng.integers(0, 25, 6)), f"s{k % 3}") for k in range(90)]
    page = {k: int(rng.integers(0, 40)) for k, _, _ in rows}
    groups = spark.createDataFrame(list(page.items()), "doc_id long, page long")
    got = {r.doc_id: r.text for r in lines.drop_boilerplate(pages(spark, rows), row="doc_id", groups=groups, ratio=0.3).collect()}
    want = {}
    for k, t, s in rows:
        site = {page[i] for i, _, x in rows if x == s}
        stands = lambda line: {page[i] for i, u, x in rows if x == s and line in u.split("\n")}  # noqa: B023, E731
        want[k] = "\n".join(line for line in t.split("\n") if not (len(stands(line)) > 1 and len(stands(line)) > 0.3 * len(site)))
    assert got == want and any(got[k] != t for k, t, _ in rows) and any(got[k] == t for k, t, _ in rows)


def test_a_hundred_languages_keep_their_documents(spark):
    import corpus_pipeline as p

    rng = np.random.default_rng(10)
    rows = []
    for k in range(100):
        words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 8))) for _ in range(40)]
        rows += [(1000 * k + i, " ".join(rng.choice(words, 50)), f"l{k:02d}", "s", 0) for i in range(15)]
    docs = spark.createDataFrame(rows, COLUMNS)
    held = {r.doc_id for r in docs.where(language.fold() == 0).collect()}
    left = {r.doc_id: r.lang for r in p.language_id(spark, docs, "").collect()}
    assert len(held & set(left)) >= 0.99 * len(held)
    assert np.mean([left[k] == f"l{k // 1000:02d}" for k in held & set(left)]) >= 0.97


def test_long_texts_follow_one_rule():
    """A text's parts are equal, and training takes the same vector as scoring."""
    assert [len(x) for x in language.parts_of("a" * (language.PART + 1))] == [language.PART // 2, language.PART // 2 + 1]
    assert "".join(language.parts_of("abc" * 30_000)) == "abc" * 30_000 and language.parts_of(None) == [""]
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list(letters + " "), 50_000 if k % 3 else 300)) for k in range(40) for letters in ("abcdef", "efghij")]
    packed = language.Packed(list(language.Packed.of(texts)))
    names, matrix = language.fit(packed, ["x", "y"] * 40)
    direct = packed[np.arange(len(texts))] @ matrix
    lead = 1 / (1 + np.exp(-language.SHARP * np.abs(direct[:, 0] - direct[:, 1])))
    got = list(language.scores(texts, names, matrix))
    assert [g[0] for g in got] == [names[k] for k in direct.argmax(1)] == ["x", "y"] * 40
    assert np.abs(np.array([g[1] for g in got]) - lead).max() < 5e-3


def test_names_with_dots_or_in_another_case(spark, odd, labels):
    """Further columns named a.b, N_LINES, Kept, LANG_PRED come through or are replaced, and change no value."""
    named = odd.select("*", odd.ent.alias("a.b"), odd.ent.alias("N_LINES"), odd.ent.alias("Kept"), odd.ent.alias("LANG_PRED"))
    key = lambda rows, *cols: Counter(map(repr, rows.select(*cols).collect()))
    for f, cols in (
        (lines.drop_boilerplate, ("doc_id", "text", "n_lines", "n_dropped")),
        (lambda d: quality.quality_scores(d, labels), ("doc_id", "quality_score", "kept")),
        (language.language_id, ("doc_id", "lang_pred", "score")),
        (lambda d: rules.quality_rules(d, labels), ("doc_id", "kept", "stratum", "n_words")),
    ):
        got = f(named)
        assert key(got, *cols) == key(f(odd), *cols)
    assert lines.drop_boilerplate(named).where("`a.b` = 5").count() == odd.count()


def test_a_null_stratum_is_its_own(spark):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(60)), None if k % 2 else "") for k in range(40)]
    got = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, quality int")).collect()
    assert Counter((r.stratum, r.n_good) for r in got) == {(None, 15): 20, ("", 15): 20}


def plain_logistic(x, y, ridge=1e-2):
    """The same penalised likelihood by plain gradient descent with a line search."""
    share = {c: np.mean(y == c) for c in (0, 1)}
    weight = np.array([0.5 / share[c] for c in y])
    penalty = np.append(np.full(x.shape[1], ridge * len(y) / 100), 1e-6)
    own = np.hstack([x, np.ones((len(x), 1))])

    def loss(w):
        z = own @ w
        return np.sum(weight * (np.logaddexp(0, z) - y * z)) + 0.5 * np.sum(penalty * w * w)

    w, step = np.zeros(own.shape[1]), 1e-2
    for _ in range(20_000):
        g = own.T @ (weight * (1 / (1 + np.exp(-(own @ w))) - y)) + penalty * w
        while loss(w - step * g) > loss(w) - 0.5 * step * g @ g and step > 1e-12:
            step /= 2
        w, step = w - step * g, step * 1.5
    return w


def test_logistic_and_platt_equal_plain_descent():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5] + 0.3)))).astype(float)
    assert np.abs(quality.logistic(x, y, np.ones(300), steps=50) - plain_logistic(x, y)).max() < 1e-3
    odds = 2 * x[:, 0] - 0.5
    a, b = quality.platt(odds, y)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (300 - y.sum() + 2))
    loss = lambda a, b: np.sum(np.logaddexp(0, a * odds + b) - target * (a * odds + b))
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-3 for da in (-0.02, 0, 0.02) for db in (-0.02, 0, 0.02))


def test_co_training_round_equals_plain_code(monkeypatch):
    """Which pool rows a view hands to the other in each round, by a plain loop over rows."""
    monkeypatch.setattr(quality, "CONFIDENT", 5)
    monkeypatch.setattr(quality, "ROUNDS", 2)
    rng = np.random.default_rng(6)
    make = lambda n: (y := rng.integers(0, 2, n), rng.normal(size=(n, 3)) + y[:, None] * 2.0, rng.normal(size=(n, 2)) + y[:, None] * 2.0)
    y, text, meta = make(80)
    _, pool_text, pool_meta = make(60)
    aside = np.arange(80) % 4 == 0
    model = quality.co_train(text, meta, y, aside, pool_text, pool_meta)
    sets = [([*v[~aside]], [*y[~aside].astype(float)], set()) for v in (text, meta)]
    rounds = []
    for _ in range(2):
        views = [quality.logistic(np.array(rows), np.array(own), np.ones(len(own))) for rows, own, _ in sets]
        given = 0
        for k, (v, pool, other) in enumerate(((text, pool_text, pool_meta), (meta, pool_meta, pool_text))):
            a, b = quality.platt(quality.logit(v[aside], views[k]), y[aside])
            sure = 1 / (1 + np.exp(-(a * quality.logit(pool, views[k]) + b)))
            rows, own, taken = sets[1 - k]
            free = [i for i in range(60) if i not in taken]
            for c in (1, 0):
                p = sure if c else 1 - sure
                pick = sorted((i for i in free if p[i] >= quality.SURE), key=lambda i: (-p[i], i))[:5]
                for i in pick:
                    rows.append(other[i])
                    own.append(float(c))
                    taken.add(i)
                given += len(pick)
        rounds.append(given)
    views = [quality.logistic(np.array(rows), np.array(own), np.ones(len(own))) for rows, own, _ in sets]
    assert model.rounds == rounds and sum(rounds) > 10
    assert all(np.abs(a - b).max() < 1e-6 for a, b in zip(model.views, views, strict=True))
    good = sorted(s for s, c, k in zip(model.score(text, meta), y, aside, strict=True) if c and k)
    assert model.cut == min(0.5, good[int(quality.FALSE_REJECTION * len(good))])
