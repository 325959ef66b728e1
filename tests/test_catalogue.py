"""Every query of the catalogue against its SQL; those without SQL against plain Python."""

import os
from collections import Counter

import duckdb
import numpy as np
import pytest

from stylespark.operators import dedup
from stylespark.plans import catalogue
from stylespark.plans import proxies as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(float(v), 6) if type(v).__name__ in ("float", "Decimal") else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(catalogue.ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert Counter(plain([r[c] for c in columns]) for r in got.collect()) == Counter(plain([r[k] for k in at]) for r in want.fetchall())


def test_rate_limit_of_busy_keys(spark):
    """A user without pauses, one with pauses of about a window, and copies of a time, against a plain count."""
    from stylespark.streaming.limits import limited

    rng = np.random.default_rng(3)
    rows = [("busy", int(t), i) for i, t in enumerate(np.cumsum(rng.integers(0, 40, 4000)))]
    rows += [("calm", int(t), 10_000 + i) for i, t in enumerate(np.cumsum(rng.choice([0, 1, 500, 999, 1000, 1001, 2500], 500)))] + [(None, 5, 1), (None, 6, 2)]
    want, start, n = set(), {}, {}
    for key, at, tie in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if key not in start or at - start[key] >= 1000:
            start[key], n[key] = at, 0
        n[key] += 1
        want.add((key, at, tie, n[key] > 20))
    got = limited(spark.createDataFrame(rows, "k string, t long, i long"), "k", "t", "i", 1000, 20)
    assert {tuple(r) for r in got.collect()} == want and any(r[3] for r in want)


def plain_pass(text, register, categories):
    """Replacements by hand: every tell in order, matches found by scanning words, no code of the engine but its table."""
    import re

    from stylespark.operators.tells import TELLS

    before, any_hit = text, False
    for category in categories:
        for _, kind, pattern, new, registers in TELLS:
            if kind != category or new is None or register not in registers:
                continue
            out, at = [], 0
            for m in re.finditer(pattern, before, re.IGNORECASE | re.ASCII):
                any_hit = True
                out.append(before[at : m.start()])
                out.append(new[:1].upper() + new[1:] if m.group()[:1].isupper() else new)
                at = m.end()
            before = "".join(out) + before[at:]
    if any_hit and "scaffolding_pattern" in categories:
        while "  " in before:
            before = before.replace("  ", " ")
        before = before.lstrip(" ")
    return before


def test_deai_pipeline(spark):
    """The whole repair against plain Python: passes in order, each dropped where it loses a number, link, address or name."""
    import re

    from stylespark.operators.tells import TELLS

    kept = [r"\d[\d.,]*\d|\d", r"https?://[^\s)]+", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+", r"(?<!\w)[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+(?!\w)"]

    def loses(a, b):
        return any(Counter(re.findall(p, a, re.ASCII)) - Counter(re.findall(p, b, re.ASCII)) for p in kept)

    def dashes(text, register):
        if register in ("chat", "email"):
            text = re.sub(r"\*\*([^*\n]+)\*\*", r"\1", text)
        rate = {"email": 1.0, "longform": 1.5}.get(register)
        parts = text.split(" — ")
        allowed = max(1, int(len(text.split()) / 100 * (rate or 0) + 0.5))
        if rate is None or len(parts) - 1 <= allowed:
            return text
        return " — ".join(parts[: allowed + 1]) + ", " + ", ".join(parts[allowed + 1 :])

    want = {}
    for r in P.dirty(spark, SF).collect():
        now, back = r.text, []
        for name, change in (("lexical", lambda t: plain_pass(t, r.register, ["lexical_word"])), ("rhetorical", lambda t: plain_pass(t, r.register, ["scaffolding_pattern", "stock_phrase"])), ("punctuation", lambda t: dashes(t, r.register))):
            new = change(now)
            if loses(now, new):
                back.append(name)
            else:
                now = new
        left = [t[0] for t in TELLS if r.register in t[4] and re.search(t[2], now, re.IGNORECASE | re.ASCII)]
        want[r.doc_id] = (now, left, back, "REVIEW" if left or back or loses(r.text, now) else "PASS")
    got = {r.doc_id: (r.output, list(r.residual), list(r.rolled_back), r.verdict) for r in catalogue.deai_pipeline(spark, SF).collect()}
    assert got == want and {v[3] for v in want.values()} == {"PASS", "REVIEW"}


def brute_clusters(rows):
    sets = {}
    for k, t in rows:
        w = t.lower().split()
        sets[k] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(sets[a] & sets[b])
            if n and n >= 0.75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_clusters_of_many_near_copies(spark):
    """A large group at all distances from its text, chains, copies, short and empty texts."""
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(120):
        w = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 6)):
            w[p] = f"x{rng.integers(0, 30)}"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000 + k, " ".join(f"c{i}" for i in range(k * 5, k * 5 + 100))) for k in range(20)]
    rows += [(3000, "a b"), (3001, "A  b"), (3002, "a b c"), (3003, ""), (3004, " ")]
    items = spark.createDataFrame([(k, t, f"{k:012d}") for k, t in rows], "id long, text string, timestamp string")
    assert {r.id: r.dedup_cluster_id for r in dedup.near_duplicates(items).collect()} == brute_clusters(rows)


def test_copies_lose_no_link(spark):
    """Pairs of classes stand for all pairs of items: their links add up to the brute-force number, and each item's agree."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for _ in range(25):
        w = list(base)
        for p in rng.integers(0, 60, rng.integers(0, 3)):
            w[p] = f"x{rng.integers(0, 9)}"
        texts += [" ".join(w)] * int(rng.integers(1, 4))
    rows = list(enumerate([*texts, "", "", "a b", "A  b", None]))
    sets = {k: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t else set() for k, t in rows}
    linked = [(a, b) for a in sets for b in sets if b < a and sets[a] and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])]
    items = spark.createDataFrame(rows, "id long, text string")
    assert sum(r.links for r in dedup.duplicate_pairs(items).collect()) == len(linked)
    each = Counter(k for pair in linked for k in pair)
    assert {r.id: r.links for r in dedup.duplicate_links(items).collect()} == {k: each[k] for k in sets}


def test_meaning_guard_on_secrets_and_addresses(spark, duck, tmp_path):
    """The guard's query equals its SQL where `42` stands in passwords and addresses, and where items are parts of longer ones."""
    texts = ["token 5310e9c42a173 here", "bosbt.42@mail8.example.com and 42.144.35.254", "42 a", "for 142 things", "4242 things and 42", "Mary Jane Doe", "see https://other.example/42 now", "aa@b.example.com", "", None]
    spark.createDataFrame([(13 * k + 7, t) for k, t in enumerate(texts)] + [(13 * k + 4, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = con.execute(catalogue.ORACLE["meaning_guard"]).fetchall()
    got = [tuple(r) for r in catalogue.meaning_guard(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and sum(bool(r[1]) for r in got) == 11


def test_scores_keep_only_words_of_a_profile(spark, duck, tmp_path, monkeypatch):
    """Documents of many rare words: what the scores keep by document are words of a profile, and scores equal the SQL's."""
    rng = np.random.default_rng(2)
    rows = [(k, " ".join([f"w{'abcdefgh'[i]}" for i in rng.integers(0, 8, 60)] + [f"r{''.join(rng.choice(list('klmnop'), 8))}" for _ in range(400)]), ("en", "de", None)[k % 3], ("a", "b", "c", None)[k % 4]) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    kept, plain = {}, catalogue.settled
    monkeypatch.setattr(catalogue, "settled", lambda df, name: kept.setdefault(name, plain(df, name)))
    got = catalogue.cosine_delta(spark, str(tmp_path)).collect()
    assert kept["counts"].count() < 60 * 200
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = {r[:3]: r[3] for r in con.execute(catalogue.ORACLE["cosine_delta"]).fetchall()}
    assert {(r.author, r.lang, r.doc_id): r.score for r in got} == pytest.approx(want, abs=2e-6) and want


def test_clusters_keep_no_shingles_of_single_texts(spark, monkeypatch):
    """Of texts that share nothing, digests and bands are kept, never their shingles."""
    rows = [(k, " ".join(f"t{k}w{i}" for i in range(300)), f"{k:012d}") for k in range(30)] + [(40, "a b c d e f g", "0"), (41, "a b c d e f g", "1")]
    kept, plain = {}, dedup.settled
    monkeypatch.setattr(dedup, "settled", lambda df, name: kept.setdefault(name, df.columns) and plain(df, name))
    got = {r.id: r.dedup_cluster_id for r in dedup.near_duplicates(spark.createDataFrame(rows, "id long, text string, timestamp string")).collect()}
    assert got == {r[0]: 40 if r[0] == 41 else r[0] for r in rows}
    assert [name for name, columns in kept.items() if "sh" in columns] == ["needed-sets"]


def test_texts_with_a_common_ending_write_no_pairs(spark, monkeypatch):
    """400 short texts of one ending share bands but miss the threshold: their 79,800 pairs are ruled out before anything is written."""
    ending = " ".join(f"e{i}" for i in range(20))
    rows = [(k, f"{' '.join(f't{k}w{i}' for i in range(6))} {ending}", f"{k:012d}") for k in range(400)]
    rows += [(500, f"a b c d e f g {ending} h i j k l", "0"), (501, f"z b c d e f g {ending} h i j k l", "1")]
    written, plain = {"candidates": 0, "confirmed": 0}, dedup.settled

    def counted(df, name):
        out = plain(df, name)
        if name in written:
            written[name] += out.count()
        return out

    monkeypatch.setattr(dedup, "settled", counted)
    got = {r.id: r.dedup_cluster_id for r in dedup.near_duplicates(spark.createDataFrame(rows, "id long, text string, timestamp string")).collect()}
    assert got == {r[0]: 500 if r[0] == 501 else r[0] for r in rows} and written["candidates"] < 500 and written["confirmed"] > 0


def test_sketches_rule_out_no_link():
    """Sets at all distances around the threshold, of all sizes, with counters that are full."""
    rng = np.random.default_rng(4)
    for size in (1, 2, 5, 40, 400, 5000):
        for _ in range(40):
            x = np.unique(rng.integers(-(1 << 62), 1 << 62, size))
            y = np.unique(np.concatenate([rng.choice(x, max(1, int(len(x) * rng.uniform(0.6, 1))), replace=False), rng.integers(-(1 << 62), 1 << 62, int(size * rng.uniform(0, 0.3)))]))
            links = len(np.intersect1d(x, y)) >= 0.75 * len(np.union1d(x, y))
            may = dedup.may_link(*(np.frombuffer(dedup.sketch(s), np.uint8)[None] for s in (x, y)), np.array([len(x)]), np.array([len(y)]), 0.75)[0]
            assert may or not links
    same, more = np.arange(0, 300 * 256, 256), np.arange(0, 390 * 256, 256)
    marks = [np.frombuffer(dedup.sketch(s), np.uint8)[None] for s in (same, more)]
    assert (marks[0] == 255).all() and dedup.may_link(*marks, np.array([300]), np.array([390]), 0.75)[0]


def test_ingest_writes_each_text_once(spark, monkeypatch):
    """What ingest writes holds clean texts, in one place, and no raw ones; the texts of documents aren't shuffled."""
    from stylespark.operators import ingest

    kept, plain = {}, ingest.settled
    monkeypatch.setattr(ingest, "settled", lambda df, name: kept.setdefault(name, df) and plain(df, name))
    assert catalogue.ingest_pipeline(spark, SF).count()
    assert [name for name, df in kept.items() if {"raw_text", "text_clean"} & set(df.columns)] == ["records"] and "raw_text" not in kept["records"].columns
    assert "Exchange" not in kept["records"]._jdf.queryExecution().executedPlan().toString()


def test_written_results_leave_no_shuffle_files(spark):
    """The shuffle of a result goes once it is written; the session's setting is what it was."""
    import time

    from stylespark.runtime import CLEANUP, release, settled

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}

    before = files()
    out = settled(spark.range(1000).repartition(3, "id"), "shuffled")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and out.count() == 1000 and spark.conf.get(CLEANUP) == "false"
    release(out)
