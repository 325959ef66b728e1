import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from stylespark.llm import audit, mixing, periodic
from stylespark.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_source_mixing", "op13_filter_audit", "base_media_bytes", "base_quality_counts", "base_license_places"])
def test_queries_equal_their_sql(spark, oracle, name):
    got = QUERIES[name](spark, SF)
    assert Counter(map(tuple, got.collect())) == oracle(SF, ORACLE[name], ", ".join(f'"{c}"' for c in got.columns))


# Mixing.


def waterfill(sizes, weights=(1, 2, 3), most=3):
    """Targets of sources in order, by sharing again and again."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    target, stopped = [0.0] * len(sizes), set()
    while True:
        left = sum(sizes) - sum(most * sizes[k] for k in stopped)
        free = [k for k in range(len(sizes)) if k not in stopped]
        for k in free:
            target[k] = w[k] * left / sum(w[j] for j in free)
        above = {k for k in free if target[k] > most * sizes[k]}
        if not above:
            return target
        stopped |= above
        for k in above:
            target[k] = float(most * sizes[k])


@pytest.mark.parametrize("sizes", [[5, 0, 900, 40, 3, 700, 1], [1000, 1, 1, 1], [0, 0], [7], [10, 10, 10, 10]])
def test_targets_equal_repeated_sharing(spark, sizes):
    rows = spark.createDataFrame([(f"={k:03}", n) for k, n in enumerate(sizes)], "key string, source_size long")
    got = {r.key: r.target for r in mixing.targets(rows).collect()}
    assert [got[f"={k:03}"] for k in range(len(sizes))] == pytest.approx(waterfill(sizes))


def mixed(rows):
    """source -> (target, taken, largest text) of the operator's rows."""
    out = {}
    for r in rows:
        target, taken, most = out.get(r.source_size, (r.target, 0, 0))
        out[r.source_size] = (target, taken + r.taken, max(most, r.size))
    return out


def test_mix_comes_near_its_targets(spark):
    rng = np.random.default_rng(2)
    docs = [(k, " ".join(["w"] * int(rng.lognormal(4, 1.5))), "hot" if k % 3 else f"s{k % 5}") for k in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    assert len(rows) == 3000 and all(0 <= r.taken <= 3 * r.size and r.taken == r.size * r.copies for r in rows)
    for target, taken, most in mixed(rows).values():
        assert abs(target - taken) <= max(0.002 * target, 5), (target, taken, most)
    again = mixing.mix(df.repartition(13)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_mix_passes_over_long_documents(spark):
    docs = [(k, " ".join(["w"] * (10 if k else 900)), "a") for k in range(100)] + [(k, "w " * 1000, "b") for k in range(100, 103)]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    for target, taken, _ in mixed(got.where("source_size = 1890").collect()).values():
        assert abs(target - taken) <= 5


def test_mix_takes_odd_rows(odd, none):
    rows = {(r.doc_id, r.size): r for r in mixing.mix(odd).collect()}
    assert mixing.mix(none).count() == 0
    assert rows[4, 0].taken == 0 and rows[5, 0].source_size == rows[6, 60_000].source_size == 60_000  # null sources are one
    sources = odd.select("source").distinct().count()
    assert len({(r.source_size, r.target) for r in rows.values()}) == sources
    odd_names = odd.withColumn("a.b", odd.ent).withColumn("KEY", odd.ent).withColumn("hash", odd.ent)
    assert Counter(map(tuple, mixing.mix(odd_names).collect())) == Counter(map(tuple, mixing.mix(odd).collect()))


# Periodic runs.


def brute_runs(words, least=12):
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    texts = "".join(f"{s},{length},{q}\n" for s, length, q in found), " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(found), *four, *[hashlib.sha256(t.encode()).hexdigest() for t in texts])


def test_runs_equal_brute_force():
    rng = np.random.default_rng(1)
    texts = [None, "", " \t", "a " * 40, "a b " * 6, "a b c d e f " * 2, "x " + "a b c d e f " * 2 + "a b y"]
    for k in range(500):
        words = [str(x) for x in rng.integers(0, rng.integers(1, 5), rng.integers(0, 60))]
        if k % 3 == 0 and len(words) > 5:
            words = words[:5] + words[: rng.integers(1, 6)] * int(rng.integers(1, 9)) + words
        texts.append(" ".join(words))
    got = periodic.analysed(list(range(len(texts))), pa.array(texts), True)
    assert [(t, g) for t, g in zip(texts, got, strict=True)] == [(t, brute_row(i, t)) for i, t in enumerate(texts)]
    assert sum(g[0] > 0 for g in got) > 100 and max(g[0] for g in got) > 3


def test_suffix_array_and_prefixes_equal_sorting():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        letters = np.append(rng.integers(1, 4, n), 0)
        common = periodic.CommonPrefixes(letters)
        suffixes = [letters[k:].tolist() for k in range(n + 1)]
        assert common.places.tolist() == sorted(range(n + 1), key=suffixes.__getitem__)
        i, j = np.triu_indices(n + 1, 1)
        want = [next(k for k in range(n + 2) if k == min(len(suffixes[x]), len(suffixes[y])) or suffixes[x][k] != suffixes[y][k]) for x, y in zip(i, j, strict=True)]
        assert common(i, j).tolist() == want
        values = rng.permutation(n)
        assert periodic.next_smaller(values).tolist() == [next((b for b in range(a + 1, n) if values[b] < values[a]), n) for a in range(n)]


def test_runs_query_rows(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = docs.where("length(text) < 8000")
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, SF).join(short.select("doc_id"), "doc_id", "left_semi").collect()}
    assert got == {r.doc_id: brute_row(r.doc_id, r.text) for r in short.collect()}
    assert sum(v[0] > 0 for v in got.values()) > 5
    assert periodic.periodic_runs(none).count() == 0
    rows = periodic.periodic_runs(odd.withColumn("a.b", odd.ent).withColumn("TEXT2", odd.ent)).collect()
    assert len(rows) == odd.count()
    long = next(r for r in rows if r.doc_id == 6)
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 60_000, 5000, 12_000)
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_runs, r.start, r.runs_sha256, r.collapsed_sha256) for r in rows if r.doc_id in (4, 5, 8)] == [(0, None, empty, empty)] * 3


# Audit.


def brute_audit(docs, labels):
    first, label = {}, defaultdict(lambda: (False, False))
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x in labels:
        label[i] = (label[i][0] or q == 1, label[i][1] or x == 1)
    rows = []
    for i, t, s in docs:
        t = t or ""
        words = WORD.findall(t)
        fails = {f for f, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and first.get(t, i) < i), strict=True) if bad}
        rows.append((s or "", fails, *(label[i] if i is not None else (False, False))))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [r for r in mine if f in r[1] and not r[1] & before]
                out[part, "".join(order), k + 1] = [
                    sum(not r[1] & (before | {f}) for r in mine), len(here), sum(f in r[1] and bool(r[1] & before) for r in mine), sum(r[1] == {f} for r in mine), sum(r[2] for r in here), sum(r[3] for r in here)
                ]
    for (part, order, k), v in out.items():
        v.append(sum(w[1] for (p, o, j), w in out.items() if p == part and o[j - 1] == order[k - 1]))
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_brute_force(spark, odd, none):
    rng = np.random.default_rng(3)
    pool = ["aé b", "A B C", "#", "", None, "q " * 300, " ".join(f"w{k}" for k in range(250)), " ".join(f"w{k}" for k in range(250)) + " $"]
    docs = [(int(rng.integers(0, 60)) if k % 9 else None, pool[rng.integers(len(pool))], [None, "", "a", "b"][rng.integers(4)]) for k in range(150)]
    labels = [(k, int(rng.integers(2)), int(rng.integers(2))) for k in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.filter_audit(spark.createDataFrame(docs, "doc_id long, text string, source string"), known).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == brute_audit(docs, labels)
    odd_docs = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    got = audit.filter_audit(odd.withColumn("a.b", odd.ent).withColumn("PART", odd.ent).withColumn("mask", odd.ent), known).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == brute_audit(odd_docs, labels)
    assert audit.filter_audit(none, known).count() == 0
    assert audit.filter_audit(odd, known.where("false")).where("good_lost + toxic_lost > 0").count() == 0
