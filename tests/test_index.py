"""The vector index against all distances, its plan, and inserts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylespark.operators.index import VectorIndex

SCHEMA = "id string, register string, style_embedding array<float>, content_embedding array<float>"


def vectors(many, dim, groups, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return (centres[rng.integers(0, groups, many)] + 0.6 * rng.normal(size=(many, dim))).astype(np.float32)


def brute(rows, register, at, seed, k):
    def distance(v):
        a, b = np.array(v, float), np.array(seed, float)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return 1 - (a @ b / n if n else 0.0)

    return [i for _, i in sorted((round(distance(r[at]), 9), r[0]) for r in rows if r[1] == register and r[at] is not None)[:k]]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    x, y = vectors(3000, 24, 30, 1), vectors(3000, 24, 30, 2)
    rows = [(f"r{k:05}", ("chat", "email")[k % 5 == 0], x[k].tolist(), None if k % 7 == 0 else y[k].tolist()) for k in range(3000)]
    rows += [("zero", "chat", [0.0] * 24, None), ("none", "chat", None, None), ("copy", "chat", x[1].tolist(), None)]
    index = VectorIndex(spark, f"file://{tmp_path_factory.mktemp('index')}").build(spark.createDataFrame(rows[:2500] + rows[3000:], SCHEMA))
    return index.insert(spark.createDataFrame(rows[2500:3000], SCHEMA)), rows


def test_every_vector_is_indexed_once(stored):
    index, rows = stored
    got = {(r.axis, r.id, r.register) for r in index.members().collect()}
    want = {(axis, r[0], r[1]) for r in rows for at, axis in ((2, "style_embedding"), (3, "content_embedding")) if r[at] is not None}
    assert got == want and index.members().count() == len(want)


def test_recall_of_a_few_cells(stored):
    """Ten neighbours of 40 seeds by the default number of cells, a part of all."""
    index, rows = stored
    seeds = vectors(12, 24, 30, 1)
    assert index.cells().where("register = 'chat' and axis = 'style_embedding'").count() >= 40
    found = [len({r.id for r in index.nearest("chat", "style_embedding", s.tolist(), 10).collect()} & set(brute(rows, "chat", 2, s, 10))) for s in seeds]
    assert sum(found) >= 0.9 * 10 * len(seeds)


def test_exact_search_and_its_fallback(stored):
    index, rows = stored
    for s in vectors(3, 24, 30, 9):
        assert [r.id for r in index.nearest("email", "content_embedding", s.tolist(), 7, probes=1, exact=True).collect()] == brute(rows, "email", 3, s, 7)
    all_ = index.nearest("chat", "style_embedding", rows[1][2], 5000, probes=1).collect()  # more than a cell holds
    assert len(all_) == sum(r[1] == "chat" and r[2] is not None for r in rows)
    assert {r.id for r in index.nearest("chat", "style_embedding", rows[1][2], 2).collect()} == {"r00001", "copy"}
    with pytest.raises(Exception, match="wasn't built"):
        index.insert(index.spark.createDataFrame([("n", "longform", [1.0] * 24, None)], SCHEMA))


def test_searches_read_few_cells(stored):
    index, rows = stored
    plan = index._distances("chat", "style_embedding", [3, 5], np.ones(24))
    text = index.spark._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    assert any("PartitionFilters" in line and "cell" in line and "IN" in line for line in text.splitlines())
    read = index.members().where("register = 'chat' and axis = 'style_embedding' and cell in (3, 5)").select(F.input_file_name()).distinct().count()
    assert read <= 2 * 8 * 2  # files of two cells, from a build and an insert


def test_search_of_many_queries_is_exact(stored):
    index, rows = stored
    asked = [(f"q{k}", r[1], r[2]) for k, r in enumerate(rows[:300:6])] + [("none", "chat", None), ("other", "nowhere", [1.0] * 24), ("zero", "chat", [0.0] * 24)]
    got = index.search(index.spark.createDataFrame(asked, "query string, register string, vector array<float>"), "style_embedding", 4, probes=2).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query, r.place)):
        found.setdefault(r.query, []).append(r.id)
    assert found == {q: brute(rows, g, 2, v, 4) for q, g, v in asked if v is not None and g != "nowhere"}
