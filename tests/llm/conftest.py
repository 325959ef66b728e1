import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, _drop string, ent long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, very long, repeated and tied rows, and further columns with clashing names."""
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    near = " ".join(f"n{i}" for i in range(100))
    rows = [(1, near, "en", "a"), (2, near, "en", "a"), (2, near, "en", "a"), (3, near + " tail", "de", "b"), (4, None, "en", "a"), (5, "", None, None), (6, long, "en", None), (None, "a b c", None, "b"), (7, "x", "fr", "a"), (8, " \n\t ", "fr", "a"), (9, "1234 &&& 99", "en", "b"), (10, "Ünïcode ▁ <|endoftext|> \x01  two", "de", "a"), (11, "all rights reserved CC-BY", "en", "c")]
    return spark.createDataFrame([(i, t, v, s, None if t is None else len(t), "s", "d", 5) for i, t, v, s in rows], DOCS)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def oracle():
    """The rows of DuckDB SQL over the tables of a folder, counted."""
    from collections import Counter
    from pathlib import Path

    import duckdb

    def run(where, sql, columns):
        with duckdb.connect() as db:
            for f in Path(where).glob("*.parquet"):
                db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
            return Counter(db.execute(f"SELECT {columns} FROM ({sql})").fetchall())

    return run
