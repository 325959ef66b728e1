"""Cases of the first advice round; each failed before its change."""

import numpy as np


def brute_kept(rows, shingle, percent):
    """doc_ids that stay where one document of each group of linked ones does."""
    sets = {}
    for k, t in rows:
        w = (t or "").lower().split()
        sets[k] = {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            n = len(sets[a] & sets[b]) if b < a else 0
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k for k in sets if find(k) == k}


def stage(spark, name, rows):
    import corpus_pipeline as p

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return dict(p.STAGES)[name](spark, docs, "").collect()


def test_near_duplicate_stage_takes_five_words_and_four_fifths(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(30):
        base = [f"g{g}w{i}" for i in range(100)]
        added = int(rng.integers(10, 30))  # one block added, or scattered edits
        rows += [(3 * g, " ".join(base)), (3 * g + 1, " ".join(base[:50] + [f"n{g}x{i}" for i in range(added)] + base[50:]))]
        for p in rng.choice(100, 2, replace=False):
            base[p] = f"y{g}p{p}"
        rows.append((3 * g + 2, " ".join(base)))
    rows += [(900, "a b c d"), (901, "A b  c d"), (902, "a b c"), (903, ""), (904, None)]
    got = {r.doc_id for r in stage(spark, "ngram_jaccard_join", [(k, t, "en", "s", 0) for k, t in rows])}
    want = brute_kept(rows, 5, 80)
    assert got == want and want != brute_kept(rows, 4, 85)


def test_line_stage_cleans_small_sites(spark):
    rows = [(k, f"menu\nown {k}", "en", f"s{k // 3}", 0) for k in range(9)] + [(9, "menu\nown 9", "en", "single", 0), (10, "menu\nown 10", "en", None, 0)]
    got = {r.doc_id: r.text for r in stage(spark, "line_dedup", rows)}
    assert got == {k: f"own {k}" for k in range(9)} | {9: "menu\nown 9", 10: "menu\nown 10"}


def test_line_stage_leaves_copies_whole(spark):
    """A group of copies on a third of a site's pages keeps its own lines, and one of it survives the next stage."""
    copy = "menu\nfirst line of the copy\nsecond line of the copy"
    rows = [(k, copy if k < 10 else f"menu\nown text {k}", "en", "s", 0) for k in range(30)]
    done = stage(spark, "line_dedup", rows)
    got = {r.doc_id: r.text for r in done}
    assert got == {k: "first line of the copy\nsecond line of the copy" if k < 10 else f"own text {k}" for k in range(30)}
    assert {r.doc_id for r in stage(spark, "ngram_jaccard_join", done)} == {0, *range(10, 30)}


def test_every_language_is_learnt(spark):
    """70 languages of own words; the rarest ones are among them."""
    from stylespark.llm import language

    rng = np.random.default_rng(8)
    rows = []
    for k in range(70):
        words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 8))) for _ in range(30)]
        rows += [(1000 * k + i, " ".join(rng.choice(words, 60)), f"l{k:02d}") for i in range(20 if k < 64 else 12)]
    got = language.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {f"l{k:02d}" for k in range(70)}
    assert np.mean([r.lang_pred == r.lang for r in got if r.held_out]) >= 0.97
    import corpus_pipeline

    assert np.mean([r.score >= corpus_pipeline.LEAST_LANGUAGE_SCORE for r in got if r.held_out]) >= 0.99


def test_near_duplicate_stage_drops_rows_not_ids(spark):
    """Repeated rows and copies without a doc_id leave one row; a text that shares a duplicate's doc_id stays."""
    near, other = " ".join(f"n{i}" for i in range(100)), " ".join(f"o{i}" for i in range(100))
    rows = [(2, near), (2, near), (1, near + " tail"), (None, near), (2, other), (None, "x y z"), (None, "x y z"), (5, ""), (5, ""), (6, None)]
    got = stage(spark, "ngram_jaccard_join", [(k, t, "en", "s", 0) for k, t in rows])
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(1, near + " tail"), (2, other), (None, "x y z"), (5, ""), (5, ""), (6, None)], key=repr)


def test_media_query_returns_tiles(spark):
    """A tile is an NPY of the mean over each cell of the text's image, cells cut at fractions of rows and columns."""
    import io

    from stylespark.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op2_media_columns(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        gray = np.frombuffer(raw + bytes(-len(raw) % 64 or (0 if raw else 64)), np.uint8).reshape(-1, 64)
        means = np.repeat(gray, 16, 0).reshape(16, len(gray), 16, 4).mean((1, 3))
        tile = np.load(io.BytesIO(r.tile), allow_pickle=False)
        assert tile.shape == (16, 16) and tile.dtype == np.uint8 and np.abs(tile - means).max() <= 0.5 + 1e-6
