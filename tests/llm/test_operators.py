import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stylespark.llm import frames, jaccard, language, licenses, lines, media, packing, pieces, quality, rules
from stylespark.llm.common import tokenizer_path
from stylespark.llm.encoders import byte_bpe, piece_bpe, word_bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_every_operator_takes_odd_rows_and_empty_tables(odd, none, labels):
    for f in (packing.best_fit_packing, media.media_columns, jaccard.jaccard_join, licenses.license_scan, frames.token_files, language.language_id, pieces.piece_encode, lines.drop_boilerplate):
        assert f(none).count() == 0, f
        n = f(odd).count()
        assert n == odd.count() if f is not packing.best_fit_packing else n >= odd.count(), f
    for f in (rules.quality_rules, quality.quality_scores):
        assert f(none, labels).count() == 0
        assert f(odd, labels).count() == odd.count()
        assert f(odd, labels.where("false")).count() == odd.count()


PARTS = ["a", "The", " ", "  ", "\n", "\n\n", "don't", "\t", "é", "ß", "🙂", "中", "12", "!!", "<|endoftext|>", "́", "▁", "\0", "\x01", "\x02", "foo,", "'", "İ", "½", "\x85", "<s>", "\r\n", "\xa0", "\u2003", "\u3000", "\x1c", "“q”", "—", "Ж", "ŉ", "²", "_", "\u200b", "x" * 90]


def texts_of(parts, many, seed=3):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(parts, rng.integers(1, 20))) for _ in range(many)]


def test_encoders_equal_their_libraries():
    texts = ["", " ", "\n", "a ", "a\n\n", " a", "a   b", None] + texts_of(PARTS, 4000) + texts_of([p for p in PARTS if p not in ("▁", "\0", "\x01", "\x02", "<|endoftext|>", "\x1c", "\x85", "\u200b")], 4000, 4)
    for tool in (byte_bpe(), word_bpe(), piece_bpe()):
        for t, own, want in zip(texts, tool.encode(texts), tool.library_ids([t or "" for t in texts]), strict=True):
            assert own.tolist() == want, (tool, t)


@pytest.mark.parametrize("make", [byte_bpe, word_bpe, piece_bpe])
def test_runs_of_spaces_and_blank_lines_are_cut_too(make):
    texts = texts_of(["The", " ", "  ", "    ", "\n", "\n\n", "\t", "don't", "é,", "(x)"], 3000, 5)
    tool = type(make())()
    for t, own, want in zip(texts, tool.encode(texts), tool.library_ids(texts), strict=True):
        assert own.tolist() == want, t
    assert tool.whole == 0 and tool.cut > 3000


@pytest.mark.parametrize("make", [byte_bpe, word_bpe, piece_bpe])
def test_a_full_table_drops_rare_chunks_only(make):
    tool = type(make())()
    tool.table.most = 50
    texts = [f"the same words again {k} x{k * 7}" for k in range(400)]
    for k in range(0, 400, 20):
        part = texts[k : k + 20]
        assert [x.tolist() for x in tool.encode(part)] == tool.library_ids(part)
    assert len(tool.table.at) < 120 and "same" in tool.table.at


@pytest.mark.parametrize("make", [byte_bpe, word_bpe])
def test_merging_by_rank_equals_merging_by_list(make):
    """Every entry of the whole vocabulary, merged alone by the list, is itself; so the two can't differ (see MergeEncoder)."""
    import json

    tool = make()
    model = json.load(open(tool.path, encoding="utf-8"))["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    rank = {m: i for i, m in enumerate(merges)}
    singles = 512 if model["end_of_word_suffix"] else 256
    assert len(rank) == len(merges) == len(tool.order) - singles and len({a + b for a, b in merges}) == len(merges)
    for a, b in merges:
        entry = a + b
        end = bool(model["end_of_word_suffix"]) and entry.endswith("</w>")
        parts = list(entry.removesuffix("</w>")) if end else list(entry)
        if end:
            parts[-1] += "</w>"
        while len(parts) > 1:  # merging by the list
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), len(rank)))
            assert (parts[best], parts[best + 1]) in rank, entry
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        assert parts == [entry]


@pytest.mark.parametrize("make", [byte_bpe, word_bpe])
def test_safe_characters_are_read_alike(make):
    """Each character that the fast way takes, in the neighbourhoods that its class decides about."""
    from stylespark.llm.encoders import UNSAFE

    safe = [chr(c) for c in range(0x3000) if not UNSAFE(chr(c))]
    assert len(safe) > 700
    texts = [f"a{c}b 1{c}2 .{c}. {c} {c}{c}'s x{c.upper()}" for c in safe]
    tool = type(make())()
    for t, own, want in zip(texts, tool.encode(texts), tool.library_ids(texts), strict=True):
        assert own.tolist() == want, (t, hex(ord(t[1])))


def test_plan_packs_everything_gapless():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 2049, 3000), np.full(999, 700), np.zeros(0, int), rng.choice([1500, 548, 900, 1100, 48], 5000)):
        counts = np.bincount(lengths, minlength=2049)
        runs, total = packing.plan(counts)
        spots = defaultdict(list)
        for length, _, many, sequence, offset, per in runs.tolist():
            for w in range(many):
                spots[sequence + w // per].append((offset + w % per * length, length))
        assert len(spots) == total and Counter(x[1] for s in spots.values() for x in s) == Counter(lengths.tolist())
        for s in spots.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= 2048
        assert total <= max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum())) * 1.02 + 2 or len(set(lengths.tolist())) == 1


def test_packing_rows(docs):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    by, places = defaultdict(list), defaultdict(list)
    for r in packing.best_fit_packing(docs).collect():
        by[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for d in docs.collect():
        ids = np.array(tool.encode(d.text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for k, p in enumerate(sorted(by[d.doc_id], key=lambda p: p.piece)):
            assert (p.piece, p.start, p.ids_crc32) == (k, at, zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for s in places.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    manifest = frames.write_token_files(docs, file_bytes=60_000)
    assert manifest.count() > 3
    got, at = {r.doc_id: r for r in frames.read_token_files(manifest).collect()}, 0
    for d in docs.orderBy("doc_id").collect():
        ids = np.array(tool.encode(d.text or "", add_special_tokens=False).ids + [1], "<u4")
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    found = {r.doc_id: r.ids for r in frames.lookup(manifest, spark.createDataFrame([(3,), (77,), (10**9,)], "doc_id long")).collect()}
    assert set(found) == {3, 77} and len(found[3]) == got[3].n_tokens


def test_broken_frames_are_found(tmp_path):
    path = str(tmp_path / "x.zst")
    with frames.opened(path, "w") as out:
        w = frames.Writer(out)
        w.add(5, b"abcd" * 9)
        w.add(None, b"")
        size = w.close()
    with frames.opened(path, "r") as f:
        r = frames.Reader(f, size)
        assert r.keys == [5, None] and r.frame(0) == b"abcd" * 9 and r.frame(1) == b""
    data = bytearray(open(path, "rb").read())
    data[12] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception), frames.opened(path, "r") as f:  # noqa: B017
        frames.Reader(f, size).frame(0)


def test_pieces_round_trip(docs, odd):
    model = piece_bpe().model
    for rows in (docs, odd):
        want = Counter((r.doc_id, *(lambda ids: (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))(model.encode(r.text or "", add_eos=True))) for r in rows.collect())
        assert Counter(tuple(r) for r in pieces.piece_digests(rows).collect()) == want


def test_media():
    rng = np.random.default_rng(2)
    gray, rgb = rng.integers(0, 256, (7, 13), np.uint8), rng.integers(0, 256, (5, 9, 3), np.uint8)
    assert (media.decode(media.encode_netpbm(gray)) == gray).all()
    assert (media.decode(media.encode_bmp(gray)) == gray).all() and (media.decode(media.encode_bmp(rgb)) == rgb).all()
    assert media.decode(b"P1 # c\n2 2\n1 0\n01").tolist() == [[1, 0], [0, 1]] and media.decode(b"P4\n3 1\n\xa0").tolist() == [[1, 0, 1]]
    assert media.decode(b"P6\n1 1\n255\nabc").tolist() == [[[97, 98, 99]]]
    assert (media.decode(media.encode_netpbm(rgb)) == rgb).all()
    assert media.decode(b"P2 3 1 300 1 299 7").tolist() == [[1, 299, 7]] and media.decode(b"P3 1 1 255 9 8 7").tolist() == [[[9, 8, 7]]]
    assert media.decode(b"P5 2 1 65535 " + bytes([1, 2, 3, 4])).tolist() == [[258, 772]]
    with pytest.raises(ValueError):
        media.decode(b"P2 3 1 300 1 299")
    assert np.allclose(media.area_resize(gray, 1, 1), gray.mean()) and np.allclose(media.area_resize(gray, 7, 13), gray)


def _bmp(bits, palette, rows, width, top_down=False):
    import struct

    head = struct.pack("<IiiHHIIiiII", 40, width, -len(rows) if top_down else len(rows), 1, bits, 0, 0, 0, 0, len(palette), 0)
    table = b"".join(bytes([b, g, r, 0]) for r, g, b in palette)
    start = 14 + len(head) + len(table)
    body = b"".join(r + bytes(-len(r) % 4) for r in (rows if top_down else rows[::-1]))
    return struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start) + head + table + body


def test_bitmaps_of_few_bits():
    red, blue, black, white = (255, 0, 0), (0, 0, 255), (0, 0, 0), (255, 255, 255)
    for flip in (False, True):
        assert media.decode(_bmp(1, [black, white], [b"\xa0", b"\x40"], 3, flip)).tolist() == [[255, 0, 255], [0, 255, 0]]
        assert media.decode(_bmp(4, [red, blue, white], [b"\x01\x20"], 3, flip)).tolist() == [[list(red), list(blue), list(white)]]
        assert media.decode(_bmp(8, [red, blue], [b"\x01\x00", b"\x00\x00"], 2, flip)).tolist() == [[list(blue), list(red)], [list(red), list(red)]]
        assert media.decode(_bmp(32, [], [bytes([1, 2, 3, 0, 4, 5, 6, 0])], 2, flip)).tolist() == [[[3, 2, 1], [6, 5, 4]]]
    with pytest.raises(ValueError):
        media.decode(_bmp(16, [], [b"ab"], 1))


def brute_resize(gray, height, width):
    """Each cell's mean, sample by sample with the part of it that lies in the cell, in exact fractions."""
    from fractions import Fraction as Q

    def parts(n, cells):
        return [[max(Q(0), min(Q(n * (i + 1), cells), Q(k + 1)) - max(Q(n * i, cells), Q(k))) for k in range(n)] for i in range(cells)]

    ys, xs = parts(gray.shape[0], height), parts(gray.shape[1], width)
    whole = Q(gray.shape[0] * gray.shape[1], height * width)
    return [[sum(y * x * int(gray[i, j]) for i, y in enumerate(yy) if y for j, x in enumerate(xx) if x) / whole for xx in xs] for yy in ys]


def test_resize_and_hash_equal_brute_force():
    rng = np.random.default_rng(9)
    for shape in ((1, 64), (5, 7), (8, 9), (23, 31), (3, 2)):
        gray = rng.integers(0, 256, shape, np.uint8)
        for size in ((8, 9), (16, 16), (1, 3)):
            assert np.allclose(media.area_resize(gray, *size), np.array(brute_resize(gray, *size), float))
        small = brute_resize(gray, 8, 9)
        bits = "".join(str(int(round(256 * a) < round(256 * b))) for row in small for a, b in zip(row, row[1:], strict=False))
        assert media.difference_hash(gray) == f"{int(bits, 2):016x}"


def test_every_kind_of_image_is_stored(docs):
    got = media.media_columns(docs).collect()
    assert {r.media_kind for r in got} == {"P5", "BM"}
    by = defaultdict(set)
    text = {d.doc_id: d.text for d in docs.collect()}
    for r in got:
        by[text[r.doc_id]].add((r.media_bytes, r.media_sha256, r.feature, bytes(r.tile)))
    assert all(len(v) == 1 for v in by.values())


def test_media_rows(docs, odd):
    for rows in (docs, odd):
        got = defaultdict(list)
        for r in media.media_columns(rows).collect():
            got[r.doc_id].append(r)
        for d in rows.collect():
            raw = (d.text or "").encode()
            body = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            r = got[d.doc_id][0]
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))


def test_rules_counts(docs, odd, labels):
    for rows in (docs, odd):
        got = defaultdict(list)
        for r in rules.quality_rules(rows, labels).collect():
            got[r.doc_id].append(r)
        for d in rows.collect():
            t, r = d.text or "", got[d.doc_id][0]
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            seen, places = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set()
            for i in range(len(w) - 2):
                if seen[tuple(w[i : i + 3])] > 1:
                    places |= {i, i + 1, i + 2}
            own = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(own) - len(set(own)), len(places))
            assert want == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_binomial(spark):
    from math import comb

    from pyspark.sql import functions as F

    rows = [(k, n) for n in (1, 20, 300) for k in (0, 1, 5) if k <= n]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", rules.binomial_cdf(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(sum(comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1)))


def test_cutoffs_hold_their_risk(spark):
    """Good documents lie below 0.1; only junk lies above, so a tight cutoff is certified given enough labels, and none with few."""
    rows = [(i, "w " * 60 if i % 4 else "w# " * 60, "en") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("doc_id", "concat(text, doc_id, ' ', doc_id * 7 % 1000) text", "lang")
    d = d.selectExpr("doc_id", "concat_ws(' ', transform(sequence(1, 60), i -> concat(if(doc_id % 4 = 0, '#', ''), 'w', i * (doc_id + 1)))) text", "lang")
    labels = d.selectExpr("doc_id", "if(doc_id % 4 = 0, 0, 1) quality")
    got = rules.quality_rules(d, labels).selectExpr("doc_id % 4 = 0 bad", "kept", "cut_symbols").distinct().collect()
    assert {(r.bad, r.kept) for r in got} == {(True, False), (False, True)} and got[0].cut_symbols == 0.05
    few = rules.quality_rules(d, labels.where("doc_id < 40")).select("kept", "cut_symbols").distinct().collect()
    assert [(r.kept, r.cut_symbols) for r in few] == [(True, None)]


def test_lines(spark):
    rows = [(i, f"menu\nown {i}\nmenu", None, "s") for i in range(25)] + [(99, "menu\nx", None, None), (100, None, None, "s"), (101, "menu", None, "small")]
    got = {r.doc_id: r for r in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[3].text == "own 3" and (got[3].n_lines, got[3].n_dropped) == (3, 2)
    assert got[99].text == "menu\nx" and got[100].text is None and got[101].text == "menu"


def test_lines_of_sites_of_any_size(spark):
    """A site of five pages and one of two lose their menus; a line of copies alone stays."""
    rows = [(i, f"menu\nown {i}", "five") for i in range(5)] + [(10 + i, "menu\ncopied line", "five") for i in range(3)] + [(20 + i, f"top\nown {i}", "two") for i in range(2)]
    got = {r.doc_id: r.text for r in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: f"own {i}" for i in range(5)} | {10 + i: "copied line" for i in range(3)} | {20 + i: f"own {i}" for i in range(2)}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_lines_equal_their_sql(spark, sf, oracle):
    from stylespark.llm import queries

    where = f"/root/testdata/sf{sf}"
    got = queries.op4_line_dedup(spark, where).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert Counter(map(tuple, got)) == oracle(where, queries.ORACLE["op4_line_dedup"], "doc_id, text, n_lines, n_dropped")
    assert any(r.n_dropped for r in got)


def brute_kept(rows, good, alpha=rules.ALPHA, delta=rules.DELTA):
    """kept of each row (stratum, doc_id, ratios by rule, base_failed), by certificates computed with whole binomial sums."""
    from math import comb

    def cdf(k, n):
        return sum(comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1))

    def out(ratios, level):
        return any(ratios[r] > c for r, c in rules.STEPS[:level])

    strata = {s for s, i, _, failed in rows if i in good and not failed}
    levels = {}
    for s in strata:
        own = [x for t, i, x, failed in rows if t == s and i in good and not failed]
        levels[s] = 0
        while levels[s] < len(rules.STEPS) and cdf(sum(out(x, levels[s] + 1) for x in own), len(own)) <= delta / len(strata):
            levels[s] += 1
    return [(i, not failed and not out(x, levels.get(s, 0))) for s, i, x, failed in rows], levels


def _ratios(r):
    part = lambda a, b: a / b if b else 0.0
    return {"symbols": part(r.n_symbols, r.word_chars), "dup_lines": part(r.n_dup_lines, r.n_lines), "repeats": part(r.n_repeat_words, r.n_words)}


@pytest.mark.parametrize(("sf", "certified"), [("0.01", {"en"}), ("0.1", {"en", "de", "fr", "es"})])
def test_rules_equal_brute_force_certificates(spark, sf, certified):
    d, y = (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = rules.quality_rules(d, y).collect()
    good = {r.doc_id for r in y.where("quality = 1").collect()}
    want, levels = brute_kept([(r.stratum, r.doc_id, _ratios(r), r.base_failed) for r in got], good)
    assert Counter((r.doc_id, r.kept) for r in got) == Counter(want)
    assert certified <= {s for s, n in levels.items() if n > 0}


def test_rules_keep_their_promise_on_rows_not_used(spark):
    """Cutoffs from one half of the labels reject at most ALPHA of the other half's good documents, in every stratum."""
    d, y = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    own, rest = y.where("crc32(cast(doc_id as string)) % 2 = 0"), y.where("crc32(cast(doc_id as string)) % 2 = 1 and quality = 1")
    got = rules.quality_rules(d, own).where("not base_failed").join(rest, "doc_id").groupBy("stratum").agg({"*": "count"}).collect()
    lost = Counter(r.stratum for r in rules.quality_rules(d, own).where("not base_failed and not kept").join(rest, "doc_id").collect())
    assert len(got) >= 4 and {r.stratum for r in got} >= {'en', 'de', 'fr', 'es'} and all(lost[r.stratum] <= rules.ALPHA * r["count(1)"] for r in got)


def brute_components(rows, shingle=4, percent=85):
    sets, least = {}, {}
    for k, t in rows:
        w = (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
        sets[k] = {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])):
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys} | least


def test_jaccard_components(spark, docs):
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(150):  # near copies of one text at all distances, and chains
        w = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 9)):
            w[p] = f"x{rng.integers(0, 40)}"
        rows.append((k, " ".join(w)))
    rows += [(200 + k, " ".join(f"c{i}" for i in range(k * 3, k * 3 + 100))) for k in range(20)] + [(300, "a b"), (301, "A B"), (302, "a b c"), (303, ""), (304, None)]
    rows += [(1000 + r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_components(rows)


def test_jaccard_filter_grows_with_the_sets(spark, monkeypatch):
    """Filters of all sizes let the same links through; the size follows the number of sets."""
    assert [jaccard.filter_bits(n) for n in (0, 1, 1 << 20, (1 << 20) + 1, 1 << 40)] == [1 << 24, 1 << 24, 1 << 24, 1 << 25, 1 << 30]
    rows = [(k, " ".join(f"w{k // 4}x{j}" for j in range(60)) + f" tail{k}") for k in range(80)]
    want = brute_components(rows)
    for least in (1 << 19, 1 << 25):
        monkeypatch.setattr(jaccard, "LEAST_FILTER", least)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == want


def test_jaccard_long_lists_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST", 8)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        w = [f"b{i}" for i in range(80)]
        for p in rng.integers(0, 80, rng.integers(0, 6)):
            w[p] = f"x{rng.integers(0, 30)}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_jaccard_compares_few_pairs_of_near_copies_that_miss(spark, monkeypatch):
    """Many near copies of one text, most of which reach the threshold with the text but not with each other: few pairs are compared, no link is lost."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(400):
        w = [f"b{i}" for i in range(150)]
        for p in rng.integers(0, 150, rng.integers(2, 7)):
            w[p] = f"x{rng.integers(0, 10_000)}"
        rows.append((k, " ".join(w)))
    compared, plain = [], jaccard.overlaps
    monkeypatch.setattr(jaccard, "overlaps", lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    assert sum(compared) < 10 * len(rows), compared


def test_jaccard_bounds_hold():
    """Sketches never bound sets below what they share; a set whose counts don't fit has none and no bound."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)) for n in (1, 50, 600, 20_000, 200_000)]
    sets += [np.unique(np.concatenate((s[::2], sets[1]))) for s in sets]
    sketches = np.array([jaccard.sketch(s) for s in sets], object)
    u, v = np.triu_indices(len(sets))
    most = jaccard.bounds(sketches, u, v)
    shared = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(u, v, strict=True)])
    assert (most >= shared).all() and sketches[4] is None and (most[(u == v) & (u < 4)] == [len(s) for s in sets[:4]]).all()


def spelled(template, fill, keep, choice=0):
    """A text of the template: regions that may be left out are kept or not, each name is `fill`, as far as it may be that long; of alternatives the first or last stands."""
    import re as _re

    out, depth, branch = [], [], []
    marks = licenses.MARKUP.findall(template)
    for at, (mark, word) in enumerate(marks):
        if mark == "optional":
            depth.append(keep)
        elif mark == "/optional":
            depth.pop()
        elif mark == "either":
            level, last = 0, 0
            for m, _ in marks[at:]:
                level += (m == "either") - (m == "/either")
                last += m == "or" and level == 1
                if not level:
                    break
            branch.append([0, last if choice else 0])
            depth.append(branch[-1][0] == branch[-1][1])
        elif mark == "or":
            branch[-1][0] += 1
            depth[-1] = branch[-1][0] == branch[-1][1]
        elif mark == "/either":
            branch.pop()
            depth.pop()
        elif all(depth):
            out.append(word if word else " ".join(fill.split()[: int(_re.sub(r"\D", "", mark))]))
    return " ".join(" ".join(out).split())


def brute_labels(text):
    """Labels by regular expressions over words, one per template, and by counting phrases word by word."""
    own = [w.decode() for w in licenses.words(text)]
    run = " " + " ".join(own) + " "
    labels, places = set(), []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(own) - len(p) + 1) if own[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    base = set(labels)
    for label, template in licenses.TEMPLATES.items():
        pattern = ""
        for mark, word in licenses.MARKUP.findall(template):
            pattern += f"{word} " if word else {"optional": "(?:", "/optional": ")?", "either": "(?:", "or": "|", "/either": ")"}.get(mark) or rf"(?:\S+ ){{0,{mark[4:]}}}"
        if re.search(f" {pattern}", run):
            labels.add(label)
    return len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels))


def test_license_labels_equal_brute_force(docs, odd):
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    extra = [(9000 + i, f"x {spelled(t, 'A B C', i % 2 == 0)} y CC-BY") for i, t in enumerate(licenses.TEMPLATES.values())]
    rows = rows.unionByName(rows.sparkSession.createDataFrame(extra, "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.license_scan(rows).collect())
    assert got == Counter((r.doc_id, *brute_labels(r.text)) for r in rows.collect())


def test_licenses():
    s = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    got = s.scan("Copyright (c) 2020 Foo. ALL Rights reserved. cc-by cc by")
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == (11, 3, 4, 9, "cc-by,reserved")
    assert "copyright-line" in got["labels"].split(",") and s.scan(None)["labels"] == "" and s.scan("")["score"] == 0
    for label, template in licenses.TEMPLATES.items():  # whole texts, with and without what may vary
        fixed = licenses.Automaton.mandatory(template)
        assert sum(map(len, fixed)) >= 4
        for fill, keep, choice in (("Foo Bar", True, 0), ("", True, 1), ("Foo", False, 1), ("", False, 0)):
            text = spelled(template, fill, keep, choice)
            assert label in s.scan(f"before. {text.upper()}; after")["labels"].split(","), (label, text)


@pytest.mark.parametrize("label", sorted(licenses.TEMPLATES))
def test_any_changed_mandatory_word_rejects(label):
    """Every word of the shortest text is mandatory: another word in its place, or none, and the template doesn't match."""
    s = licenses.Scanner({}, {label: licenses.TEMPLATES[label]})
    own = spelled(licenses.TEMPLATES[label], "", False).split()
    assert s.scan(" ".join(own))["labels"] == label
    for k in range(len(own)):
        for changed in ([*own[:k], "zzz", *own[k + 1 :]], [*own[:k], *own[k + 1 :]]):
            assert s.scan(" ".join(changed))["labels"] == "", (label, k, own[k])


def test_variants_have_labels_of_their_own():
    s = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    only = lambda text, kind: [x for x in s.scan(text)["labels"].split(",") if x.startswith(kind)]
    for label in ("bsd-2-clause", "bsd-3-clause", "bsd-4-clause"):
        assert only(spelled(licenses.TEMPLATES[label], "the owner", True), "bsd") == [label]
    assert only("Licensed under CC BY-NC 4.0.", "cc-by-") == ["cc-by-nc-4.0-notice"]
    assert only("This work is licensed under the GNU General Public License, version 3.", "gpl-") == ["gpl-3.0-notice"]
    assert only("Licensed under the GNU Lesser General Public License v2.1 or later", "lgpl") == ["lgpl-2.1-notice"]
    a = licenses.Automaton("x <<either>>a<<or>>b c<<or>><<optional>>d<</optional>> e<</either>> y")
    for text, ok in (("x a y", True), ("x b c y", True), ("x d e y", True), ("x e y", True), ("x y", False), ("x b y", False), ("x a e y", False), ("x d y", False)):
        assert (a.longest(text.encode().split(), 0) == len(text.split())) == ok, text


def test_license_regions():
    a = licenses.Automaton("x <<optional>>y<</optional>> <<var 2>> z")
    for text, ok in (("x z", True), ("x y z", True), ("x q r z", True), ("x y q r z", True), ("x q r s z", False), ("y z", False)):
        assert (a.longest(text.encode().split(), 0) == len(text.split())) == ok, text


def test_language(docs, spark):
    got = {r.doc_id: r for r in language.language_id(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    held = [r for r in got.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.97 and all(0 <= r.score <= 1 for r in got.values())


def test_language_und(odd):
    got = {r.doc_id: r.lang_pred for r in language.language_id(odd).collect()}
    assert got[4] == got[5] == got[8] == got[9] == "und" and got[1] != "und"


def test_quality(spark):
    d, y = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.quality_scores(d, y).join(y, "doc_id").select("quality", "kept").collect()
    assert np.mean([r.kept for r in got if r.quality == 1]) >= 0.985
    assert np.mean([r.kept for r in got if r.quality == 0]) <= 0.1


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        before = {r.doc_id: r for r in d.collect()}
        d = stage(spark, d, SF)
        assert d.columns == p.COLUMNS
        after = d.collect()
        assert {r.doc_id for r in after} <= set(before) and len(after) >= 0.5 * len(before)
        if name == "ngram_jaccard_join":
            want = {k for k, (_, c) in brute_components([(r.doc_id, r.text) for r in before.values()], 5, 80).items() if k == c}
            assert {r.doc_id for r in after} == want
        d = spark.createDataFrame(after, d.schema)
    assert {r.doc_id for r in p.STAGES[-1][1](spark, d, SF).collect()} == {r.doc_id for r in after}


def test_quality_on_labels_not_used(spark):
    """Labels of one document in five are kept from training; the classifier tells them apart all the same."""
    d, y = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = "crc32(cast(doc_id as string)) % 5 = 0"
    got = quality.quality_scores(d, y.where(f"not ({held})")).join(y.where(held), "doc_id").select("quality", "kept").collect()
    assert np.mean([r.kept for r in got if r.quality == 1]) >= 0.98
    assert np.mean([r.kept == (r.quality == 1) for r in got]) >= 0.95


def test_quality_samples_one_row_of_a_repeated_id(spark, monkeypatch):
    good, bad = "a plain line of quiet words about the sea", "$$$ ### buy buy buy now"
    rows = [(i, f"{good} {i}" if i % 2 else f"{bad} {i}", "s", "en", 40) for i in range(400)] + [(1, f"{good} 1", "s", "en", 40)] * 3000
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    seen = []
    monkeypatch.setattr(quality, "co_train", lambda text, *rest: seen.append(len(text)))
    quality.train(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) quality").distinct())
    assert seen == [400]


def test_language_equals_brute_force_kernels():
    """Scores from hashed presence and one matrix product against plain sets of n-grams, Nystroem features and ridge regression."""
    rng = np.random.default_rng(12)
    stocks = {v: ["".join(rng.choice(list(letters), rng.integers(3, 8))) for _ in range(40)] for v, letters in (("x", "abcdefg"), ("y", "efghijkl"), ("z", "aeioumnp"))}
    make = lambda v: " ".join(rng.choice(stocks[v], 12))
    names = [v for _ in range(20) for v in "xyz"]
    texts = [make(v) for v in names]
    own = [make(v) for v in "xyz" * 10]
    found, matrix = language.fit(language.Packed(list(language.Packed.of(texts))), names)

    def grams(t):
        b = b" " + t.encode() + b" "
        return {b[i : i + n] for n in language.N for i in range(len(b) - n + 1)}

    kernel = lambda a, b: np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])
    sets = list(map(grams, texts))
    k = kernel(sets, sets)  # all are landmarks, so Nystroem is exact
    values, vectors = np.linalg.eigh(k)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = k @ root
    target = 2.0 * (np.array(names)[:, None] == np.array(found)) - 1
    weights = np.linalg.solve(phi.T @ phi + language.RIDGE * len(names) * np.eye(phi.shape[1]), phi.T @ target)
    want = kernel(list(map(grams, own)), sets) @ root @ weights
    rows = language.presence(own)
    got = rows.astype(float) @ matrix / np.sqrt(np.count_nonzero(rows, axis=1))[:, None]
    assert found == ["x", "y", "z"] and np.abs(got - want).max() < 0.05 and (got.argmax(1) == want.argmax(1)).all()


def test_long_texts_keep_their_language_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    text = " ".join(r.text for r in docs.where("lang = 'de' and n_chars > 200").orderBy("doc_id").limit(400).collect())
    assert len(text) > 300_000
    (short, a), (long, b) = language.scores([text[:5000], text], *model)
    assert short == long == "de" and b > a - 0.05


def test_every_pipeline_stage_takes_odd_rows(spark, odd, none):
    """Nulls in any column, empty, very long, repeated and tied rows, clashing names, empty tables: rows of documents go in and come out."""
    import corpus_pipeline as p

    before = Counter((r.doc_id, r.text) for r in odd.collect())
    for name, stage in p.STAGES:
        got = stage(spark, odd, SF)
        assert stage(spark, none, SF).count() == 0
        if name == "best_fit_packing":
            assert {r.doc_id for r in got.collect()} == {k for k, _ in before}
            continue
        assert got.columns == p.COLUMNS
        rows = got.collect()
        after = Counter((r.doc_id, r.text) for r in rows)
        if name == "line_dedup":
            assert Counter(r.doc_id for r in rows) == Counter(k for k, _ in before.elements())
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        else:
            assert not after - before
        if name == "language_id":
            assert {k for k, _ in after} >= {1, 2, 3} and not {k for k, _ in after} & {4, 5, 8, 9}
        if name == "ngram_jaccard_join":
            near = " ".join(f"n{i}" for i in range(100))
            assert sum(n for (_, t), n in after.items() if t and t.startswith(near)) == 1 and after[(4, None)] == after[(5, "")] == 1


def test_large_tables_take_the_other_way(spark, docs, labels, monkeypatch):
    """Boilerplate lists and cutoffs that are too large to broadcast whole: the same rows."""
    from stylespark import runtime

    key = lambda rows: Counter(map(repr, rows.collect()))
    known = docs.selectExpr("doc_id", "1 quality")
    one = key(lines.drop_boilerplate(docs)), key(rules.quality_rules(docs, known).select("doc_id", "kept", "level", "n_words"))
    for module, name, value in ((lines, "MOST_LINES", 0), (lines, "HOT_SITES", 10), (rules, "MOST_STRATA", 0), (runtime, "MOST_HOT", 10), (runtime, "COLD", 12)):
        monkeypatch.setattr(module, name, value)
    assert (key(lines.drop_boilerplate(docs)), key(rules.quality_rules(docs, known).select("doc_id", "kept", "level", "n_words"))) == one


def test_repeated_ids_are_found_in_all_their_files(spark):
    rows = [(i // 300, f"words of row {i} " * 20) for i in range(1200)] + [(None, "none")]
    manifest = frames.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), file_bytes=20_000)
    assert manifest.count() > 8
    got = Counter(r.doc_id for r in frames.lookup(manifest, spark.createDataFrame([(0,), (3,), (9,)], "doc_id long")).collect())
    assert got == {0: 300, 3: 300}
    starts = sorted((r.start, r.n_tokens) for r in frames.read_token_files(manifest).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and len(starts) == 1201
