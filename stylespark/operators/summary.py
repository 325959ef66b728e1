"""Style of texts as a summary that merges: the summary of two texts joined by a line feed comes from theirs.

Words, marks and contractions can't cross a line feed and add up. A sentence can: a summary holds what is open at both ends, the part before its
first sentence end and the part after its last, and counts, sums and sums of squares of the sentences between. Sliding windows can: it holds its first and
last WINDOW - 1 words and how many windows inside have so many distinct words. So a group of any number of texts is folded in order by a tree: each task
folds its own range of neighbours, and a group's few partial summaries, one a task, are folded again.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import accumulate, islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stylespark.functions.numbers import round_binary
from stylespark.functions.text import CONTRACTION, EMOJI, WORD
from stylespark.runtime import settled, ship

# Words of a window; marks that are counted, as plain strings.
WINDOW = 50
MARKS = {"em_dash": ("—", "--"), "comma": (",",), "period": (".",), "exclamation": ("!",), "question": ("?",), "semicolon": (";",), "colon": (":",), "ellipsis": ("...", "…")}

_words = re.compile(WORD).findall
_ends = re.compile("[.!?]+").split
_contractions = re.compile(CONTRACTION).findall
_emoji = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), EMOJI)).findall


class Part(NamedTuple):
    """A sentence or a piece of one: its words, whether it has more than white space, whether that begins in lower case."""

    words: int = 0
    some: bool = False
    low: bool = False

    def __add__(self, other: Part) -> Part:  # the pieces are neighbours
        return Part(self.words + other.words, self.some or other.some, self.low if self.some else other.low)


class Summary(NamedTuple):
    """What a stretch of text gives; closed: it holds a sentence end, else head is all of it."""

    texts: int
    words: int
    closed: bool
    head: Part
    tail: Part
    sentences: int
    lows: int
    lengths: int
    length_sum: int
    length_squares: int
    first: list[str]
    last: list[str]
    windows: list[int]
    marks: list[int]
    contractions: int
    emoji: int


FIELDS = (
    "texts long, words long, closed boolean, head_words long, head_some boolean, head_low boolean, tail_words long, tail_some boolean, tail_low boolean, sentences long, lows long, "
    "lengths long, length_sum long, length_squares long, first array<string>, last array<string>, windows array<long>, marks array<long>, contractions long, emoji long, distinct long, shares double"
)
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def distinct_in_windows(words: list[str], window: int = WINDOW) -> list[int]:
    """How many windows have 0, 1, ... `window` distinct words; empty without a whole window. A word counts in the windows that it stands in first: from behind its last occurrence on."""
    many, last = len(words) - window + 1, {}
    if many <= 0:
        return []
    steps = [0] * (many + 1)
    for i, w in enumerate(words):
        start, end = max(0, i - window + 1, last.get(w, -1) + 1), min(i, many - 1)
        if start <= end:
            steps[start] += 1
            steps[end + 1] -= 1
        last[w] = i
    counts = Counter(islice(accumulate(steps), many))
    return [counts[k] for k in range(window + 1)]


def _added(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b, strict=True)] if a and b else a or b


#: The doubles nearest to k / WINDOW, as multiples of 2 ** -60.
SHARES = [int(Fraction(k / WINDOW) * (1 << 60)) for k in range(WINDOW + 1)]


def _window_sums(windows: list[int]) -> tuple[int, float]:
    """The distinct words of all windows, and the sum of the windows' shares of distinct words as doubles, rounded once."""
    return sum(k * n for k, n in enumerate(windows)), sum(n * s for n, s in zip(windows, SHARES, strict=True)) / (1 << 60) if windows else 0.0


def _closed(parts: Iterable[Part]) -> tuple[int, int, int, int, int]:
    some = lows = lengths = total = squares = 0
    for p in parts:
        some, lows = some + p.some, lows + p.low
        lengths, total, squares = lengths + (p.words > 0), total + p.words, squares + p.words * p.words
    return some, lows, lengths, total, squares


def summary(text: str) -> tuple[Summary, list[str]]:
    """A text's summary and its words in lower case."""
    words: list[str] = []
    parts = []
    for piece in _ends(text):
        own, bare = _words(piece), piece.strip()
        words += own
        parts.append(Part(len(own), bool(bare), bare[:1].islower()))
    words = [w.lower() for w in words]
    keep = WINDOW - 1
    marks = [sum(map(text.count, m)) for m in MARKS.values()]
    return Summary(1, len(words), len(parts) > 1, parts[0], parts[-1], *_closed(parts[1:-1]), words[:keep], words[-keep:], distinct_in_windows(words), marks, len(_contractions(text)), len(_emoji(text))), words


def merged(a: Summary, b: Summary) -> Summary:
    """The summary of a's text, a line feed and b's text."""
    between: list[Part] = []
    if a.closed and b.closed:
        head, tail, between = a.head, b.tail, [a.tail + b.head]
    elif a.closed:
        head, tail = a.head, a.tail + b.head
    else:
        head, tail = a.head + b.head, b.tail
    sums = [x + y + z for x, y, z in zip(a[5:10], b[5:10], _closed(between), strict=True)]
    keep = WINDOW - 1
    first = (a.first + b.first)[:keep] if a.words < keep else a.first
    last = (a.last + b.last)[-keep:] if b.words < keep else b.last
    windows = _added(_added(a.windows, b.windows), distinct_in_windows(a.last + b.first))
    return Summary(a.texts + b.texts, a.words + b.words, a.closed or b.closed, head, tail, *sums, first, last, windows, _added(a.marks, b.marks), a.contractions + b.contractions, a.emoji + b.emoji)


def _flat(s: Summary) -> tuple:
    return (*s[:3], *s.head, *s.tail, *s[5:], *_window_sums(s.windows))


def _deep(v: tuple) -> Summary:
    return Summary(*v[:3], Part(*v[3:6]), Part(*v[6:9]), *v[9:-2])


def top_runs(words: list[str], top: int, least: int) -> list[str]:
    """The most repeated two- and three-word runs, ties by text."""
    counted = Counter(" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1))
    return [g for g, _ in sorted(((g, n) for g, n in counted.items() if n >= least), key=lambda x: (-x[1], x[0]))[:top]]


def summaries(docs: DataFrame, keep: list[str], text: str = "text", grams: tuple[int, int] | None = None) -> DataFrame:
    """The columns `keep`, and the summary of each text (null: empty); with grams (top, least) also signature_ngrams, those of the text alone."""
    ship(docs.sparkSession)
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL(FIELDS + (", signature_ngrams array<string>" if grams else "")).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for t in batch.column(len(keep)).to_pylist():
                s, words = summary(t)
                out.append(_flat(s) + ((top_runs(words, *grams),) if grams else ()))
            columns = list(zip(*out, strict=True)) or [()] * (len(own) - len(keep))
            made = [pa.array(c, f.type) for c, f in zip(columns, list(own)[len(keep) :], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=own.names)

    return rows.mapInArrow(run, schema)


def _neighbours(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each stretch of rows of the same keys within a task: keys and the merged summary."""
    schema = T.StructType([*rows.select(*keys).schema.fields, *T.StructType.fromDDL(FIELDS).fields])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = to_arrow_schema(schema)

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, own, strict=True)], names=own.names)

        key, now, done = None, None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is not None and row[:n] == key:
                    now = merged(now, _deep(row[n:]))
                    continue
                if now is not None:
                    done.append((*key, *_flat(now)))
                    if len(done) == 500:
                        yield batch_of(done)
                        done = []
                key, now = row[:n], _deep(row[n:])
        if now is not None:
            yield batch_of([*done, (*key, *_flat(now))])

    return rows.select(*keys, *NAMES).mapInArrow(run, schema)


def folded(docs: DataFrame, keys: list[str], order: str, text: str = "text", parts: int | None = None) -> DataFrame:
    """keys and the summary of each group's texts, joined by line feeds in order (ties by a hash of the text).

    Rows are summaries from the first step on, of about a kilobyte, and dealt by ranges of (keys, order), so that a group of any size spreads over
    all tasks; the second step gets at most one row of a group from each of them. Null keys are groups of their own. parts: tasks."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(order).alias("_order"), F.xxhash64(text).alias("_tie"), F.col(text).alias("_own"))
    own = [f"_k{i}" for i in range(len(keys))]
    each = settled(summaries(named, [*own, "_order", "_tie"], "_own"), "summaries")
    sorted_ = each.repartitionByRange(parts, *own, "_order", "_tie").sortWithinPartitions(*own, "_order", "_tie").withColumn("_part", F.spark_partition_id())
    some = settled(_neighbours(sorted_, [*own, "_part"]), "partial")
    whole = _neighbours(some.repartition(parts, *own).sortWithinPartitions(*own, "_part"), own)
    return whole.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], *NAMES)


def share(top: Column, bottom: Column) -> Column:
    """top / bottom as the nearest double, 0 where bottom is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom.cast("double"))


def sentence_columns() -> dict[str, Column]:
    """Counts and means of a summary's sentences; what is open at its ends counts as sentences."""
    c = F.col
    tail = lambda x: F.when(c("closed"), x).otherwise(F.lit(0))
    one = lambda x: x.cast("long")
    total = c("sentences") + one(c("head_some")) + tail(one(c("tail_some")))
    lows = c("lows") + one(c("head_low")) + tail(one(c("tail_low")))
    n = c("lengths") + one(c("head_words") > 0) + tail(one(c("tail_words") > 0))
    s = c("length_sum") + c("head_words") + tail(c("tail_words"))
    squares = c("length_squares") + c("head_words") * c("head_words") + tail(c("tail_words") * c("tail_words"))
    # Around the whole part of the mean, so that no product grows with the square of the group: n D - r r over n n.
    safe = F.greatest(n, F.lit(1))
    q = F.floor(s / safe)
    wide = lambda x: x.cast("decimal(18,0)")
    rest, spread = s - q * safe, squares - 2 * q * s + safe * q * q
    top, bottom = wide(safe) * wide(spread) - wide(rest) * wide(rest), wide(safe) * wide(safe)
    return {"n_sentences": n, "sentence_len_mean": share(s, n), "sentence_len_variance": F.when(n < 2, F.lit(0.0)).otherwise(share(top, bottom)), "lowercase_start_rate": share(lows, total), "has_sentences": total > 0}


#: Decimal digits of the targets.
DIGITS = {"sentence_len_mean": 3, "sentence_len_variance": 3, "mattr": 4, "contraction_rate": 5, "emoji_rate": 5, "lowercase_start_rate": 4}


def targets(rows: DataFrame, keep: list[str], rounded: bool = True) -> DataFrame:
    """The columns `keep` and the style targets of each summary, unrounded, or rounded as Python rounds; then mattr is the mean of the windows' shares as doubles."""
    c = F.col
    words = F.greatest(c("words"), F.lit(1))
    inside = c("words") - (WINDOW - 1)
    windows = c("shares") / inside if rounded else share(c("distinct"), WINDOW * inside)
    mattr = F.when(c("words") < WINDOW, share(F.size(F.array_distinct("first")), c("words"))).otherwise(windows)
    got = {k: v for k, v in sentence_columns().items() if k in DIGITS} | {"mattr": mattr, "contraction_rate": share(c("contractions"), words), "emoji_rate": share(c("emoji"), words)}
    shown = lambda x, d: round_binary(x, d) if rounded else x
    marks = F.create_map(*[x for i, k in enumerate(MARKS) for x in (F.lit(k), shown(share(c("marks")[i], words), 5))])
    return rows.select(*keep, *[shown(got[k], d).alias(k) for k, d in DIGITS.items()], marks.alias("punctuation_profile"), words.cast("int").alias("word_count"), c("texts").alias("sample_count"))
