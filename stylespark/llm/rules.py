"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each document gets counts (words, symbols, repeated lines, repeated three-word windows). The method adds one ladder of
cutoffs: every step tightens one rule, in turn, and keeps what the steps before it reject, so that a step stands for all rules together.
In each stratum a step is certified while an exact binomial test on the labelled good documents of the stratum rejects
"the rules of this step reject more than ALPHA of the good documents" at level DELTA / strata. The ladder is a fixed sequence, which
needs no correction for its steps as it ends at the first step that isn't certified; Bonferroni's correction covers the strata. Cutoffs
are fixed values that no label has shaped, so all labelled rows are the holdout. With probability 1 - DELTA at least, no stratum loses more than
ALPHA of its good documents to the rules; where not even the first step is certified the rules reject nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylespark.llm.common import looked_up, prepared, quoted, written

#: Share of good documents that all rules together may reject in a stratum, and the chance that it is exceeded anywhere.
ALPHA, DELTA = 0.03, 0.05
#: Rules: a ratio of counts that should be small, and its grid from loose to tight.
RULES = {
    "symbols": ("n_symbols", "word_chars", (0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "repeats": ("n_repeat_words", "n_words", (0.9, 0.7, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2)),
}
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: The ladder: (rule, cutoff) step by step.
STEPS = [(rule, grid[i]) for i in range(8) for rule, (_, _, grid) in RULES.items()]
#: A table of cutoffs of at most this many strata is broadcast; of a larger one those of hot strata, the others are joined by shuffling.
MOST_STRATA = 10_000


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Words: maximal runs of characters other than space and U+0009 to U+000D."""
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words within three-word windows that occur twice or more. Windows are compared by their 64-bit hashes, sorted
    so that equal ones are neighbours; places covered by repeated windows count once."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))

    def repeated(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda a, b: s[a]["h"] == s[b]["h"]
        return F.transform(
            F.filter(F.sequence(F.lit(0), last), lambda k: F.when(k > 0, same(k - 1, k)).otherwise(F.lit(False)) | F.when(k < last, same(k, k + 1)).otherwise(F.lit(False))),
            lambda k: s[k]["i"],
        )

    def covered(starts: Column) -> Column:
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n"), i.alias("at"))
        return F.when(F.size(starts) == 0, F.lit(0)).otherwise(F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), step)["n"])

    # Each place i adds the part of [i, i + 3) that the place before it did not cover.
    many = let(F.sort_array(windows(words)), lambda s: let(F.sort_array(repeated(s)), covered))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(many)


def counts(text: Column) -> Column:
    """A struct of the base counts of a text (null: no words)."""
    t = F.coalesce(text, F.lit(""))

    def of(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = let(F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != ""), of)
    words = let(tokens(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    return F.struct(
        words.alias("w"),
        lines.alias("l"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )


def base(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum ("=" and its name, so that the null one, "", is its own) and the counts of every document."""
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(quoted(stratum)).cast("string")), F.lit("")).alias("stratum"), counts(F.col(quoted(text)).cast("string")).alias("c"))
    got = rows.select("doc_id", "stratum", "c.w.n_words", "c.word_chars", "c.n_symbols", "c.l.n_lines", "c.l.n_dup_lines", "c.w.n_repeat_words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return got.withColumn("base_failed", failed)


def ratio(rule: str) -> Column:
    top, bottom, _ = RULES[rule]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of Binomial(n, p), summed term by term in logs; exact but for rounding."""
    step = lambda acc, i: let(
        acc["log"] + F.log((n - i + 1).cast("double") / i.cast("double") * F.lit(p / (1 - p))), lambda v: F.struct(v.alias("log"), (acc["sum"] + F.exp(v)).alias("sum"))
    )
    first = n.cast("double") * F.log(F.lit(1.0 - p))
    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.struct(first.alias("log"), F.exp(first).alias("sum")), step)["sum"]


def first_step(steps: list[tuple[str, float]] = STEPS) -> Column:
    """The first step that rejects the row; null if none does."""
    chains = []
    for rule in dict.fromkeys(r for r, _ in steps):
        own = [(j, cut) for j, (r, cut) in enumerate(steps) if r == rule]
        chain = F.when(ratio(rule) > own[0][1], own[0][0])
        for j, cut in own[1:]:
            chain = chain.when(ratio(rule) > cut, j)
        chains.append(chain)
    return F.least(*chains) if len(chains) > 1 else chains[0]  # nulls are skipped


def cutoffs(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, n_good, level (how many steps are certified) and each rule's cutoff (null: none), from base rows and labels (doc_id, quality)."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    good = rows.where(~F.col("base_failed")).withColumn("step", first_step()).join(known, "doc_id", "left_semi")
    rejected = F.array(*[F.sum(F.when(F.col("step") <= j, 1).otherwise(0)) for j in range(len(STEPS))])
    wide = good.groupBy("stratum").agg(F.count("*").alias("n_good"), rejected.alias("k"))
    n_tests = wide.agg(F.count("*").alias("strata"))
    level = F.lit(delta) / F.col("strata")
    # A step beyond ALPHA as it stands can't be certified; its sum is left out.
    ok = F.transform("k", lambda k: F.when(k >= F.col("n_good") * alpha, F.lit(False)).otherwise(binomial_cdf(k, F.col("n_good"), alpha) <= level))
    stop = F.array_position(ok, F.lit(False))
    found = wide.crossJoin(n_tests).select("stratum", "n_good", F.when(stop == 0, len(STEPS)).otherwise(stop - 1).cast("int").alias("level"))  # n_tests is one row
    cut = lambda rule: F.array_min(F.filter(F.array(*[F.when(F.col("level") > j, F.lit(c)) for j, (r, c) in enumerate(STEPS) if r == rule]), lambda c: c.isNotNull()))
    return found.select("stratum", "n_good", "level", *[cut(r).alias(f"cut_{r}") for r in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document: counts, base_failed, kept, and its stratum's n_good, level and cutoffs.

    Null or empty texts have no words and fail the base. A null stratum is a stratum of its own, apart from an empty one; strata without
    labels get no cutoffs. A doc_id with several labels counts as good only if all are 1. Ties with a
    cutoff are kept. Repeated rows and null ids are kept; very long texts are taken whole. An empty table gives no
    rows, and without labels the base alone decides. Further columns of docs are ignored.
    """
    prepared(docs.sparkSession)
    rows = written(base(docs, doc_id, text, stratum), "rule-counts")
    found = written(cutoffs(rows, labels, alpha, delta), "cutoffs")
    rejects = F.coalesce(first_step() < F.col("level"), F.lit(False))
    if found.count() <= MOST_STRATA:
        judged = rows.join(F.broadcast(found), "stratum", "left")
    else:
        judged = looked_up(rows, "stratum", found.join(rows.groupBy("stratum").agg(F.count("*").alias("many")), "stratum"))
    return judged.withColumn("kept", ~F.col("base_failed") & ~rejects).withColumn("stratum", F.when(F.col("stratum") != "", F.substr("stratum", F.lit(2))))
