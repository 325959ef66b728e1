"""Finding and repairing formulaic phrasing, guarded by a check that nothing of substance is lost.

Detection, the punctuation pass, the meaning guard and the verdict are columns; replacements that keep a
match's capital need a function per match, so each pass of them maps Arrow batches.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylespark.functions.text import WS, let
from stylespark.functions.vectors import cosine
from stylespark.operators.tells import PUNCT, REGISTRY_VERSION, SCAFFOLD, STEMS, STOCK, TELLS, WORD_, compiled, tells_for
from stylespark.runtime import with_text

# Fixed values.
EM_DASH_RATE = {"email": 1.0, "longform": 1.5}
LEAST_SIMILARITY = 0.92
PASSES = {"lenient": ("lexical", "rhetorical"), "standard": ("lexical", "rhetorical", "punctuation"), "strict": ("lexical", "rhetorical", "rhythm", "punctuation")}
CATEGORIES = {"lexical": (WORD_,), "rhetorical": (SCAFFOLD, STOCK)}
KEPT = {
    "number": r"\d[\d.,]*\d|\d",
    "url": r"(?i)https?://[^\s)]+",
    "email": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+",
    "entity": r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+(?![A-Za-z0-9_])",
}
_KEPT = {label: re.compile(pattern.replace(r"\s+", f"{WS}+").replace(r"[^\s)]", f"[^){WS[1:-1]}]"), re.ASCII).findall for label, pattern in KEPT.items()}
#: What every such item holds, as a test that costs little.
SIGNS = {"number": re.compile("[0-9]").search, "url": re.compile("://").search, "email": re.compile("@").search, "entity": re.compile("[A-Z]").search}


def hits(text: Column, register: Column) -> Column:
    """[(id, category, count)] of the register's tells that occur, in the registry's order. Only texts that hold a tell's stem are searched for it."""

    def found(low: Column) -> Column:
        each = [F.when(register.isin(*t[4]) & F.contains(low, F.lit(STEMS[t[0]])), F.struct(F.lit(t[0]).alias("id"), F.lit(t[1]).alias("category"), F.regexp_count(text, F.lit(compiled(t[2]))).alias("count"))) for t in TELLS]
        return F.filter(F.array(*each), lambda h: h.isNotNull() & (h["count"] > 0))

    return let(F.lower(text), found)


def replaced(text: str, register: str, categories: tuple[str, ...]) -> str:
    """The register's replacements of some categories, one tell after another."""
    changed, low = False, text.lower()
    for category in categories:
        for name, kind, pattern, new, _ in tells_for(register):
            if kind != category or new is None or STEMS[name] not in low:
                continue

            def swap(m: re.Match, new: str = new) -> str:
                if new == "$1":
                    return m[1]
                return new[:1].upper() + new[1:] if "A" <= m[0][:1] <= "Z" and "a" <= new[:1] <= "z" else new

            text, n = re.subn(compiled(pattern), swap, text, flags=re.ASCII)
            if n:
                changed, low = True, text.lower()
    if changed and SCAFFOLD in categories:
        text = re.sub(" {2,}", " ", text).lstrip(" ")
    return text


def lexical(text: str | None, register: str | None) -> str | None:
    return None if text is None or register is None else replaced(text, register, CATEGORIES["lexical"])


def rhetorical(text: str | None, register: str | None) -> str | None:
    return None if text is None or register is None else replaced(text, register, CATEGORIES["rhetorical"])


def forgiving(function):
    """function(text, register), but null where it fails: a pass that fails leaves its text alone."""

    def run(text: str | None, register: str | None) -> str | None:
        try:
            return function(text, register)
        except Exception:  # noqa: BLE001
            return None

    return run


def _pass(df: DataFrame, text: str, out: str, function) -> DataFrame:
    got = with_text(df.withColumnRenamed(text, "_in"), out, ["_in", "register"], function)
    return got.drop("_in") if out == text else got.withColumnRenamed("_in", text)


def lexical_pass(df: DataFrame, text: str = "text", out: str = "text") -> DataFrame:
    """df with the plain words for lexical tells in `out`."""
    return _pass(df, text, out, lexical)


def rhetorical_pass(df: DataFrame, text: str = "text", out: str = "text") -> DataFrame:
    """df without scaffolding, and with plain words for stock phrases, in `out`."""
    return _pass(df, text, out, rhetorical)


def thin_dashes(text: Column, register: Column) -> Column:
    """Spaced em-dashes beyond the register's allowance become commas; chat keeps all."""
    rate = F.coalesce(*[F.when(register == r, F.lit(v)) for r, v in EM_DASH_RATE.items()])

    def body(parts: Column) -> Column:
        words = F.size(F.filter(F.split(text, f"{WS}+"), lambda w: w != ""))
        allowed = F.greatest(F.lit(1), F.floor(words / F.lit(100.0) * rate + 0.5).cast("int"))
        kept = F.array_join(F.slice(parts, F.lit(1), allowed + 1), " — ")
        rest = F.slice(parts, allowed + 2, F.size(parts))
        return F.when(rate.isNull() | (F.size(parts) - 1 <= allowed), text).otherwise(F.concat(kept, F.lit(", "), F.array_join(rest, ", ")))

    return let(F.split(text, " — "), body)


def punctuation_pass(text: Column, register: Column) -> Column:
    bold = next(t for t in TELLS if t[1] == PUNCT and t[3] is not None)
    plain = F.when(register.isin(*bold[4]), F.regexp_replace(text, compiled(bold[2]), "$1")).otherwise(text)
    return let(plain, lambda t: thin_dashes(t, register))


def lost(before: str | None, after: str | None) -> list[str] | None:
    """`label:item` for each distinct item of a text that occurs less often in another, in the order of their first occurrence."""
    if before is None or after is None:
        return None
    out: list[str] = []
    if before != after:
        for label, pattern in _KEPT.items():
            if SIGNS[label](before):
                own = Counter(pattern(before))
                out += [f"{label}:{x}" for x in own - Counter(pattern(after))]
    return out


def _semantic(similarity: Column, least: float = LEAST_SIMILARITY) -> Column:
    return F.when(similarity < least, F.array(F.concat(F.lit("semantic:"), F.format_number(similarity, "0.000")))).otherwise(F.array().cast("array<string>"))


def with_breaches(df: DataFrame, out: str, before: str, after: str, likeness=None) -> DataFrame:
    """df with `label:item` for each item of one text that occurs less often in another; additions are fine, equal texts lose nothing.

    An Arrow step: counting items is a matter of hash tables, which columns lack. likeness(before, after) is an optional column function."""
    return _likened(with_text(df, out, [before, after], lost, "array<string>"), out, before, after, likeness)


def _likened(df: DataFrame, out: str, before: str, after: str, likeness) -> DataFrame:
    return df if likeness is None else df.withColumn(out, F.when(F.col(before) == F.col(after), F.col(out)).otherwise(F.concat(out, _semantic(likeness(F.col(before), F.col(after))))))


def guarded(function):
    """A pass and its guard in one: the new text and what it lost."""

    def run(text: str | None, register: str | None) -> dict:
        new = function(text, register)
        return {"new": new, "lost": lost(text, new)}

    return run


def deai(texts: DataFrame, strictness: str = "standard", rhythm=None, embed=None) -> DataFrame:
    """Adds output, changed, residual, breaches, rolled_back, verdict and registry_version. texts: text, register and any others.

    Each pass is kept only if it neither fails nor loses anything; otherwise its input goes on. PASS needs
    no loss overall, no pass rolled back and no tell left. rhythm(text, register) is an optional function of strings.
    """
    rows = {"lexical": lexical, "rhetorical": rhetorical, "rhythm": rhythm}
    likeness = (lambda a, b: cosine(embed(a), embed(b))) if embed else None
    now = texts.withColumn("output", F.col("text")).withColumn("rolled_back", F.array().cast("array<string>"))
    for name in PASSES[strictness]:
        if name == "punctuation":
            now = with_breaches(now.withColumn("_new", punctuation_pass(F.col("output"), F.col("register"))), "_lost", "output", "_new", likeness)
        elif rows[name] is None:
            continue
        else:
            both = with_text(now, "_both", ["output", "register"], guarded(forgiving(rows[name])), "struct<new: string, lost: array<string>>")
            now = _likened(both.withColumns({"_new": F.col("_both.new"), "_lost": F.col("_both.lost")}).drop("_both"), "_lost", "output", "_new", likeness)
        failed = F.col("_new").isNull() & F.col("output").isNotNull() & F.col("register").isNotNull()
        bad = failed | F.coalesce(F.size("_lost") > 0, F.lit(False))
        now = now.withColumn("rolled_back", F.when(bad, F.concat("rolled_back", F.array(F.lit(name)))).otherwise(F.col("rolled_back")))
        now = now.withColumn("output", F.when(bad, F.col("output")).otherwise(F.col("_new"))).drop("_new", "_lost")
    done = with_breaches(now, "breaches", "text", "output", likeness).withColumn("residual", hits(F.col("output"), F.col("register")))
    clean = (F.size("breaches") == 0) & (F.size("rolled_back") == 0) & (F.size("residual") == 0)
    return done.withColumn("verdict", F.when(clean, "PASS").otherwise("REVIEW")).withColumn("changed", F.col("output") != F.col("text")).withColumn("registry_version", F.lit(REGISTRY_VERSION))
