"""Text functions as columns: cleaning of quoted, signed and fenced text, counts, registers, ids, style counters.

Regular expressions avoid what differs between dialects: WS is the white space of ECMAScript, word
edges are ASCII, and ends are absolute.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, register limits, default registers, counters.
WS_CHARS = r"\t\n\x0B\x0C\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WS = f"[{WS_CHARS}]"
LONGFORM_WORDS, LONGFORM_PARAGRAPHS, LONGFORM_PARAGRAPH_WORDS, CHAT_WORDS = 120, 3, 80, 6
DEFAULT_REGISTER = {"email": "email", "matrix": "chat", "slack": "longform", "claude": "chat"}
WORD = "[A-Za-z]+(?:'[A-Za-z]+)?"
PUNCTUATION = {
    "em_dash": "—|--",
    "comma": ",",
    "period": r"\.",
    "exclamation": "!",
    "question": r"\?",
    "semicolon": ";",
    "colon": ":",
    "ellipsis": r"\.\.\.|…",
}
CONTRACTION = "[A-Za-z]+'[A-Za-z]+"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2190}-\x{21FF}]"
EDGE_BEFORE, EDGE_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
NEGATIVE_DIRECTIVE = rf"(?i){EDGE_BEFORE}(do not|don't|avoid|never|stop){EDGE_AFTER}"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def is_blank(text: Column) -> Column:
    return text.rlike(rf"\A{WS}*\z")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def _upto_last(items: Column, keep) -> Column:
    """The items up to the last one that keep() holds for."""
    last = F.aggregate(F.zip_with(items, F.sequence(F.lit(1), F.size(items)), lambda x, i: F.when(keep(x), i).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return F.slice(items, F.lit(1), last)


def trim_trailing_blank(items: Column) -> Column:
    return let(items, lambda ls: _upto_last(ls, lambda x: ~is_blank(x)))


def starts_foreign(line: Column) -> Column:
    """The first line of somebody else's words: an attribution, a forward banner, a signature mark or a quote."""
    attribution = line.rlike(rf"^{WS}*On{EDGE_AFTER}.*{EDGE_BEFORE}wrote:{WS}*\z")
    banner = line.rlike(rf"(?i)^{WS}*-+{WS}*Forwarded message{WS}*-+{WS}*\z")
    return attribution | banner | (line == "-- ") | line.rlike(rf"^{WS}*>")


def strip_email(text: Column) -> Column:
    """The lines before the first foreign one, without blank lines at the end."""

    def body(ls: Column) -> Column:
        first = F.coalesce(F.array_position(F.transform(ls, starts_foreign), F.lit(True)), F.lit(0))
        own = F.when(first > 0, F.slice(ls, F.lit(1), first.cast("int") - 1)).otherwise(ls)
        return F.array_join(trim_trailing_blank(own), "\n")

    return let(lines(text), body)


def strip_chat(text: Column) -> Column:
    """Without a quote at the top and the blank lines after it; a text that begins otherwise is untouched."""
    quote = lambda x: x.rlike(rf"^{WS}*>")

    def body(ls: Column) -> Column:
        flags = lambda pred: F.coalesce(F.array_position(F.transform(ls, pred), F.lit(True)), F.lit(0)).cast("int")
        after = flags(lambda x: ~quote(x))
        rest = F.when(after == 0, F.array().cast("array<string>")).otherwise(F.slice(ls, F.greatest(after, F.lit(1)), F.size(ls)))

        def tail(rs: Column) -> Column:
            first = F.coalesce(F.array_position(F.transform(rs, lambda x: ~is_blank(x)), F.lit(True)), F.lit(0)).cast("int")
            return F.when(first == 0, F.lit("")).otherwise(F.array_join(trim_trailing_blank(F.slice(rs, F.greatest(first, F.lit(1)), F.size(rs))), "\n"))

        return let(rest, tail)

    return F.when(text.rlike(rf"\A[{WS_CHARS.replace(chr(92) + 'n', '')}]*>"), let(lines(text), body)).otherwise(text)


def strip_code(text: Column) -> Column:
    """Without fenced blocks; where one was removed, blank lines are tidied. An open fence runs to the end."""
    fence = rf"^[{WS_CHARS.replace(chr(92) + 'n', '')}]*(?:```|~~~)[^\n]*(?:\n|\z)"
    kept = F.regexp_replace(text, rf"(?dm){fence}(?s:.*?)(?:{fence}|\z)", "")
    return F.when(text.rlike(f"(?dm){fence}"), F.array_join(tidy_gaps(lines(kept)), "\n")).otherwise(text)


def tidy_gaps(items: Column) -> Column:
    """No blank lines at either end, and one where there were several."""

    def body(ls: Column) -> Column:
        return F.filter(ls, lambda x, i: ~(is_blank(x) & ((i == 0) | is_blank(F.get(ls, i - 1)))))

    return let(trim_trailing_blank(items), body)


def drop_controls(text: Column) -> Column:
    """Without control characters but tab and line feed."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", "")


def strip_for(medium: Column, text: Column) -> Column:
    return F.when(medium.isin("slack", "claude"), text).when(medium == "matrix", strip_chat(text)).otherwise(strip_email(text))


def count_words(text: Column) -> Column:
    """Only the first and the last part can be empty; a text without words is both."""
    return let(F.split(text, f"{WS}+"), lambda p: F.when((F.size(p) == 1) & (p[0] == ""), F.lit(0)).otherwise(F.size(p) - (p[0] == "").cast("int") - (F.element_at(p, -1) == "").cast("int")))


def count_alpha_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def count_paragraphs(text: Column) -> Column:
    return F.size(F.filter(F.split(text, rf"\n{WS}*\n"), lambda x: ~is_blank(x)))


def is_single_line(text: Column) -> Column:
    return ~F.contains(trim(text), F.lit("\n"))


def classify_register(medium: Column, text: Column, words: Column) -> Column:
    """The first rule that holds: many words, several long paragraphs, a few words on one line, the medium's default."""
    default = F.coalesce(*[F.when(medium == m, F.lit(r)) for m, r in DEFAULT_REGISTER.items()])
    return (
        F.when(words >= LONGFORM_WORDS, "longform")
        .when((words >= LONGFORM_PARAGRAPH_WORDS) & (count_paragraphs(text) >= LONGFORM_PARAGRAPHS), "longform")
        .when((words <= CHAT_WORDS) & is_single_line(text), "chat")
        .otherwise(default)
    )


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def stable_id(*parts: Column) -> Column:
    """SHA-256 of the parts, each after its length in UTF-16 units."""
    return F.sha2(F.concat_ws("|", *[F.concat(utf16_length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def style_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+(?:'[a-z]+)?)"), F.lit(0))


def alpha_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[.!?]+"), trim), lambda s: s != "")


def starts_lowercase(sentence: Column) -> Column:
    first = F.left(sentence, F.lit(1))
    return (first == F.lower(first)) & (first != F.upper(first))


def has_negative_directive(text: Column) -> Column:
    return text.rlike(NEGATIVE_DIRECTIVE)


def normalize_address(header: Column) -> Column:
    return F.lower(trim(F.coalesce(F.nullif(F.regexp_extract(header, "<([^>]+)>", 1), F.lit("")), header)))


def strip_json_fence(text: Column) -> Column:
    return F.regexp_replace(trim(text), rf"^```(?:json)?{WS}*|{WS}*```\z", "")


def mattr(tokens: Column, window: int = 50) -> Column:
    """Mean share of distinct tokens over all windows; of all tokens where there are fewer than a window.

    A token counts in the windows that it stands in first: those that begin behind its last occurrence. Sorting tokens with
    their places puts last occurrences side by side, so the sum over all windows takes one sort and one pass."""

    def total(placed: Column, windows: Column) -> Column:
        def first_in(x: Column, k: Column) -> Column:
            before = F.get(placed, k - 1)
            last = F.when(before["w"] == x["w"], before["i"]).otherwise(F.lit(-1))
            return F.greatest(F.lit(0), F.least(x["i"], windows - 1) - F.greatest(F.lit(0), x["i"] - (window - 1), last + 1) + 1).cast("long")

        return F.aggregate(F.transform(placed, first_in), F.lit(0).cast("long"), lambda a, x: a + x)

    def body(t: Column) -> Column:
        n = F.size(t)
        placed = F.sort_array(F.transform(t, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        spans = let(placed, lambda p: total(p, F.size(p) - (window - 1))) / (F.lit(float(window)) * (n - window + 1))
        return F.when(n == 0, F.lit(0.0)).when(n <= window, F.size(F.array_distinct(t)) / n).otherwise(spans)

    return let(tokens, body)


def punctuation_counts(text: Column) -> dict[str, Column]:
    return {k: F.regexp_count(text, F.lit(p)) for k, p in PUNCTUATION.items()}
