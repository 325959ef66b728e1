"""The registry of formulaic phrasings."""

from __future__ import annotations

import re

ALL, FORMAL, CASUAL = ("chat", "email", "longform"), ("email", "longform"), ("chat", "email")
WORD_, STOCK, SCAFFOLD, RHETORIC, PUNCT = "lexical_word", "stock_phrase", "scaffolding_pattern", "rhetorical_construction", "punctuation_markdown"
# The version; id, category, pattern (any case), replacement (None: detect only), registers.
REGISTRY_VERSION = "2026-06-26.1"
TELLS = (
    ("lex.delve", WORD_, r"\bdelve(s|d|ing)?\b", "look", ALL),
    ("lex.intricate", WORD_, r"\bintricate(ly)?\b", "detailed", ALL),
    ("lex.underscore", WORD_, r"\bunderscore(s|d|ing)?\b", "shows", ALL),
    ("lex.tapestry", WORD_, r"\btapestr(y|ies)\b", "mix", ALL),
    ("lex.utilize", WORD_, r"\butiliz(e|es|ed|ing)\b", "use", ALL),
    ("lex.myriad", WORD_, r"\bmyriad\b", "many", ALL),
    ("stock.testament", STOCK, r"\b(?:is |stands as )?a testament to\b", "shows", ALL),
    ("stock.vital_role", STOCK, r"\bplays? an? (?:vital|crucial|key|pivotal|significant) role in\b", "matters for", ALL),
    ("stock.when_it_comes_to", STOCK, r"\bwhen it comes to\b", "for", ALL),
    ("stock.in_the_realm_of", STOCK, r"\bin the realm of\b", "in", ALL),
    ("scaf.worth_noting", SCAFFOLD, r"\bit['’]s worth noting that\s*", "", ALL),
    ("scaf.important_to_note", SCAFFOLD, r"\bit['’]s important to note that\s*", "", ALL),
    ("scaf.in_conclusion", SCAFFOLD, r"\bin (?:conclusion|summary),?\s*", "", FORMAL),
    ("scaf.happy_to_help", SCAFFOLD, r"\bi['’]?d be happy to (?:help|assist)(?: you)?\b\.?\s*", "", ALL),
    ("scaf.certainly_opener", SCAFFOLD, r"\A(?:certainly|of course|absolutely|great question)[!,.]\s*", "", ALL),
    ("rhet.not_just_but", RHETORIC, r"\bnot (?:just|only)\b[^.!?]{1,60}?\bbut(?: also)?\b", None, ALL),
    ("punct.bold", PUNCT, r"\*\*([^*\n]+)\*\*", "$1", CASUAL),
    ("punct.em_dash", PUNCT, r"\s—\s", None, FORMAL),
)


def compiled(pattern: str) -> str:
    """For Java and Python (with re.ASCII) alike: ASCII word edges, looked at from the side of the word, and ECMAScript's white space."""
    from stylespark.functions.text import EDGE_AFTER, EDGE_BEFORE, WS

    before = re.sub(r"\\b(?=[A-Za-z0-9(])", lambda _: EDGE_BEFORE, pattern)
    return "(?i)" + before.replace(r"\b", EDGE_AFTER).replace(r"\s", WS)


def stem(pattern: str) -> str:
    """The longest literal that every match holds, in lower case; empty if there is none."""
    rest = re.sub(r"\((?:\?:)?[^()]*\)\??", "\0", pattern)  # groups
    rest = re.sub(r"\[[^\]]*\](?:\{[^}]*\}|[*+?])*|\\[AbsS]\*?", "\0", rest)  # classes, edges, white space
    rest = re.sub(r"\\?.\?", "\0", rest)  # what may be left out
    return max(re.sub(r"\\(.)", r"\1", rest).split("\0"), key=len).lower()


#: id -> stem: a text without it has no such phrasing, and is spared the search.
STEMS = {t[0]: stem(t[2]) for t in TELLS}


def tells_for(register: str) -> list[tuple]:
    return [t for t in TELLS if register in t[4]]
