"""License scans: phrases, and license templates whose optional and replaceable regions are compiled to token automata.

Markup: `<<optional>>` ... `<</optional>>` may be left out as a whole, `<<var N>>` stands for 0 to N words, and of
`<<either>>` ... `<<or>>` ... `<</either>>` one stands. All other words are mandatory and must match exactly. A template becomes a word automaton with epsilon
moves resolved; it accepts a run of words of the text that spells the template.

Words: A-Z are lowered, then maximal runs of characters outside U+0000-U+002F, U+003A-U+0060 and
U+007B-U+007F.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylespark.llm.common import prepared, quoted

#: The base: phrase -> label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Wording that several licenses share.
_MERCHANT = "<<optional>>the<</optional>> warranties of merchantability fitness for a particular purpose and noninfringement"
_MIT_END = f"the software is provided as is without warranty of any kind express or implied including but not limited to {_MERCHANT} in no event shall <<var 12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BULLET = "<<optional>><<either>>{0}<<or>>{1}<</either>><</optional>>"
_BSD_HEAD = f"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {_BULLET.format(1, 'a')} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer {_BULLET.format(2, 'b')} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAMES = "neither the name of <<var 12>> nor the names of <<var 4>> contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_AD = "all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by <<var 12>>"
_BSD_END = "this software is provided by <<var 12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var 12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_ISC_HEAD = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "the software is provided as is and <<var 6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var 6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
_GRANTED = "<<optional>>this <<var 3>> is<</optional>> licensed under <<optional>>the terms of<</optional>>"
#: GNU licenses: label -> (name between gnu and license, version). Creative Commons notices: elements, versions.
_GNU = {"gpl-2.0": ("general public", "2"), "gpl-3.0": ("general public", "3"), "lgpl-2.1": ("lesser general public", "2 1"), "lgpl-3.0": ("lesser general public", "3"), "agpl-3.0": ("affero general public", "3")}
_CC_ELEMENTS, _CC_VERSIONS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"), ("1 0", "2 0", "2 5", "3 0", "4 0")
_CC_NAMES = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}


def _gnu_header(name: str, version: str) -> str:
    license_, which = f"gnu {name} license", f"version {version} of the license"
    return f"is free software you can redistribute it and or modify it under the terms of the {license_} as published by the free software foundation <<either>>either {which} or at your option any later version<<or>>{which}<</either>> <<var 6>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {license_} for more details <<optional>>you should have received a copy of the {license_} along with <<var 6>> if not <<var 24>><</optional>>"


def _gnu_notice(name: str, version: str) -> str:
    return f"{_GRANTED} the gnu {name} license <<either>>version {version}<<or>>v{version}<</either>> <<optional>>0<</optional>> <<optional>>or <<optional>>at your option<</optional>> <<optional>>any<</optional>> later <<optional>>version<</optional>><</optional>>"


def _cc(elements: str, version: str) -> tuple[str, str]:
    """The notice by its short name, and by its long one."""
    head, tail = "<<optional>>this <<var 3>> is<</optional>> licensed under <<optional>><<either>>a<<or>>the<</either>><</optional>>", "<<optional>><<either>>international<<or>>unported<<or>>generic<</either>><</optional>>"
    full = " ".join(_CC_NAMES[e] for e in elements.split())
    return f"{head} <<optional>>creative commons<</optional>> cc {elements} {version} {tail} <<optional>>license<</optional>>", f"{head} creative commons {full} {version} {tail} license"


#: label -> template: notices, and license texts to their last mandatory word, a label for each variant. Our own markup; further ones are a parameter.
TEMPLATES = {
    "0bsd": f"{_ISC_HEAD} {_ISC_END}",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this <<either>>file<<or>>work<<or>>software<</either>> except in compliance with the license you may obtain a copy of the license at <<either>>http<<or>>https<</either>> www apache org licenses license 2 0 <<optional>>txt<</optional>> <<optional>>html<</optional>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "apache-2.0-notice": f"{_GRANTED} the apache license version 2 0",
    "bsd-2-clause": f"{_BSD_HEAD} {_BSD_END}",
    "bsd-3-clause": f"{_BSD_HEAD} {_BULLET.format(3, 'c')} {_BSD_NAMES} {_BSD_END}",
    "bsd-4-clause": f"{_BSD_HEAD} {_BULLET.format(3, 'c')} {_BSD_AD} {_BULLET.format(4, 'd')} {_BSD_NAMES} {_BSD_END}",
    "copyright-line": "copyright <<optional>>c<</optional>> <<var 8>> all rights reserved",
    "isc": f"{_ISC_HEAD} provided that the above copyright notice and this permission notice appear in all copies {_ISC_END}",
    "mit": f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>> shall be included in all copies or substantial portions of the software {_MIT_END}",
    "mit-0": f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so {_MIT_END}",
    "mit-notice": "<<either>>released<<or>>licensed<<or>>distributed<</either>> under the <<optional>>terms of the<</optional>> mit license",
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<either>>http<<or>>https<</either>> <<optional>>www<</optional>> mozilla org mpl 2 0",
    "unlicense": f"this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to {_MERCHANT} in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software <<optional>>for more information please refer to <<var 6>><</optional>>",
    "zlib": f"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions {_BULLET.format(1, 'a')} the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required {_BULLET.format(2, 'b')} altered source versions must be plainly marked as such and must not be misrepresented as being the original software {_BULLET.format(3, 'c')} this notice may not be removed or altered from any source distribution",
    **{f"{label}-header": _gnu_header(*which) for label, which in _GNU.items()},
    **{f"{label}-notice": _gnu_notice(*which) for label, which in _GNU.items()},
    **{f"cc-{e.replace(' ', '-')}-{v.replace(' ', '.')}-{kind}": t for e in _CC_ELEMENTS for v in _CC_VERSIONS for kind, t in zip(("notice", "deed"), _cc(e, v), strict=True)},
}
MARKUP = re.compile(r"<<(/?optional|/?either|or|var \d+)>>|([^\s<]+)")
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matched_words long"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWERED).split()


class Automaton:
    """moves[state]: word -> states, with None for any word; closed over epsilon moves. accept: final states."""

    def __init__(self, template: str) -> None:
        arcs: list[dict] = [{}]
        skips: list[set[int]] = [set()]
        opened: list[int] = []
        choices: list[tuple[int, list[int]]] = []
        here = 0

        def new() -> int:
            arcs.append({})
            skips.append(set())
            return len(arcs) - 1

        for mark, word in MARKUP.findall(template):
            if word:
                after = new()
                arcs[here].setdefault(word.encode(), set()).add(after)
                here = after
            elif mark == "optional":
                opened.append(here)
                after = new()
                skips[here].add(after)
                here = after
            elif mark == "/optional":
                after = new()
                skips[here].add(after)
                skips[opened.pop()].add(after)
                here = after
            elif mark in ("either", "or"):
                if mark == "either":
                    choices.append((here, []))
                else:
                    choices[-1][1].append(here)
                after = new()
                skips[choices[-1][0]].add(after)
                here = after
            elif mark == "/either":
                ends = [*choices.pop()[1], here]
                here = new()
                for e in ends:
                    skips[e].add(here)
            else:
                end = new()
                for _ in range(int(mark[4:])):
                    skips[here].add(end)
                    after = new()
                    arcs[here].setdefault(None, set()).add(after)
                    here = after
                skips[here].add(end)
                here = end
        if opened or choices:
            raise ValueError("a region isn't closed")

        def closed(state: int) -> frozenset[int]:
            seen, todo = {state}, [state]
            while todo:
                for x in skips[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            return frozenset(seen)

        close = [closed(s) for s in range(len(arcs))]
        self.moves = [{w: frozenset().union(*(close[t] for s in close[k] for t in arcs[s].get(w, ()))) for w in {w for s in close[k] for w in arcs[s]}} for k in range(len(arcs))]
        self.begin, self.accept = 0, frozenset(s for s in range(len(arcs)) if here in close[s])
        if self.begin in self.accept:
            raise ValueError("a template needs a mandatory word")
        self.anchor = max((run for run in self.mandatory(template)), key=len)

    @staticmethod
    def mandatory(template: str) -> list[list[bytes]]:
        """Runs of consecutive words outside all regions."""
        runs, depth = [[]], 0
        for mark, word in MARKUP.findall(template):
            if mark:
                depth += {"optional": 1, "either": 1, "/optional": -1, "/either": -1}.get(mark, 0)
                runs.append([])
            elif not depth:
                runs[-1].append(word.encode())
        return runs

    def longest(self, text: list[bytes], at: int) -> int:
        """End of the longest accepted run from word `at`, or -1."""
        live, end = {self.begin}, -1
        for k in range(at, len(text)):
            step: set[int] = set()
            for s in live:
                m = self.moves[s]
                step.update(m.get(text[k], ()), m.get(None, ()))
            if not step:
                break
            if step & self.accept:
                end = k + 1
            live = step
        return end

    def starts(self, text: list[bytes], joined: bytes) -> list[int]:
        """Where a match can begin: no accepted run lacks the anchor, and none begins further before it than the template is long."""
        found = places(joined, b" ".join(self.anchor))
        back = len(self.moves)
        out: set[int] = set()
        for k in found:
            out.update(range(max(0, k - back), k + 1))
        return [k for k in sorted(out) if text[k] in self.moves[0] or None in self.moves[0]]


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word places of a phrase in words joined and flanked by single spaces; overlapping ones count."""
    needle, out, at, word, counted = b" " + phrase + b" ", [], -1, 0, 0
    while (at := joined.find(needle, at + 1)) >= 0:
        word += joined.count(b" ", counted, at)
        counted = at
        out.append(word)
    return out


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]) -> None:
        self.phrases = {b" ".join(words(p)): label for p, label in phrases.items()}
        self.automata = {label: Automaton(t) for label, t in templates.items()}
        self.keys = {label: b" ".join(a.anchor) for label, a in self.automata.items()}

    def scan(self, text: str | None) -> dict:
        own = words(text)
        joined = b" " + b" ".join(own) + b" "
        spots, base = [], set()
        for p, label in self.phrases.items():
            if p in joined and (found := places(joined, p)):
                spots += found
                base.add(label)
        covered: set[int] = set()
        labels = set(base)
        for label, automaton in self.automata.items():
            if self.keys[label] not in joined:
                continue
            end = 0
            for k in automaton.starts(own, joined):
                if k >= end and (stop := automaton.longest(own, k)) > 0:
                    labels.add(label)
                    covered.update(range(k, stop))
                    end = stop
        weight = len(covered) / len(own) if own else 0.0
        score = 0.0 if not labels else 0.5 * bool(base) + (0.5 if labels - base else 0.0) * (0.5 + 0.5 * weight)
        return {"n_words": len(own), "n_base": len(spots), "first_word": min(spots, default=None), "last_word": max(spots, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "matched_words": len(covered)}


@cache
def _scanner(phrases: tuple, templates: tuple) -> Scanner:
    return Scanner(dict(phrases), dict(templates))


def _scan(phrases: tuple, templates: tuple):
    names = [x.split()[0] for x in RESULT.split(", ")]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(phrases, templates)
        for batch in batches:
            rows = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], t) for n, t in zip(names[1:], types[1:], strict=True))], names=names)

    return run


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """Labels of phrases and templates found anywhere in each whole text; one row per row, no shuffle.

    n_base counts all places of the phrases; first_word and last_word are their smallest and largest start,
    else null. labels holds the phrases' and the templates'. score: half for a phrase, a quarter to a half for a
    template by the share of words it covers. Of places where a template can match, the first is taken, with its longest
    match, and the next one after its end. Null or empty texts have no words and no labels. Very long texts are scanned whole.
    Repeated rows and null ids are kept; an empty table gives no rows; further columns are ignored, whatever their names.
    """
    prepared(docs.sparkSession)
    rows = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))
    pick = lambda x, other: tuple(sorted((other if x is None else x).items()))
    return rows.mapInArrow(_scan(pick(phrases, PHRASES), pick(templates, TEMPLATES)), RESULT)
