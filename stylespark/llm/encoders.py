"""Encoding by distinct chunks: a text is cut where no token can cross, the distinct chunks that a worker hasn't met
are encoded together, and ids are joined back by position with array gathers.

All three encoders give exactly the ids of their library for every text. Texts or chunks that the
cutting rule doesn't cover go to the library itself. Null counts as the empty text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import repeat

import numpy as np

from stylespark.llm.common import slices, tokenizer_path

#: Marks a chunk that has no space before it; END, a word's end; SEP, a chunk's end. Texts that hold one take the slow way.
BARE, END, SEP = "\x01", "\x01", "\x02"
#: Characters of texts whose chunks are looked up together.
RUN_CHARS = 500_000
#: Distinct chunks and ids that a worker's table holds before those that came up once are dropped.
MOST_CHUNKS, MOST_IDS = 250_000, 4_000_000
#: Longer chunks are encoded but not kept.
LONGEST_KEPT = 64

Batch = tuple[np.ndarray, np.ndarray]


def spread(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start : start + length] of every pair, one after another."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - ends + length, length) + np.arange(total)]


class ChunkTable:
    """chunk -> place of its ids in one flat array."""

    def __init__(self, encode: Callable[[list[str]], Batch], most: int = MOST_CHUNKS) -> None:
        self.encode, self.most = encode, most
        self.at: dict[str, int] = {}
        self.flat, self.start, self.length, self.seen = np.zeros(1 << 16, np.uint32), *(np.zeros(1 << 14, np.int64) for _ in range(3))
        self.n = self.ids = 0

    @staticmethod
    def _grown(old: np.ndarray, used: int, more: int) -> np.ndarray:
        if used + more <= len(old):
            return old
        new = np.zeros(max(2 * len(old), used + more), old.dtype)
        new[:used] = old[:used]
        return new

    def _put(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        many = len(chunks)
        self.flat = self._grown(self.flat, self.ids, len(ids))
        self.start, self.length, self.seen = (self._grown(x, self.n, many) for x in (self.start, self.length, self.seen))
        here = slice(self.n, self.n + many)
        self.flat[self.ids : self.ids + len(ids)] = ids
        self.length[here], self.seen[here] = lengths, 0
        self.start[here] = self.ids + np.cumsum(lengths) - lengths
        self.at.update(zip(chunks, range(self.n, self.n + many), strict=True))
        self.n += many
        self.ids += len(ids)

    def _trim(self) -> None:
        """Keep the chunks seen most, at most half as many as the table holds, of those seen twice."""
        keys, places = list(self.at), np.fromiter(self.at.values(), np.int64, len(self.at))
        often = self.seen[places]
        keep = np.flatnonzero(often > 1)
        keep = keep[np.argsort(-often[keep], kind="stable")[: self.most // 2]]
        kept, start, length = [keys[i] for i in keep.tolist()], self.start[places[keep]], self.length[places[keep]]
        fit = np.cumsum(length) <= MOST_IDS // 2
        kept, start, length = kept[: int(fit.sum())], start[fit], length[fit]
        ids = spread(self.flat, start, length)
        self.at, self.n, self.ids = {}, 0, 0
        self._put(kept, ids, length)

    def gather(self, chunks: list[str]) -> Batch:
        """The ids of all chunks in order, and how many each has."""
        if self.n > self.most or self.ids > MOST_IDS:
            self._trim()
        at = np.fromiter(map(self.at.get, chunks, repeat(-1)), np.int64, len(chunks))
        miss = np.flatnonzero(at < 0)
        if len(miss):
            lost = [chunks[i] for i in miss.tolist()]
            new = list(dict.fromkeys(lost))
            self._put(new, *self.encode(new))
            at[miss] = np.fromiter(map(self.at.__getitem__, lost), np.int64, len(lost))
            if max(map(len, new)) > LONGEST_KEPT:
                for c in new:
                    if len(c) > LONGEST_KEPT:
                        del self.at[c]
        self.seen[: self.n] += np.bincount(at, minlength=self.n)
        n = self.length[at]
        return spread(self.flat, self.start[at], n), n


class ChunkEncoder:
    """encoded(texts): the ids of all texts, as the library gives them."""

    def __init__(self) -> None:
        self.table = ChunkTable(self.chunk_ids)
        #: Chunks of the texts seen, and texts that the library took whole.
        self.cut = self.whole = 0

    def chunk_ids(self, chunks: list[str]) -> Batch:
        """The ids of distinct chunks one after another, and how many each has."""
        raise NotImplementedError

    def split(self, text: str) -> list[str] | None:
        """Chunks of the text; None: the library must take it."""
        raise NotImplementedError

    def library_ids(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def encoded(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of texts [a, b): their ids one after another, and the edges of each text's ids."""
        texts = [t or "" for t in texts]
        for a, b in slices([len(t) for t in texts], RUN_CHARS):
            chunks, counts, hard = [], [], []
            for i in range(a, b):
                own = self.split(texts[i])
                if own is None:
                    hard.append(i)
                    counts.append(0)
                else:
                    chunks += own
                    counts.append(len(own))
            self.cut, self.whole = self.cut + len(chunks), self.whole + len(hard)
            ids, n = self.table.gather(chunks)
            edges = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts)))]
            if hard:
                parts, own = np.split(ids, edges[1:-1]), self.library_ids([texts[i] for i in hard])
                for i, x in zip(hard, own, strict=True):
                    parts[i - a] = np.array(x, np.uint32)
                ids, edges = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            yield a, b, ids, edges

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for a, b, ids, edges in self.encoded(texts):
            for i in range(b - a):
                yield ids[edges[i] : edges[i + 1]]


def joined(ids: list[list[int]]) -> Batch:
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((x for own in ids for x in own), np.uint32, int(lengths.sum())), lengths


def mixed(chunks: list[str], hard: list[int], easy: Callable[[list[str]], Batch], library: Callable[[list[str]], list[list[int]]]) -> Batch:
    """Ids of the chunks in order, where those at the places `hard` go to the library."""
    if not hard:
        return easy(chunks)
    out = set(hard)
    ids, n = easy([c for i, c in enumerate(chunks) if i not in out])
    own, m = joined(library([chunks[i] for i in hard]))
    is_hard = np.zeros(len(chunks), bool)
    is_hard[hard] = True
    lengths = np.zeros(len(chunks), np.int64)
    lengths[is_hard], lengths[~is_hard] = m, n
    flat = np.zeros(len(ids) + len(own), np.uint32)
    from_library = np.repeat(is_hard, lengths)
    flat[from_library], flat[~from_library] = own, ids
    return flat, lengths


#: Characters that all dialects put into the same class and case alike and that no normal form changes (tests look at each),
#: without white space other than the space, the line feed, the tab and the carriage return.
SAFE = r"\x00\x03-\x0a\x0d-\x1b\x20-\x84\x86-\x9f\xa1-\u024f\u0400-\u0482\u048a-\u052f\u2010-\u2027\u2030-\u205e"
UNSAFE = re.compile(f"[^{SAFE}]").search
OTHER_NUMBERS = "\xb2\xb3\xb9\xbc-\xbe"
#: White space of some dialects only, beside which a text must not be cut, and other white space.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]").search
WIDE_SPACE = re.compile("[\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search


def _unicode_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeEncoder(ChunkEncoder):
    """A `tokenizers` vocabulary whose merges a byte-pair core applies by rank to many chunks at once.

    Merging by rank equals the library's merging by its list where the merges' results stand in the list's order
    (checked here) and every entry of the vocabulary, merged alone by the list, is itself: the first merge by which the two
    differ would be inside the span of the entry it makes, and would differ for that entry alone too. Tests check
    the second condition for every entry."""

    #: What the core takes as one piece.
    PIECES: str

    def __init__(self, path: str) -> None:
        super().__init__()
        import tiktoken

        self.path, self.tool = path, None
        model = json.load(open(path, encoding="utf-8"))["model"]
        order, self.ids = self.ranks(model)
        if len(set(order)) != len(order):
            raise ValueError("two merges make the same entry")
        self.bpe = tiktoken.Encoding("ranks", pat_str=self.PIECES, mergeable_ranks={k: i for i, k in enumerate(order)}, special_tokens={})._core_bpe.encode_ordinary
        self.order = order
        self.stop = self.bpe(self.separator)
        if len(self.stop) != 1:
            raise ValueError("the separator isn't one entry")

    def ranks(self, model: dict) -> tuple[list[bytes], np.ndarray]:
        """Entries by rank, and their ids."""
        raise NotImplementedError

    separator = SEP

    def library_ids(self, texts: list[str]) -> list[list[int]]:
        if self.tool is None:
            os.environ.setdefault("RAYON_NUM_THREADS", "1")
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.tool = Tokenizer.from_file(self.path)
        return [e.ids for e in self.tool.encode_batch(texts, add_special_tokens=False)]

    def merge(self, text: str) -> Batch:
        """Ids of a text of chunks that each end with SEP."""
        got = np.array(self.bpe(text), np.int64)
        stops = np.flatnonzero(got == self.stop[0])
        keep = np.ones(len(got), bool)
        keep[stops] = False
        return self.ids[got[keep]], np.diff(stops, prepend=-1) - 1


def _pair(merge) -> tuple[str, str]:
    left, right = merge.split(" ") if isinstance(merge, str) else merge
    return left, right


class ByteBpe(MergeEncoder):
    """byte_bpe_50k.json. Its words begin with a space, so a text is cut before a space that follows a
    non-space and precedes a non-space, around single line feeds, and before the last of several white spaces."""

    PIECES = r"\x02|'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x02]+|\s+"

    def __init__(self, path: str | None = None) -> None:
        super().__init__(path or tokenizer_path("byte_bpe_50k.json"))
        self.pieces = re.compile(r" ?\S+|\s+(?!\S)|\s").findall

    def ranks(self, model: dict) -> tuple[list[bytes], np.ndarray]:
        byte, names = _unicode_bytes(), {}
        raw = lambda s: bytes(byte[c] for c in s)
        for c in byte:
            names[raw(c)] = c
        order = list(names) + [raw(a + b) for a, b in map(_pair, model["merges"])]
        return order, np.array([model["vocab"][names.get(k) or "".join(_pair(m))] for k, m in zip(order, [None] * 256 + model["merges"], strict=True)], np.uint32)

    def split(self, text: str) -> list[str] | None:
        if not text:
            return []
        if BARE in text or SEP in text or "<|endoftext|>" in text or ODD_SPACE(text):
            return None
        if "  " in text or "\n\n" in text or "\n " in text or " \n" in text or "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text or (not text.isascii() and WIDE_SPACE(text)):
            return [c[1:] if c[0] == " " and len(c) > 1 and not c[1].isspace() else BARE + c for c in self.pieces(text)]
        return (BARE + text.replace("\n", "\n " + BARE)).split(" ") if text[-1] != "\n" else (BARE + text[:-1].replace("\n", "\n " + BARE) + "\n").split(" ")

    def chunk_ids(self, chunks: list[str]) -> Batch:
        texts = [c[1:] if c[:1] == BARE else " " + c for c in chunks]
        hard = [i for i, c in enumerate(texts) if UNSAFE(c)] if UNSAFE("".join(texts)) else []
        return mixed(texts, hard, lambda own: self.merge(SEP.join([*own, ""])), self.library_ids)


class WordBpe(MergeEncoder):
    """word_bpe_49k.json. It drops white space, so a text is cut there. Chunks are lower-cased and matched; a
    byte that no chunk holds ends each word, and its 256 first merges mark a word's last byte."""

    PIECES = r"[^\x01]*\x01"
    separator = SEP + END

    def __init__(self, path: str | None = None) -> None:
        super().__init__(path or tokenizer_path("word_bpe_49k.json"))
        # Of the safe characters, those of \w that aren't letters are digits and OTHER_NUMBERS.
        self.words = re.compile(f"\x02|'(?:s|t|re|ve|m|ll|d)|[^\\W\\d_{OTHER_NUMBERS}]+|[\\d{OTHER_NUMBERS}]|(?:[^\\w\\s\x02]|_)+").findall

    def ranks(self, model: dict) -> tuple[list[bytes], np.ndarray]:
        byte, end = _unicode_bytes(), END.encode()
        names = {bytes([b]): c for c, b in byte.items()} | {bytes([b]) + end: c + "</w>" for c, b in byte.items()}
        raw = lambda s: bytes(byte[c] for c in s.removesuffix("</w>")) + (end if s.endswith("</w>") else b"")
        order = [bytes([b]) for b in range(256)] + [bytes([b]) + end for b in range(256)]
        for left, right in map(_pair, model["merges"]):
            order.append(raw(left + right))
            names[order[-1]] = left + right
        return order, np.array([model["vocab"][names[k]] for k in order], np.uint32)

    def split(self, text: str) -> list[str] | None:
        if "<|" in text or BARE in text or SEP in text or ODD_SPACE(text):
            return None
        return text.split()

    def chunk_ids(self, chunks: list[str]) -> Batch:
        hard = [i for i, c in enumerate(chunks) if UNSAFE(c)] if UNSAFE("".join(chunks)) else []
        return mixed(chunks, hard, lambda own: self.merge(END.join([*self.words(SEP.join([*own, ""]).lower()), ""])), self.library_ids)


class PieceBpe(ChunkEncoder):
    """piece_bpe_32k.model. No piece has a marker after another character, and none holds a line feed, so
    merges never cross into a run of spaces or over a line feed: each distinct marked word, with all the spaces
    before it, is segmented once. Constructing it checks these properties of the model."""

    MARK = "▁"

    def __init__(self, path: str | None = None) -> None:
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path or tokenizer_path("piece_bpe_32k.model"))
        pieces = [self.model.id_to_piece(i) for i in range(len(self.model))]
        self.can_cut = not any("\n" in p or self.MARK in p.lstrip(self.MARK) for p in pieces) and self.model.decode(self.model.encode("a  b")) == "a  b"
        self.lead = self.model.encode("\n")
        self.can_cut &= self.model.encode("\na\n") == self.lead + self.model.encode("\na")[len(self.lead) :] + self.lead[1:]
        self.pieces = re.compile(" +[^ ]*").findall

    def library_ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def split(self, text: str) -> list[str] | None:
        """A chunk lacks the one space before it; it begins with the further ones, if any."""
        if not text:
            return []
        if not self.can_cut or BARE in text or self.MARK in text or "\0" in text:
            return None
        marked = text.replace("\n", "\n " + BARE)
        return [c[1:] for c in self.pieces(" " + marked)] if "  " in marked or marked[0] == " " else marked.split(" ")

    def chunk_ids(self, chunks: list[str]) -> Batch:
        """A line feed before a bare chunk keeps the library from marking it; a lone marker stands for the empty chunk."""
        n = len(self.lead)
        own = self.library_ids(["\n" + c[1:] if c[:1] == BARE else c for c in chunks])
        return joined([(i[n:] if c[:1] == BARE else i) if c else self.lead[:1] for c, i in zip(chunks, own, strict=True)])


@cache
def byte_bpe() -> ByteBpe:
    return ByteBpe()


@cache
def word_bpe() -> WordBpe:
    return WordBpe()


@cache
def piece_bpe() -> PieceBpe:
    return PieceBpe()
