"""BPE with word ends: encoding and decoding whole texts.

Text is cut at ASCII white space, and every piece between is encoded on its own; pieces repeat, so a
bounded memo keeps their ids. Each short word of a piece holds its parts between boundaries and the
ranks of adjacent parts in two contiguous arrays: the lowest rank is found by a scan, its boundary
deleted and the two neighbouring ranks refreshed, until no adjacent pair has a rank. Many words go
through these rounds together, a row of an array each.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Words of more symbols are merged with a heap: scans would take time with the square of the length.
SHORT = 64
#: Words that are merged together.
BATCH = 20_000
#: Pieces and words that the memos of one Python worker hold at most (about 80 MB), and their longest.
MEMO = 200_000
LONGEST = 200
#: Rows that leave a task in one Arrow batch.
ROWS = 512

_NONE = 1 << 30
_BREAKS = re.compile("[ \t-\r]+")
# Marks that end a word before white space are a word of their own: cut off, so that fewer different pieces are left.
_PAUSE = re.compile("[.,;:!?#$%&*](?<=[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff].)[.,;:!?#$%&*]*+(?=[ \n])")
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# White space, and marks and one composition that are newer than the tables of the tokenizer's normal form, which
# leaves them where they are.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NEWER_MARKS = (
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B "
    "1145E 11839-1183A 11930 11938 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE "
    "1E2EC-1E2EF 1E4EC-1E4EF"
)
# Letters that only newer tables give a lower case, which the tokenizer's have: first, last, lower case of the first, step.
_NEWER_LOWER = (
    (0x1C89, 0x1C89, 0x1C8A, 1), (0xA7CB, 0xA7CB, 0x0264, 1), (0xA7CC, 0xA7CE, 0xA7CD, 2), (0xA7D2, 0xA7D4, 0xA7D3, 2), (0xA7DA, 0xA7DA, 0xA7DB, 1),
    (0xA7DC, 0xA7DC, 0x019B, 1), (0x10D50, 0x10D65, 0x10D70, 1), (0x16EA0, 0x16EB8, 0x16EBB, 1),
)


# Letters and numbers of the installed regex that are newer than the tokenizer's classes.
_NEWER_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A "
    "11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 "
    "1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF "
    "2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
_NEWER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


def _set(ranges: str) -> str:
    """Ranges of hexadecimal code points as a set of a pattern."""
    return "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in ranges.split())


def _class(kind: str, newer: str, every: str = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))) -> str:
    """The code points of a category but for newer ones, as a set of a pattern."""
    runs = regex.findall(rf"(?:(?![{_set(newer)}])\p{{{kind}}})+", every)
    return "".join(f"{r[0]}-{r[-1]}" for r in runs)


_LETTERS, _NUMBERS = _class("L", _NEWER_LETTERS), _class("N", _NEWER_NUMBERS)
_WORDS = re.compile(rf"[{_LETTERS}]+|\n|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
_INERT = re.compile(f"([{_set(_NEWER_MARKS)}]+)")
_MORE_LOWER = {code: low + code - first for first, last, low, step in _NEWER_LOWER for code in range(first, last + 1, step)}
_LOWERED = re.compile("[" + "".join(map(chr, _MORE_LOWER)) + "]")


#: Stands for the end of a piece among ids, which are below 2**20: no ids hold it, at any byte.
_CUT = b"\xff" * 4


def _byte_letters() -> list[str]:
    """The printable letter for each byte: bytes that print stand for themselves, others follow from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class WordBpe(dict):
    """Ids of pieces without ASCII white space, as little-endian unsigned 32-bit integers; a memo of itself."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids = model["vocab"]
        pairs = np.array([self.ids[a] << 20 | self.ids[b] for a, b in model["merges"]])
        self.pair_ranks = np.argsort(pairs).astype(np.int32)
        self.pairs = pairs[self.pair_ranks]
        self.made = np.array([self.ids[a + b] for a, b in model["merges"]], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.ids | self.special).items()}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.letters = _byte_letters()
        self.letter_ids, self.last_ids = (np.array([self.ids[x + end] for x in self.letters], np.int32) for end in ("", self.end))
        # ranks of two letters, the last of which may end a word; behind them what stands for no letter
        letters = np.arange(-1, max(self.letter_ids.max(), self.last_ids.max()) + 1, dtype=np.int32)
        self.letter_ranks = np.roll(self.rank(letters[:, None], letters), -1, (0, 1))
        self.words: dict[str, bytes] = {}
        self.ranks: dict[int, int] = {}
        self.forget()

    def forget(self) -> None:
        """Empties the memos, so that an idle worker holds the vocabulary alone."""
        self.clear()
        self.words = {"\n": _CUT} | {t: array("I", [i]).tobytes() for t, i in self.special.items()}

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that the memo lacks; their new words are merged together."""
        odd = [p for p in pieces if "<|" in p]
        plain = [*pieces.difference(odd)]
        text = self.normal("\n".join([*plain, ""]))
        # letters alone are a word; what newer tables call letters lies beyond Latin
        latin = max(set(text), default="") < "\u0300"
        parts = text.split("\n")[:-1]
        letters = [x.isalpha() and (latin or x.isascii()) for x in parts]
        marked = [not x for x in letters]
        alone, single, mixed, others = [[*compress(some, kind)] for kind in (letters, marked) for some in (plain, parts)]
        found = _WORDS.findall("\n".join([*others, ""])) if others else []
        apart = [[w for x in self.specials.split(p) for w in ([x] if x in self.special else _WORDS.findall(self.normal(x)))] for p in odd]
        new = self.merged([*set(found).union(single, *apart).difference(self.words)])
        self.words.update(new)
        word = self.words.__getitem__
        out = [*map(word, single), *b"".join(map(word, found)).split(_CUT)[:-1], *[b"".join(map(word, some)) for some in apart]]
        _forget(self.words, new)
        return dict(zip(alone + mixed + odd, out))

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then each code point's own lower case (a final sigma stays an ordinary one)."""
        if text.isascii():
            return text.lower()
        used = "".join(set(text))
        if _INERT.search(used):  # what these part does not meet
            text = "".join([x if k % 2 else unicodedata.normalize("NFC", x) for k, x in enumerate(_INERT.split(text))])
        else:
            text = unicodedata.normalize("NFC", text)
        if _LOWERED.search(used):
            text = text.translate(_MORE_LOWER)
        return "".join(map(str.lower, text)) if "\u03a3" in text else text.lower()

    def merged(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words: short ones in batches of about equal length, others one by one."""
        out: dict[str, bytes] = {}
        codes = np.frombuffer("\n".join([*words, ""]).encode(), np.uint8)
        after = np.flatnonzero(codes == 10)
        start = np.append(0, after[:-1] + 1)[: len(words)]
        size = after - start
        first, last = self.letter_ids[codes], self.last_ids[codes[after - 1]]
        for wide in (4 << k for k in range((SHORT // 4).bit_length())):
            own = np.flatnonzero((size <= wide) & ((size > wide // 2) | (wide == 4)))
            for at in range(0, len(own), BATCH):
                some = own[at : at + BATCH]
                out.update(zip(map(words.__getitem__, some.tolist()), self.merge_short(first, start[some], size[some], last[some], wide)))
        for k in np.flatnonzero(size > SHORT).tolist():
            out[words[k]] = array("I", self.merge_long("".join([self.letters[b] for b in words[k].encode()]))).tobytes()
        return out

    def merge_short(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray, last: np.ndarray, width: int) -> list[bytes]:
        """A row for each word, whose letters' ids start somewhere and end with a last one: ``parts`` has the id of what
        lies between two boundaries, ``near`` the rank of each adjacent pair. In every round each row that still has a
        rank finds its lowest (the leftmost of equal ones), deletes that boundary and refreshes the two ranks beside it.
        """
        inside = np.arange(width) < size[:, None]
        parts = np.where(inside, ids[np.minimum(start[:, None] + np.arange(width), len(ids) - 1)], np.int32(-1))
        rows = np.arange(len(start))
        parts[rows, size - 1] = last
        done, row, here = np.full(parts.shape, -1, np.int32), rows, rows
        near = np.full(parts.shape, _NONE, np.int32)
        near[:, :-1] = self.letter_ranks[parts[:, :-1], parts[:, 1:]]
        columns = np.arange(width)
        while len(row):
            at = near.argmin(1)
            least = near[here[: len(row)], at]
            live = least < _NONE
            if not live.all():
                done[row[~live]] = parts[~live]
                row, parts, near, at, least = row[live], parts[live], near[live], at[live], least[live]
                if not len(row):
                    break
            here = here[: len(row)]
            parts[here, at] = self.made[least]
            moved = np.minimum(columns + (columns > at[:, None]), width - 1)
            parts = np.take_along_axis(parts, moved, 1)
            parts[:, -1] = -1
            moved[here, at] = np.minimum(at + 1, width - 1)
            near = np.take_along_axis(near, moved, 1)
            near[:, -1] = _NONE
            near[here, at] = self.rank(parts[here, at], parts[here, np.minimum(at + 1, width - 1)])
            left = at > 0
            near[here[left], at[left] - 1] = self.rank(parts[here[left], at[left] - 1], parts[here[left], at[left]])
        flat = done.astype("<u4").tobytes()
        return [flat[k * width * 4 : (k * width + n) * 4] for k, n in enumerate((done >= 0).sum(1).tolist())]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (b >= 0), self.pair_ranks[at], np.int32(_NONE))

    def merge_long(self, letters: str) -> list[int]:
        """The same merges by a heap of pairs over linked parts."""
        parts: list[int | None] = [*map(self.ids.__getitem__, letters[:-1]), self.ids[letters[-1] + self.end]]
        if not self.ranks:
            self.ranks = dict(zip(self.pairs.tolist(), self.pair_ranks.tolist()))
        rank = self.ranks.get
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            least, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = int(self.made[least]), None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := rank(parts[k] << 20 | parts[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))
        return [p for p in parts if p is not None]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts, some texts at a time."""
        pieces = [_pieces(t) if t else [] for t in texts]
        # every piece is looked up once; the places of those that the memo lacks are filled in
        coded = [[*map(self.get, some)] for some in pieces]
        holes = [[k for k, x in enumerate(some) if x is None] for some in coded]
        new = self.learn({some[k] for some, own in zip(pieces, holes) for k in own})
        for some, own, out in zip(pieces, holes, coded):
            for k in own:
                out[k] = new[some[k]]
        self.update(new)
        _forget(self, new)
        return [*map(b"".join, coded)]

    def decode(self, coded: bytes) -> str:
        return " ".join(map(self.names.__getitem__, memoryview(coded).cast("I")))


def _pieces(text: str) -> list[str]:
    """The text cut at ASCII white space and before marks at words' ends; str.split() does it where there is no other space."""
    text = _PAUSE.sub(r" \g<0>", text)
    return [p for p in _BREAKS.split(text) if p] if _OTHER_SPACE.search(text) else text.split()


def _forget(memo: dict, new: dict) -> None:
    """Takes very long entries, and the newest while the memo has too many, out again."""
    for _ in range(len(memo) - MEMO):
        memo.popitem()
    for key in [k for k in new if len(k) > LONGEST]:
        memo.pop(key, None)


_LOADED: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One vocabulary for a Python worker and all tasks that it runs; a task forgets its memo at its end."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """Encodes whole texts; with ``decode``, decodes the ids again.

    vocabulary: path of the vocabulary file, the same on every machine.

    Returns per input row: ``id_col`` as it is, ``n_tokens`` long, ``ids`` binary (little-endian
    unsigned 32-bit integers) and, with ``decode``, ``decoded`` string (token names joined by blanks,
    special tokens included). Null and empty texts have no ids and decode to an empty text. Repeated
    rows give repeated rows, a null id stays null; other columns are neither read nor returned.
    Texts of any length are encoded whole. There is no shuffle.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                coded = bpe.encode(part.column(1).to_pylist())
                out = [part.column(0), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(coded, pa.binary())]
                if decode:
                    out.append(pa.array([bpe.decode(c) for c in coded], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=names)
        bpe.forget()

    names = ["key", "n_tokens", "ids"] + ["decoded"] * decode
    kinds = f"key {rows.schema['key'].dataType.simpleString()}, n_tokens long, ids binary" + ", decoded string" * decode
    return rows.mapInArrow(run, kinds).withColumnRenamed("key", id_col)
