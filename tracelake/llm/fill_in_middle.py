"""Fill-in-the-middle: texts cut at two token ends and put together again around markers.

A token is a run of other characters with the white space before it, or white space at the end of a text. The last byte of
every token is a one in a bit vector over the UTF-8 bytes of many texts at a time, packed into 64-bit words,
with a directory of the ones before every block of words. The difference of two ranks is a text's number of tokens, and
selecting a one by its rank gives the byte to cut after. A second vector, of the bytes that begin a
character, turns bytes into code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MARKS = (b"<P>", b"<S>", b"<M>")
#: Words of 64 bits in a block of the directory.
BLOCK = 8
#: Bytes of text that share one bit vector; a longer text has one of its own.
BYTES = 16 << 20
#: Rows that leave a task in one Arrow batch, at most.
ROWS = 2048

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN, _PSM, _SPM = 0, 1, 2
_FORMS = pa.array(["plain", "psm", "spm"])


class RankSelect:
    """A packed bit vector with ranks and selection, for arrays of questions at a time."""

    def __init__(self, bits: np.ndarray):
        blocks = len(bits) // (64 * BLOCK) + 1
        packed = np.zeros(blocks * BLOCK * 8, np.uint8)
        packed[: (len(bits) + 7) // 8] = np.packbits(bits, bitorder="little")
        self.words = packed.view("<u8").reshape(blocks, BLOCK)
        self.counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(self.counts.sum(1))])

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block, word, bit = at // (64 * BLOCK), at // 64 % BLOCK, (at % 64).astype(np.uint64)
        whole = (self.counts[block] * (np.arange(BLOCK) < word[:, None])).sum(1)
        part = self.words[block, word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + whole + np.bitwise_count(part)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position of the k-th one, from 0."""
        block = np.searchsorted(self.before, k, "right") - 1
        upto = np.cumsum(self.counts[block], 1)
        left = k - self.before[block]
        word = (upto <= left[:, None]).sum(1)
        left = left - np.where(word > 0, np.take_along_axis(upto, np.maximum(word - 1, 0)[:, None], 1)[:, 0], 0)
        own = np.ascontiguousarray(self.words[block, word]).view(np.uint8).reshape(-1, 8)
        ones = np.cumsum(np.unpackbits(own, axis=1, bitorder="little"), 1, dtype=np.int16)
        return block * (64 * BLOCK) + word * 64 + (ones <= left[:, None]).sum(1)


def _parts(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have BYTES at most together, and ROWS at most; one longer text is a range of its own."""
    low, n = 0, len(starts) - 1
    while low < n:
        high = int(np.searchsorted(starts, starts[low] + BYTES, "right")) - 1
        high = min(max(high, low + 1), low + ROWS, n)
        yield low, high
        low = high


def _cut(data: np.ndarray, starts: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens of every text, the two bytes to cut at, and the code points of prefix and middle."""
    space = _SPACE[data]
    ends = ~space
    ends[:-1] &= space[1:]
    filled = starts[1:] > starts[:-1]
    ends[starts[1:][filled] - 1] = True
    tokens, chars = RankSelect(ends), RankSelect((data & 0xC0) != 0x80)
    first = tokens.rank(starts)
    n = np.diff(first)
    low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))

    def after(units: np.ndarray) -> np.ndarray:
        cut = starts[:-1].copy()
        some = units > 0
        cut[some] = tokens.select(first[:-1][some] + units[some] - 1) + 1
        return cut

    one, two = after(low), after(high)
    at = [chars.rank(x) for x in (starts[:-1], one, two)]
    return n, one, two, at[1] - at[0], at[2] - at[1]


def _formed(data: memoryview, start: int, one: int, two: int, end: int, form: int) -> bytes:
    prefix, middle, suffix = data[start:one], data[one:two], data[two:end]
    p, s, m = MARKS
    if form == _PSM:
        return b"".join([p, prefix, s, suffix, m, middle])
    return b"".join([s, suffix, p, prefix, m, middle])


def transform(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = "42",
    percent: int = 50,
    spm_percent: int = 80,
) -> DataFrame:
    """Every whole text, plain or with its middle moved to the end.

    Returns per input row: ``id_col``, ``n`` long (tokens), ``form`` string (plain, psm or spm), ``prefix_chars`` and
    ``middle_chars`` long (code points; null where plain) and ``output`` string. Where to cut and what to do follow from the
    SHA-256 of ``seed``, a colon and the id: the same in every run, on every cluster. About ``percent`` of the texts are
    cut, of which about ``spm_percent`` have the suffix first; empty texts and those that hold a marker stay plain.
    Null texts are empty ones, a null id counts as an empty one; repeated rows give repeated rows; other
    columns are neither read nor returned. There is no shuffle: texts are cut in the tasks that read them.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = F.contains(body, F.lit("<P>")) | F.contains(body, F.lit("<S>")) | F.contains(body, F.lit("<M>"))
    groups = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    plain = (body == "") | marked | (groups[2] % 100 >= percent)
    form = F.when(plain, _PLAIN).when(groups[3] % 100 < spm_percent, _SPM).otherwise(_PSM).cast("int")
    rows = docs.select(F.col(id_col).alias("key"), body.alias("body"), groups[0].alias("h1"), groups[1].alias("h2"), form.alias("form"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            texts = batch.column("body").cast(pa.large_string())
            _, where, content = texts.buffers()
            every = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            held = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
            for low, high in _parts(every):
                starts = every[low : high + 1] - every[low]
                data = held[every[low] : every[high]]
                h1, h2, forms = (batch.column(c).slice(low, high - low).to_numpy() for c in ("h1", "h2", "form"))
                n, one, two, prefix, middle = _cut(data, starts, h1, h2)
                view = memoryview(data)
                outputs = [
                    bytes(view[s:e]) if f == _PLAIN else _formed(view, s, a, b, e, f)
                    for s, a, b, e, f in zip(starts[:-1].tolist(), one.tolist(), two.tolist(), starts[1:].tolist(), forms.tolist())
                ]
                plain = forms == _PLAIN
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(low, high - low), pa.array(n, pa.int64()), _FORMS.take(pa.array(forms)),
                        pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), pa.array(outputs, pa.binary()).cast(pa.string()),
                    ],
                    names=["key", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return rows.mapInArrow(run, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("key", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given. A text that holds a marker is plain, so each marker is found once."""
    def rebuilt(*order: int) -> Column:
        cut = F.array(F.split(output, "<[PSM]>", 4))
        return F.get(F.transform(cut, lambda x: F.concat(*[F.get(x, F.lit(i)) for i in order])), F.lit(0))

    # psm has prefix, suffix, middle; spm has suffix, prefix, middle
    return F.when(form == "psm", rebuilt(1, 3, 2)).when(form == "spm", rebuilt(2, 3, 1)).otherwise(output)
