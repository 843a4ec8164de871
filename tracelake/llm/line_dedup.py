"""Fuzzy line deduplication by MinHash.

Equal lines are one node. Every distinct line has a MinHash signature over its character shingles; its
bands are keys under which similar lines meet. Short lines are compared by short shingles, of which an
edit breaks few, and long ones by longer shingles, as all short ones occur in any long line. Pairs that
meet are verified by the exact Jaccard similarity of their shingle sets, distributed union-find gives
components, and of each component the first line in order of document and position stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tracelake.llm.components import apart
from tracelake.llm.near_dedup import PARITY, ROWS, SKETCH, SKETCHED, grouped, least_values, parity_words, sketch_words
from tracelake.llm.tables import Bits, stored

SHINGLE = 3
#: Shingle, bands and rows of a band for short lines and for long ones.
TIERS = ((SHINGLE, 22, 6), (5, 18, 6))
#: Lines with fewer different longer shingles than SHORT are short, ones with LONG or more are long. Sets as
#: large as LONG and SHORT differ too much to be alike, so lines of both sorts bridge the two.
SHORT = 100
LONG = 80
#: Characters of the distinct lines that are posted together, and of those whose sets are made at a time: a longer line comes alone.
CHUNK = 1 << 21
CHARACTERS = 1 << 18
#: Postings that a task sorts and deals out together, about, blocks of keys for each shuffle partition, and postings of a block
#: that travel as one row, at most.
POSTED, BLOCKS, PIECE = 1 << 20, 16, 256
BLANKS = " \t\n\x0b\x0c\r"

#: Bits of a code that name its line, or pair of lines, among those at a time.
_LINE = np.uint64(20)
_BODY = np.uint64(64) - _LINE
_INSIDE = np.uint64((1 << int(_BODY)) - 1)
_POWERS = [np.uint64(0x9E3779B97F4A7C15 ** (k + 1) % (1 << 64)) for k in range(max(t[0] for t in TIERS))]
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: From which other bin an empty one takes its value, attempt by attempt.
_DONORS = np.random.default_rng(7).integers(0, SKETCHED, (400, SKETCHED))


def shingles(line: str, size: int = SHINGLE) -> set[str]:
    """Runs of ``size`` characters; the whole line if it is shorter."""
    return {line[i : i + size] for i in range(max(1, len(line) - size + 1))}


def alike(x: str, y: str, percent: int) -> bool:
    """Whether two short lines have similar sets of short shingles, or two long ones of longer shingles."""

    def similar(a: set[str], b: set[str]) -> bool:
        inside = len(a & b)
        return 100 * inside >= percent * (len(a) + len(b) - inside)

    a, b = shingles(x, TIERS[1][0]), shingles(y, TIERS[1][0])
    if max(len(a), len(b)) < SHORT and similar(shingles(x), shingles(y)):
        return True
    return min(len(a), len(b)) >= LONG and similar(a, b)


def _shingle_codes(lines: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the shingles of all lines one after the other, and the number of each line's; no line may be empty."""
    padded = [x if len(x) >= shingle else x.ljust(shingle, "\0") for x in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    ends = np.cumsum(size)
    n = len(codes) - shingle + 1
    if shingle == 5:  # from pairs of pairs
        mixed = codes[:-1] * _POWERS[0]
        mixed += codes[1:]
        mixed = mixed[:-2] * _POWERS[1] + mixed[2:]
        mixed = mixed[:n] * _POWERS[2]
        mixed += codes[shingle - 1 :]
    else:
        mixed = codes[:n].copy()
        for k in range(1, shingle):
            mixed *= _POWERS[0]
            mixed += codes[k : n + k]
    # shingles do not run over the end of a line
    inside = np.ones(len(codes), bool)
    for k in range(1, shingle):
        inside[ends - k] = False
    mixed = mixed[inside[: len(mixed)]]
    mixed ^= mixed >> np.uint64(31)
    mixed *= _MIX
    return mixed, size - shingle + 1


def line_sets(lines: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of each line: sorted codes with the line's number in the upper bits, and the sizes.

    At most 2**20 lines at a time. Of a shingle's code 44 bits are kept, so that two shingles of a line
    of 1000 characters are taken for one about once in 3 * 10**7 lines.
    """
    codes, counts = _shingle_codes(lines, shingle)
    codes >>= _LINE
    codes |= np.repeat(np.arange(len(lines), dtype=np.uint64) << _BODY, counts)
    codes.sort()
    codes = codes[np.append(True, codes[1:] != codes[:-1])]
    starts = np.searchsorted(codes, np.arange(len(lines), dtype=np.uint64) << _BODY)
    return codes, np.diff(np.append(starts, len(codes)))


def _bins(codes: np.ndarray, lines: int) -> np.ndarray:
    """A row of 128 values for each line: one more than the least code in each of 128 ranges of codes, in any order; 0 where there is none."""
    # the upper bits of a code are the line's number, then its range
    own = np.full(lines * SKETCHED, ~np.uint64(0))
    np.minimum.at(own, (codes >> (_BODY - np.uint64(SKETCHED.bit_length() - 1))).view(np.int64), codes & _INSIDE)
    return (own + np.uint64(1)).reshape(lines, SKETCHED)


def _filled(own: np.ndarray) -> np.ndarray:
    """A row of 128 MinHash values for each long line, from its ``_bins``; an empty range takes the value of another one, chosen alike for all lines."""
    out = own.copy()
    row, column = np.nonzero(own == 0)
    for donor in _DONORS:
        if not len(row):
            break
        out[row, column] = own[row, donor[column]]
        empty = out[row, column] == 0
        row, column = row[empty], column[empty]
    return out


def least_codes(codes: np.ndarray, sizes: np.ndarray, tier: int, values: int) -> np.ndarray:
    """At least so many MinHash values of each line of a tier; of long lines 128."""
    return _filled(_bins(codes, len(sizes))) if tier else least_values(codes << _LINE, np.cumsum(sizes) - sizes, values)


def band_keys(codes: np.ndarray, sizes: np.ndarray, tier: int) -> np.ndarray:
    """A row of band keys for each line; the lowest bit of a key tells the tier."""
    return _banded(least_codes(codes, sizes, tier, TIERS[tier][1] * TIERS[tier][2]), tier)


def _banded(least: np.ndarray, tier: int) -> np.ndarray:
    """The band keys from a row of MinHash values for each line."""
    _, bands, band = TIERS[tier]
    least = least[:, : bands * band].reshape(-1, bands, band)
    keys, number = np.zeros((len(least), bands), np.uint64), np.arange(1, bands + 1, dtype=np.uint64)
    for c in range(band):
        keys ^= keys >> np.uint64(29)
        keys *= _MIX
        keys += least[:, :, c]
        keys += number
    return (keys & ~np.uint64(1) | np.uint64(tier)).view(np.int64)


def _named(lines: list[str]) -> tuple[list[bytes], np.ndarray]:
    """128-bit codes of lines, and of these the 61 bits that postings carry; the three lowest bits are free."""
    codes = [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines]
    return codes, np.frombuffer(b"".join(codes), "<i8")[::2] & ~7


def _chunks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list[str]]:
    """The distinct trimmed lines of some texts at a time."""
    held: dict[str, None] = {}
    size = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for line in (text or "").split("\n"):
                line = line.strip(BLANKS)
                if len(line) >= least and line not in held:
                    if size + len(line) > CHUNK and held:
                        yield [*held]
                        held, size = {}, 0
                    held[line], size = None, size + len(line)
    if held:
        yield [*held]


def _tiers(lines: list[str]) -> Iterator[tuple[int, np.ndarray, list[str], np.ndarray, np.ndarray]]:
    """For each tier its number, which lines are in it, these lines, and their sets."""
    short = np.fromiter(map(len, lines), np.int64, len(lines)) < LONG
    for tier in (1, 0):
        own = np.flatnonzero(short if tier == 0 else ~short)
        if len(own):
            some = [lines[k] for k in own]
            codes, sizes = line_sets(some, TIERS[tier][0])
            if tier:  # a line of some length can have few different shingles
                short[own[sizes < SHORT]] = True
                keep = sizes >= LONG
                if not keep.all():
                    codes = codes[np.repeat(keep, sizes)] & _INSIDE
                    codes |= np.repeat(np.arange(keep.sum(), dtype=np.uint64) << _BODY, sizes[keep])
                    own, some, sizes = own[keep], [some[k] for k in np.flatnonzero(keep)], sizes[keep]
            if len(own):
                yield tier, own, some, codes, sizes


def _keyed(lines: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each tier its number, which lines are in it, and their band keys.

    A line with codes in SHORT ranges or more has that many shingles, so it is long without its set being made.
    """
    rest = np.ones(len(lines), bool)
    long = np.fromiter((k for k, x in enumerate(lines) if len(x) > 5 * SHORT // 2), np.int64)
    if len(long):
        codes, counts = _shingle_codes([lines[k] for k in long], TIERS[1][0])
        codes >>= _LINE
        codes |= np.repeat(np.arange(len(long), dtype=np.uint64) << _BODY, counts)
        own = _bins(codes, len(long))
        sure = (own > 0).sum(axis=1) >= SHORT
        rest[long[sure]] = False
        if sure.any():
            yield 1, long[sure], _banded(_filled(own[sure]), 1)
    rest = np.flatnonzero(rest)
    for tier, own, _, codes, sizes in _tiers([lines[k] for k in rest]) if len(rest) else ():
        yield tier, rest[own], band_keys(codes, sizes, tier)


def _lines(texts: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """``doc``, ``mark``, ``at`` and ``code`` (128 bits of the trimmed line) of every line of ``doc``, ``mark`` and ``body``.

    Of lines whose 61-bit codes are among ``wanted`` (and of some others) the ``id``, this code, and the ``line`` too,
    once in ROWS texts.
    """
    bits = Bits(wanted.select(F.shiftright("id", 3).alias("hash")), "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            rows, places, found = [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                for at, line in enumerate((text or "").split("\n")):
                    line = line.strip(BLANKS)
                    if len(line) >= least:
                        rows.append(row)
                        places.append(at)
                        found.append(line)
            codes, own = _named(found)
            asked, seen = np.zeros(len(found), bool), set()
            for k in np.flatnonzero(bits.has(own >> 3)).tolist():
                if codes[k] not in seen:
                    asked[k] = True
                    seen.add(codes[k])
            rows, held = pa.array(rows, pa.int32()), pa.array([x if a else None for x, a in zip(found, asked.tolist())], pa.string())
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(places, pa.int32()), pa.array(codes, pa.binary()), pa.array(own, mask=~asked), held]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "mark", "at", "code", "id", "line"])

    return texts.mapInArrow(run, f"doc {texts.schema['doc'].dataType.simpleString()}, mark long, at int, code binary, id long, line string")


def _postings(texts: DataFrame, least: int) -> DataFrame:
    """``key`` and ``id`` of the lines under every band key that more than two lines have; ``id`` and ``other`` of two that have one alone.

    Lines that share a key within a chunk are known to do so at once: only the first of them is dealt out by
    its key, the others by their ids. So no task gets a very common key's lines, only one of each chunk. A chunk
    here has about POSTED postings. They are dealt out by ranges of keys, in rows of up to PIECE; a task sorts a
    range or a few at a time.
    """

    blocks = BLOCKS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size, seen = [], 0, set()
        for chunk in _chunks(batches, least):
            names, ids = _named(chunk)
            fresh = np.array([k for k, x in enumerate(names) if x not in seen], np.int64)
            seen.update(names)
            lines = [chunk[k] for k in fresh]
            for at in _parts(lines):
                for tier, own, keys in _keyed([lines[k] for k in at]):
                    found.append((keys.ravel(), np.repeat(ids[fresh[at[own]]] | tier, keys.shape[1])))
                    size += keys.size
            if size >= POSTED:
                yield _pieces(*(np.concatenate(x) for x in zip(*found)), blocks)
                found, size, seen = [], 0, set()
        if size:
            yield _pieces(*(np.concatenate(x) for x in zip(*found)), blocks)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if waiting is None else pa.concat_tables([waiting, table])
            # the last block may go on in the next batch
            block = table["block"].to_numpy()
            last = int(np.searchsorted(block, block[-1])) if len(block) else 0
            yield from _opened(table.slice(0, last))
            waiting = table.slice(last)
        if waiting is not None:
            yield from _opened(waiting)

    made = texts.select("body").mapInArrow(run, "block int, keys binary, ids binary")
    return made.repartition("block").sortWithinPartitions("block").mapInArrow(shared, "key long, id long, other long")


def _pieces(keys: np.ndarray, ids: np.ndarray, blocks: int) -> pa.RecordBatch:
    """Postings of distinct lines as ``block``, ``keys`` and ``ids`` (64-bit integers), sorted by key in a row; the third bit of an id tells the way of its posting.

    A block is a range of keys, of ids and keys for all but the first line of a key.
    """
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    first = np.append(True, keys[1:] != keys[:-1])
    # 0: alone in its chunk, 2: the first of several, 4: another
    kind = np.where(first, np.append(~first[1:], False) * 2, 4)
    place = np.where(first, keys.view(np.uint64), (keys ^ ids).view(np.uint64) * _MIX)
    block = ((place >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(block, kind="stable")
    keys, ids, block = keys[order], (ids | kind)[order], block[order]
    new = np.append(True, block[1:] != block[:-1])
    new[::PIECE] = True
    starts = np.flatnonzero(new)
    ends = pa.py_buffer((np.append(starts, len(keys)) * 8).astype(np.int32))
    cut = [pa.Array.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer(x)]) for x in (keys, ids)]
    return pa.RecordBatch.from_arrays([pa.array(block[starts]), *cut], names=["block", "keys", "ids"])


def _opened(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """``_shared`` of whole blocks, as many at a time as have about POSTED / 4 postings, one at least."""
    block = table["block"].to_numpy()
    at = 0
    while at < len(block):
        end = min(at + POSTED // 4 // PIECE, len(block))
        if end < len(block):
            # where the block of row end begins, or else where the first one here ends
            begins = int(np.searchsorted(block, block[end]))
            end = begins if begins > at else int(np.searchsorted(block, block[at], "right"))
        keys, ids = (np.frombuffer(b"".join(table[c].slice(at, end - at).to_pylist()), np.int64) for c in ("keys", "ids"))
        order = np.argsort(keys)
        yield from _shared(keys[order], ids[order])
        at = end


def _shared(keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``key`` and ``id`` of postings, sorted by key, whose key has several ids or is known to have some elsewhere.

    Two ids that have a key for themselves are a row without key, ``id`` and ``other``.
    """
    new = np.append(True, keys[1:] != keys[:-1])
    starts, run = np.flatnonzero(new), np.cumsum(new) - 1
    plain = ids & ~6
    more = np.bincount(run, ids & 6) > 0
    first = plain[starts]
    unlike = plain != first[run]
    second = np.zeros(len(starts), np.int64)
    second[run[unlike]] = plain[unlike]
    several = np.bincount(run, unlike) > 0
    # all that are not the first are the same
    two = several & ~more & ~(np.bincount(run, unlike & (plain != second[run])) > 0)
    keep = ((several & ~two) | more)[run]
    n, m = int(keep.sum()), int(two.sum())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((keys[keep], np.zeros(m, np.int64))), mask=np.arange(n + m) >= n), pa.array(np.concatenate((plain[keep], first[two]))), pa.array(np.concatenate((np.zeros(n, np.int64), second[two])))],
        names=["key", "id", "other"],
    )


def _texts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``code`` and ``line``, once, of the lines whose 61-bit codes are ``wanted``."""
    made = lines.where("line IS NOT NULL").select("code", "id", "line")
    # by id as well, as the join has dealt them out
    return made.join(wanted.hint("merge"), "id", "left_semi").groupBy("id", "code").agg(F.first("line").alias("line")).drop("id")


def _parts(lines: list[str]) -> Iterator[np.ndarray]:
    """Numbers of lines, some at a time, by their characters."""
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
    for at in np.split(np.arange(len(lines)), np.searchsorted(ends, np.arange(CHARACTERS, ends[-1] if len(ends) else 0, CHARACTERS))):
        if len(at):
            yield at


def _sets(lines: DataFrame) -> DataFrame:
    """``id``, ``node``, ``n`` and the sketch of each line (``code``, ``node``, ``line``) in each of its tiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2).to_pylist()
            for at in _parts(found):
                nodes = batch.column(1).take(pa.array(at))
                ids = np.frombuffer(b"".join(batch.column(0).take(pa.array(at)).to_pylist()), "<i8")[::2] & ~7
                for tier, own, _, sets, sizes in _tiers([found[k] for k in at]):
                    sketch = np.hstack((sketch_words(least_codes(sets, sizes, tier, SKETCHED)), parity_words(sets, np.cumsum(sizes) - sizes))).T
                    yield pa.RecordBatch.from_arrays([pa.array(ids[own] | tier), nodes.take(pa.array(own)), pa.array(sizes), *[pa.array(np.ascontiguousarray(word)) for word in sketch]], names=["id", "node", "n", *SKETCH, *PARITY])

    return lines.select("code", "node", "line").mapInArrow(run, "id long, node long, n long, " + ", ".join(f"{s} long" for s in (*SKETCH, *PARITY)))


def _codes(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """``id`` and ``codes`` of lines (by ``node``) in the tier that their id names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for at in _parts(found):
                for tier in (0, 1):
                    own = at[ids[at] & 1 == tier]
                    if len(own):
                        codes, sizes = line_sets([found[k] for k in own], TIERS[tier][0])
                        cut = np.split((codes & _INSIDE).astype("<u8"), np.cumsum(sizes)[:-1])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array([x.tobytes() for x in cut], pa.binary())], names=["id", "codes"])

    return wanted.join(lines.select("node", "line").hint("merge"), "node").select("id", "line").mapInArrow(run, "id long, codes binary")


def similar_pairs(xs: list[str], ys: list[str], percent: int) -> np.ndarray:
    """``alike`` for many pairs of lines together."""
    def similar(own: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
        codes, sizes = line_sets([line for k in own for line in (xs[k], ys[k])], shingle)
        # the number of the pair takes the place of the line's
        met = np.sort((codes >> (_BODY + np.uint64(1)) << _BODY) | (codes & _INSIDE))
        inside = np.bincount((met[1:][met[1:] == met[:-1]] >> _BODY).astype(np.int64), minlength=len(own))
        sizes = sizes.reshape(-1, 2)
        return 100 * inside >= percent * (sizes.sum(1) - inside), sizes

    out, short = np.zeros(len(xs), bool), np.ones(len(xs), bool)
    long = np.array([k for k, (x, y) in enumerate(zip(xs, ys)) if max(len(x), len(y)) >= LONG], np.int64)
    if len(long):
        found, sizes = similar(long, TIERS[1][0])
        out[long] = found & (sizes.min(1) >= LONG)
        short[long] = sizes.max(1) < SHORT
    short = np.flatnonzero(short & ~out)
    if len(short):
        out[short] = similar(short, SHINGLE)[0]
    return out


def _confirmed(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose lines' shingle sets are similar."""
    x, y = (lines.select(F.col("node").alias(e), F.col("line").alias(f"{e}_line")).hint("merge") for e in ("a", "b"))
    both = pairs.join(x, "a").join(y, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep, at = np.zeros(len(xs), bool), 0
            while at < len(xs):
                end, size = at, 0
                while end < len(xs) and (end == at or size + len(xs[end]) + len(ys[end]) <= CHARACTERS):
                    size, end = size + len(xs[end]) + len(ys[end]), end + 1
                keep[at:end] = similar_pairs(xs[at:end], ys[at:end], percent)
                at = end
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return both.select("a", "b", "a_line", "b_line").mapInArrow(run, "a long, b long")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc``, ``mark`` (a hash of the text, which tells rows with equal ids apart) and ``body``."""
    body = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(body).alias("mark"), body.alias("body")).where("doc IS NOT NULL")


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, least_chars: int = 1) -> DataFrame:
    """Lines that repeat an earlier one: ``doc``, ``mark``, ``at`` (from 0) and the place of the line that stays, ``stays``.

    Lines end at a newline and are compared without surrounding blanks. Two are alike if the Jaccard
    similarity of their sets of shingles is at least ``percent`` / 100, and repeats if a chain of alike
    lines joins them. Shingles have 3 characters between lines of fewer than 100 different runs of 5, so that
    an edited character counts from 29 characters on, and 5 between lines of 80 or more: in very long
    lines of one language nearly all runs of 3 recur. A pair at exactly 0.8 is missed about once in 600 times
    between short lines and once in 200 between long ones, one at 0.85 once in thousands;
    these bounds hold for a ``percent`` of 80 or more. Empty lines always stay, as do ones under
    ``least_chars`` characters where that is set; a line shorter than a shingle is one shingle.

    A row is known by its id and ``mark``, a hash of its text: rows with equal ids and different texts are
    documents of their own, in order of their marks, and rows equal in both are one. Rows without an id
    take no part; null and empty texts have no line. Of equal lines the first by document and position stays.
    """
    texts, least = _marked(docs, id_col, text_col), max(least_chars, 1)
    shared = stored(_postings(texts, least), "line-postings")
    postings, pairs = shared.where("key IS NOT NULL").select("key", "id"), shared.where("key IS NULL")
    pairs = pairs.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b"))
    named = shared.select(F.explode(F.array("id", "other")).alias("id")).where("id IS NOT NULL")
    wanted = stored(named.select(F.col("id").bitwiseAND(F.lit(-8)).alias("id")).distinct(), "line-ids", ("id",))
    lines = stored(_lines(texts, wanted, least), "lines", ("code", "id", "line"))
    found = stored(_texts(lines, wanted).withColumn("node", F.monotonically_increasing_id()), "line-texts", ("code", "line", "node"))
    lines = lines.drop("id", "line")
    sets = stored(_sets(found), "line-sets", ("id", "node", *SKETCH, *PARITY))
    groups = grouped(postings, sets, lambda pairs: _confirmed(pairs, found, percent), lambda wanted: _codes(wanted, found), percent, pairs)
    # lines that occur once and are like no other are left behind
    alike_ones = found.select("code", "node").join(groups.hint("merge"), "node").select("code", "component")
    often = lines.groupBy("code").agg(F.count(F.lit(1)).alias("n")).join(alike_ones.hint("merge"), "code", "left").where("n > 1 OR component IS NOT NULL")
    mine = lines.join(apart(often.drop("n")).hint("merge"), "code")
    mine = stored(mine.select("doc", "mark", "at", F.coalesce(F.col("component").cast("string").cast("binary"), "code").alias("component")), "repeated-lines")
    stays = mine.groupBy("component").agg(F.min(F.struct("doc", "mark", "at")).alias("stays"))
    repeats = mine.join(apart(stays).hint("merge"), "component")
    return repeats.where(F.struct("doc", "mark", "at") != F.col("stays")).select("doc", "mark", "at", "stays")


def removed_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, least_chars: int = 1) -> DataFrame:
    """Per document with lines to remove: ``id_col``, ``mark`` and ``removed``, their sorted numbers from 0 (see ``repeated_lines``)."""
    repeats = repeated_lines(docs, id_col=id_col, text_col=text_col, percent=percent, least_chars=least_chars)
    return repeats.groupBy("doc", "mark").agg(F.array_sort(F.collect_set("at")).alias("removed")).withColumnRenamed("doc", id_col)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, least_chars: int = 1) -> DataFrame:
    """All columns of docs, with repeated lines (see ``repeated_lines``) taken out of the texts.

    Every row stays, even if no line of its text does; null texts stay null, empty ones empty, rows without
    an id as they are. Repeated rows, and ones that differ in other columns alone, lose the same lines. Columns of any other
    names keep their values, whatever they are called.
    """
    removed = removed_lines(docs, id_col=id_col, text_col=text_col, percent=percent, least_chars=least_chars)
    text = F.col(text_col).cast("string")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")
    rows = docs.select(row, F.col(id_col).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("body"))
    own = removed.select(F.col(id_col).alias("own_doc"), F.col("mark").alias("own_mark"), "removed")
    joined = rows.join(own.hint("merge"), (F.col("doc") == F.col("own_doc")) & (F.col("mark") == F.col("own_mark")), "left")

    def left(found: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(found) - 1), F.col("removed"))
        return F.array_join(F.transform(kept, lambda i: F.get(found, i)), "\n")

    # the array of one element holds the lines, which are so made once
    lines = F.element_at(F.transform(F.array(F.split("body", "\n")), left), 1)
    body = F.when(F.col("removed").isNull(), F.col("body")).otherwise(lines)
    return joined.select(*[body.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
