"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed character n-grams (one to three letters, blanks for what lies
between words), weighted by TF-IDF and normalised. The training texts of each language are clustered,
and a text takes the language of the centroid with the largest cosine. Texts far from every centroid
are rejected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracelake.llm.tables import stored

#: Dimensions of the hashed n-gram vectors.
DIMS = 8192
#: Texts whose vectors are held at a time.
ROWS = 256
UNKNOWN = "und"
#: Classes of text length, by the bits of the number of different n-grams: a word many times over says no more than once.
LENGTHS = DIMS.bit_length() + 1
#: Of a language's own texts of a length, about this share lies within reach.
WITHIN = 0.998
#: Members of a length class from which its reach is learned, if there are so many.
MEMBERS = 100
#: Steps that a distance of 1 is counted in.
STEPS = 50_000
#: Dimensions of a sum that travel as one row.
SLICE = 2048

_PRIMES = np.array([2654435761, 2246822519, 3266489917], np.uint32)
_LETTERS: list[np.ndarray] = []
_LOGS = np.log1p(np.arange(256))


def _letters() -> np.ndarray:
    """Whether each code point is a letter; built once in a Python worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _grams(text: str | None) -> np.ndarray | None:
    """Dimensions of a text's n-grams, repeated as they occur; None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    codes = codes[letter | np.append(True, letter[:-1])]
    codes = np.concatenate(([np.uint32(32)], codes, [np.uint32(32)])).astype(np.uint32)
    one = (codes + np.uint32(1)) * _PRIMES[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _PRIMES[1] + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _PRIMES[2] + one[2:]
    mixed = np.concatenate((one, two, three))
    mixed ^= mixed >> np.uint32(16)
    mixed *= np.uint32(2146121005)
    return mixed >> np.uint32(32 - DIMS.bit_length() + 1)


def _logs(counts: np.ndarray) -> np.ndarray:
    """Logarithms of counts plus one, the usual ones from a table."""
    return _LOGS[counts] if counts.max() < len(_LOGS) else np.log1p(counts)


def _sparse(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``_grams`` finds in many texts (up to 2**31 / ``DIMS``) at once: which of them have a letter, where each one's row starts, its different dimensions in order, and how often each occurs."""
    # a lone surrogate on either side of every text: no letter, in no text, and no letter's case looks past it
    codes = np.frombuffer(("\ud800" + "\ud800\ud800".join(texts) + "\ud800").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter, edge = _letters()[codes], codes == 0xD800
    keep = letter | edge
    keep[1:] |= letter[:-1] | edge[:-1]
    text = (np.cumsum(edge, dtype=np.int32) - 1) >> 1
    some = np.zeros(len(texts), bool)
    some[text[letter]] = True
    keep &= some[text]
    if not keep.any():
        return np.zeros(0, np.int64), *[np.zeros(0, np.int64)] * 3
    codes, text = np.where(letter, codes, np.uint32(32))[keep].astype(np.uint32), text[keep]
    one = (codes + np.uint32(1)) * _PRIMES[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _PRIMES[1] + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _PRIMES[2] + one[2:]
    # n-grams of one text only
    second, third = text[1:] == text[:-1], text[2:] == text[:-2]
    mixed = np.concatenate((one, two[second], three[third]))
    mixed ^= mixed >> np.uint32(16)
    mixed *= np.uint32(2146121005)
    key = np.concatenate((text, text[1:][second], text[2:][third])) * np.int32(DIMS)
    key |= (mixed >> np.uint32(32 - DIMS.bit_length() + 1)).view(np.int32)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    counts, key = np.diff(first, append=len(key)), key[first]
    found = np.flatnonzero(some)
    return found, np.searchsorted(key, (found * DIMS).astype(np.int32)), (key & np.int32(DIMS - 1)).astype(np.int64), counts


def _cosines(dims: np.ndarray, counts: np.ndarray, start: np.ndarray, idf: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Cosines of sparse TF-IDF rows with centroids, clipped to 0 to 1."""
    value = _logs(counts) * idf[dims]
    norm = np.sqrt(np.add.reduceat(value * value, start))
    return np.clip(np.stack([np.add.reduceat(value * column[dims], start) for column in across], 1) / norm[:, None], 0, 1)


def _vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised TF-IDF rows, and the texts' length classes: 0 without a letter."""
    out, length = np.zeros((len(texts), DIMS), np.float32), np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        grams = _grams(text)
        if grams is not None:
            dims, counts = _counted(grams)
            length[row] = len(dims).bit_length()
            out[row, dims] = _logs(counts) * idf[dims]
    has = length > 0
    out[has] /= np.linalg.norm(out[has], axis=1, keepdims=True)
    return out, length


def _bits(n: np.ndarray) -> np.ndarray:
    """Bit lengths of positive numbers."""
    return np.frexp(n)[1].astype(np.int64)


def _extracts(text: str) -> list[str]:
    """The text, and pieces of it of 1, 2 to 3, 4 to 7 characters and so on, from places that its checksum picks."""
    pick = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    out = [text]
    for bits in range(1, len(text).bit_length()):
        size = int(pick.integers(1 << (bits - 1), 1 << bits))
        at = int(pick.integers(len(text) - size + 1))
        out.append(text[at : at + size])
    return out


def _reach(found: dict[int, tuple[float, int]]) -> np.ndarray:
    """The distance from which texts of each length are rejected, from the quantile and number of members by length class.

    The fewer members, the more is added, up to half the way to 1. A length of few members takes the
    reach of the next shorter one that has enough, or else of the next longer one.
    """
    enough = min(MEMBERS, max((n for _, n in found.values()), default=0) / 2)
    known = sorted(c for c, (_, n) in found.items() if n >= enough)
    out = np.ones(LENGTHS)
    for c in range(LENGTHS if known else 0):
        far, n = found[max((k for k in known if k <= c), default=known[0])]
        out[c] = far + (1 - far) * min(0.5, 2 / n**0.5)
    return out


@dataclass(frozen=True)
class Centroids:
    """What the fit learned; ``reach`` is the distance from which each centroid rejects, by length class."""

    idf: np.ndarray
    languages: list[str]
    weights: np.ndarray
    reach: np.ndarray


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different dimensions in order, and how often each occurs."""
    counts = np.bincount(grams, minlength=DIMS)
    dims = np.flatnonzero(counts)
    return dims, counts[dims]


def _weighted(dims: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse normalised TF-IDF rows one after another: dimensions, values, and where each row starts. No row is empty."""
    size = np.array([len(d) for d in dims])
    start, at = np.concatenate([[0], size[:-1].cumsum()]), np.concatenate(dims)
    value = _logs(np.concatenate(counts)) * idf[at]
    value /= np.repeat(np.sqrt(np.add.reduceat(value * value, start)), size)
    return at, value, start


def _pack(dims: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    return dims.astype("<u2").tobytes(), counts.astype("<u1" if counts.max() < 256 else "<u4").tobytes()


def _unpack(dims: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(dims, "<u2").astype(np.int64), np.frombuffer(counts, "<u1" if 2 * len(counts) == len(dims) else "<u4")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _near(idf: np.ndarray, place: dict[str, int], centres: np.ndarray, kept: np.ndarray):
    """An iterator's body for one pass: of every batch of rows their languages' places, sparse values, starts and cosines with their own language's centres.

    centres: language, centre, dimension; kept: which of them exist.
    """
    across = np.ascontiguousarray(centres.transpose(1, 0, 2)).reshape(centres.shape[1], -1)

    def read(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                packed = list(zip(batch.column("dims").to_pylist(), batch.column("counts").to_pylist()))
                rows = [_unpack(*p) for p in packed]
                lang = np.array([place[x] for x in batch.column("lang").to_pylist()])
                at, value, start = _weighted([d for d, _ in rows], [c for _, c in rows], idf)
                place_of = np.repeat(lang * DIMS, np.diff(start, append=len(at))) + at
                near = np.stack([np.add.reduceat(value * column[place_of], start) for column in across], 1)
                yield packed, lang, at, value, start, np.where(kept[lang], near, -np.inf)

    return read


def _means(table: DataFrame, idf: np.ndarray, names: list[str], centres: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of all rows by language and nearest centre, and how many rows each has: every task adds up its own, Spark those of all tasks."""
    place, (langs, k) = {x: i for i, x in enumerate(names)}, kept.shape
    read = _near(idf, place, centres, kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((langs * k, DIMS)), np.zeros(langs * k, np.int64)
        for _, lang, at, value, start, near in read(batches):
            own = lang * k + near.argmax(1)
            n += np.bincount(own, minlength=langs * k)
            sums += np.bincount(np.repeat(own, np.diff([*start, len(at)])) * DIMS + at, value, langs * k * DIMS).reshape(-1, DIMS)
        told = [(c, s) for c in np.flatnonzero(n).tolist() for s in range(0, DIMS, SLICE)]
        if told:
            columns = [pa.array([c for c, _ in told]), pa.array([s for _, s in told]), pa.array([n[c] for c, _ in told], pa.int64()), pa.array([sums[c, s : s + SLICE].tobytes() for c, s in told], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["c", "s", "n", "v"])

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": group["c"].iloc[:1], "s": group["s"].iloc[:1], "n": [group["n"].sum()], "v": [np.sum([np.frombuffer(v) for v in group["v"]], axis=0).tobytes()]})

    kinds = "c long, s long, n long, v binary"
    sums, n = np.zeros((langs * k, DIMS)), np.zeros(langs * k, np.int64)
    for r in table.mapInArrow(run, kinds).groupBy("c", "s").applyInPandas(added, kinds).collect():
        sums[r.c, r.s : r.s + SLICE], n[r.c] = np.frombuffer(r.v), r.n
    return sums.reshape(langs, k, DIMS), n.reshape(langs, k)


def _farthest(table: DataFrame, idf: np.ndarray, names: list[str], centres: np.ndarray, kept: np.ndarray) -> dict[int, np.ndarray]:
    """Of each language the row that is farthest from all its centres, of equal ones the first by content."""
    read = _near(idf, {x: i for i, x in enumerate(names)}, centres, kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for packed, lang, _, _, _, near in read(batches):
            far = near.max(1)
            for x in np.unique(lang).tolist():
                least = far[lang == x].min()
                row = (float(least), *min(packed[i] for i in np.flatnonzero((lang == x) & (far == least))))
                best[x] = min(best.get(x, row), row)
        if best:
            columns = [pa.array([*best], pa.int64()), *[pa.array([b[i] for b in best.values()], kind) for i, kind in enumerate((pa.float64(), pa.binary(), pa.binary()))]]
            yield pa.RecordBatch.from_arrays(columns, names=["x", "near", "dims", "counts"])

    told = table.mapInArrow(run, "x long, near double, dims binary, counts binary")
    out = {}
    for r in told.groupBy("x").agg(F.min(F.struct("near", "dims", "counts")).alias("b")).collect():
        dims, counts = _unpack(bytes(r.b.dims), bytes(r.b.counts))
        at, value, _ = _weighted([dims], [counts], idf)
        out[r.x] = np.zeros(DIMS)
        out[r.x][at] = value
    return out


def _clusters(table: DataFrame, idf: np.ndarray, names: list[str], k: int, rounds: int) -> list[np.ndarray]:
    """Each language's centroids over all its rows: spherical k-means from a farthest-first start, all languages in each pass."""
    first = np.arange(k) == 0
    kept = np.tile(first, (len(names), 1))
    sums, n = _means(table, idf, names, np.zeros((len(names), k, DIMS)), kept)
    rows, centres = n[:, 0], sums / np.maximum(n, 1)[:, :, None]
    for c in range(1, k):
        for x, row in _farthest(table, idf, names, centres, kept).items():
            if rows[x] > c:
                centres[x, c], kept[x, c] = row, True
    for _ in range(rounds):
        centres = _unit(centres)
        sums, n = _means(table, idf, names, centres, kept)
        new = np.where(n[:, :, None] > 0, sums / np.maximum(n, 1)[:, :, None], centres)
        # rows that stay where they are leave the centroids where they are
        done = np.abs(_unit(new) - centres).max() < 1e-9
        centres = new
        if done:
            break
    return [_unit(c[k_]) for c, k_ in zip(centres, kept)]


def fit(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    clusters: int = 4,
    rounds: int = 12,
) -> Centroids:
    """Learns from rows with a language and at least one letter.

    All of it comes from all rows. Their n-grams are counted once and written; document frequencies, and every pass of
    the clustering, read that table, and tasks send sums by centroid. How far a text of some length may lie from its
    language is a quantile over all rows and pieces cut out of them, without those nearest to another language, so
    few odd or mislabelled rows do not widen it; distances are rounded up to ``STEPS`` steps and counted. Where no row has both, nothing
    is learned, and every text will be rejected.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("body"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND body IS NOT NULL")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                out = [(lang, *_pack(*_counted(grams))) for text, lang in zip(*[c.to_pylist() for c in batch.columns]) if (grams := _grams(text)) is not None]
                columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "dims", "counts"])

    table = stored(rows.mapInArrow(coded, "lang string, dims binary, counts binary"), "language-grams")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            for dims in batch.column(0).to_pylist():
                seen[np.frombuffer(dims, "<u2")] += 1
            seen[DIMS] += batch.num_rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["dim", "n"])

    counted = table.select("dims").mapInArrow(frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMS + 1)
    for dim, n in counted:
        df[dim] = n
    if not df[DIMS]:
        return Centroids(np.ones(DIMS), [], np.zeros((0, DIMS), np.float32), np.zeros((0, LENGTHS)))
    idf = np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1
    names = sorted(r.lang for r in table.select("lang").distinct().collect())
    found = [(lang, bytes(c.astype("<f4"))) for lang, own in zip(names, _clusters(table, idf, names, clusters, rounds)) for c in own]
    found.sort()
    languages = [lang for lang, _ in found]
    weights = np.array([np.frombuffer(w, "<f4") for _, w in found])
    across, place = weights.astype(float), {x: i for i, x in enumerate(names)}
    lang_of = np.array([place[x] for x in languages])

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS // 16):
                part = batch.slice(low, ROWS // 16)
                pieces = [(place[lang], x) for text, lang in zip(*[c.to_pylist() for c in part.columns]) for x in _extracts(text)]
                found, start, dims, counts = _sparse([x for _, x in pieces])
                if not len(found):
                    continue
                near = _cosines(dims, counts, start, idf, across)
                best = near.argmax(1)
                own = lang_of[best] == np.array([x for x, _ in pieces])[found]
                length = _bits(np.diff(start, append=len(dims)))
                far = np.ceil((1 - near.max(1)) * STEPS).astype(np.int64)
                code = ((lang_of[best] * LENGTHS + length) * (STEPS + 1) + far)[own]
                codes, back = np.unique(np.concatenate([codes, code]), return_inverse=True)
                many = np.bincount(back, np.concatenate([many, np.ones(len(code), np.int64)]), len(codes)).astype(np.int64)
        if len(codes):
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(many)], names=["code", "n"])

    told = rows.mapInArrow(distances, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    kind = F.floor(F.col("code") / (STEPS + 1))
    by_kind = told.groupBy(kind.alias("kind")).agg(F.percentile(F.col("code") % (STEPS + 1) / STEPS, F.lit(WITHIN), F.col("n")).alias("far"), F.sum("n").alias("n"))
    by_lang: dict[str, dict[int, tuple[float, int]]] = {}
    for r in by_kind.collect():
        by_lang.setdefault(names[r.kind // LENGTHS], {})[r.kind % LENGTHS] = (r.far, r.n)
    reach = {lang: _reach(by_lang.get(lang, {})) for lang in names}
    return Centroids(idf, languages, weights, np.array([reach[lang] for lang in languages]))


def _judged(texts: list[str | None], model: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, cosine and whether it is rejected, of some texts."""
    names = np.array([*model.languages, UNKNOWN], object)
    weights, reach = (model.weights, model.reach) if model.languages else (np.zeros((1, DIMS), np.float32), np.zeros((1, LENGTHS)))
    x, length = _vectors(texts, model.idf)
    has = (length > 0) & bool(model.languages)
    near = np.clip((x @ weights.T).astype(float), 0, 1)
    best = near.argmax(1)
    score = np.where(has, near[np.arange(len(best)), best], 0.0)
    rejected = ~has | (1 - score > reach[best, length])
    return names[np.where(has, best, len(model.languages))], score, rejected


def predict(docs: DataFrame, model: Centroids, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The nearest centroid's language for every whole text.

    Returns per input row: ``id_col``, ``lang_pred`` string, ``score`` double (the cosine, 0 to 1) and
    ``rejected`` boolean: without a letter, or farther from the language than nearly all of its own
    texts of that length. Null texts, empty ones and ones without a letter get
    ``und``, 0.0 and true. Of equal cosines the language first in code point order wins. Repeated rows
    give repeated rows, a null id stays null; other columns are neither read nor returned. There is
    no shuffle.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lang, score, rejected = _judged(part.column(1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["key", "lang_pred", "score", "rejected"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", id_col)


def accepted(text: Column, model: Centroids) -> Column:
    """Whether ``predict`` does not reject a text: for filters that keep all columns, without a shuffle."""

    @F.arrow_udf("boolean")
    def judge(texts: pa.Array) -> pa.Array:
        parts = [_judged(texts.slice(at, ROWS).to_pylist(), model)[2] for at in range(0, len(texts), ROWS)]
        return pa.array(~np.concatenate([np.zeros(0, bool), *parts]))

    return judge(text.cast("string"))
