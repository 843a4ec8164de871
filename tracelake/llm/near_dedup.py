"""Near-duplicate documents by an inverted join over MinHash coordinates.

Every document's set of word shingles gets a signature. A (coordinate, value) pair is a posting key.
Two signatures that agree in at least ``matches`` of K coordinates share one of the first
K - matches + 1 keys of either, in any common order of keys. With rare keys first, only that prefix
is posted: keys that nobody else has use up most of it, and frequent keys are skipped. Pairs that
meet in a list have the collisions of their sketches counted (two bits of each of 128 coordinates); pairs above
the match threshold are kept and confirmed on the texts themselves. Where sketches have parities, pairs that
differ in more of them than similar sets can are dropped as well; that loses none.

A posting list is never expanded to all its pairs. First every member is merged with the smallest
one, then those of lists that lie in several components with the list's medoid; confirmed pairs give
components, and pairs within a component are skipped from then on. The lists that
still lie in several components are merged member by member, in blocks of bounded size; members with a
pair of different components that reaches the match threshold get their whole sets, and similar
pairs become links until what is similar hangs together. So no link between different components is lost. Members of
a long list are copied to the units of its blocks: up to four times, and beyond 98,304 members once for each 32,768
of them. Within a unit pairs are compared in pieces, by 32 bytes each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tracelake.llm.components import apart, connected
from tracelake.llm.tables import only, stored

#: Coordinates that are posted, and coordinates of a sketch with their bits.
COORDINATES = 64
SKETCHED = 128
BITS = 2
SKETCH = ("s0", "s1", "s2", "s3")
#: Columns that the sketches of some callers have besides: for each of so many bits whether an odd number of the set's codes falls on it.
PARITY = tuple(f"p{k}" for k in range(8))
#: Members of a block of a posting list, about, and pairs that are compared at a time. Longer lists are dealt into blocks
#: of a third of their members, up to LARGEST, so that no member of a list of up to three times LARGEST has more than four copies.
BLOCK_SETS, LARGEST = 1000, 1 << 15
PAIRS = 1 << 19
#: Lists with more members are first compared with their medoids.
FEW = 8
#: Lists are split anew after links that are more than one for so many members.
FEW_LINKS = 50
#: Pairs whose whole sets are compared before those that hang together meanwhile are left out.
CHECKED = 1024
#: Codes of the pairs whose sets are merged at a time, about.
MERGED = 1 << 18
ROWS = 512

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(0, 1 << 31, 160, np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, 160, np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EVEN = 0x5555555555555555


def words(text: str | None) -> list[bytes]:
    """Words of a whole text with A-Z in lower case, in UTF-8; they end at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    """The set of runs of ``size`` words; the whole sequence if there are fewer, nothing without words."""
    found = words(text)
    if len(found) < size:
        return {tuple(found)} if found else set()
    return set(zip(*[found[i:] for i in range(size)]))


def _shingle_codes(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit codes of the text's shingles."""
    found = words(text)
    code = xxhash.xxh3_64_intdigest
    codes = np.fromiter(map(code, found), np.uint64, len(found))
    out = codes[: max(len(codes) - size + 1, min(len(codes), 1))]
    for i in range(1, min(size, len(codes))):
        out = (out ^ (out >> np.uint64(29))) * _MIX + codes[i : i + len(out)]
    return np.unique((out ^ (out >> np.uint64(32))) * _MIX)


def least_values(codes: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """A row of at most 160 MinHash values for each set; the sets' codes lie one after the other, none is empty."""
    short = (codes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((coordinates, len(starts)), np.uint32)
    for c in range(coordinates):
        out[c] = np.minimum.reduceat(short * _FACTORS[c] + _SHIFTS[c], starts)
    return np.ascontiguousarray(out.T)


def sketch_words(least: np.ndarray) -> np.ndarray:
    """Two bits of each of 128 MinHash values, as four 64-bit integers a row."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, len(SKETCH), 64 // BITS)
    return np.bitwise_or.reduce(low << np.arange(0, 64, BITS, dtype=np.uint64), axis=2).view(np.int64)


def threshold(coordinates: int, percent: int, bits: int = 32) -> int:
    """Agreements of so many bits of each value that a pair of this similarity reaches but for about three times in a million."""
    share = percent / 100 + (1 - percent / 100) / 2**bits
    return max(1, int(coordinates * share - 4.6 * (coordinates * share * (1 - share)) ** 0.5))


def parity_words(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The parities of each set, as 64-bit integers a row; the sets' distinct codes lie one after the other.

    Two sets differ in no more parities than there are codes that only one of them has.
    """
    bits = 64 * len(PARITY)
    ends, out = np.append(starts[1:], len(codes)), np.empty((len(starts), len(PARITY)), np.int64)
    for at in range(0, len(starts), ROWS):
        some = slice(at, at + ROWS)
        n, own = len(starts[some]), codes[starts[at] : ends[some][-1]]
        row = np.repeat(np.arange(0, n * bits, bits), ends[some] - starts[some])
        odd = np.bincount(row + ((own >> np.uint64(20)) & np.uint64(bits - 1)).view(np.int64), minlength=n * bits).astype(np.uint8) & 1
        out[some] = np.packbits(odd.reshape(n, bits), axis=1).view(np.int64)
    return out


def signatures(docs: DataFrame, size: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n`` (set size), ``same`` (a 128-bit code of the set), ``signature`` and the sketch of every row; no shuffle.

    An empty set has nulls for code, signature and sketch.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = [_shingle_codes(t, size) for t in part.column(1).to_pylist()]
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                least, sketch = np.zeros((0, COORDINATES), np.uint32), np.zeros((len(sets), len(SKETCH)), np.int64)
                if len(full):
                    values = least_values(np.concatenate([sets[k] for k in full]), np.cumsum(sizes[full]) - sizes[full], SKETCHED)
                    least, sketch[full] = values[:, :COORDINATES], sketch_words(values)
                ends = np.concatenate(([0], np.cumsum((sizes > 0) * COORDINATES))).astype(np.int32)
                empty = sizes == 0
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(least).view(np.int32).ravel()), mask=pa.array(empty))
                same = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), listed, *[pa.array(sketch[:, k], mask=empty) for k in range(len(SKETCH))]]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "same", "signature", *SKETCH])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n long, same binary, signature array<int>, " + ", ".join(f"{s} long" for s in SKETCH))


def _postings(sets: DataFrame, coordinates: int, percent: int) -> DataFrame:
    """``key`` and ``id``: each set under the keys of its prefix that others have too."""
    keys = sets.select("id", F.posexplode("signature").alias("c", "v"))
    keys = keys.select("id", F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    often = apart(keys.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1"))
    shared = keys.join(often.hint("merge"), "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("keys"))
    # keys that nobody else has come first in the order and take up places of the prefix
    places = F.size("keys") - threshold(coordinates, percent) + 1
    return shared.where(places > 0).select("id", F.explode(F.slice("keys", F.lit(1), places)).alias("k")).select(F.col("k.key").alias("key"), "id")


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _agreements(x: str, y: str) -> Column:
    """How many coordinates of two sketches agree."""
    differ = [F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}")) for s in SKETCH]
    missed = [F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(_EVEN))) for d in differ]
    return F.lit(SKETCHED) - sum(missed[1:], missed[0])


def _within(differ, n, m, percent: int):  # noqa: ANN001, ANN202 - arrays or columns
    """Whether sets of sizes n and m that differ in so many codes, or more, can reach the similarity."""
    return differ * (100 + percent) <= (n + m) * (100 - percent)


def _sketch_of(columns: list[str]) -> list[str]:
    """The columns of sketches among these."""
    return [c for c in columns if c in SKETCH or c in PARITY]


def _agreeing(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The nodes (a, b) of those pairs of ids whose sketches agree often enough."""
    x, y = (sets.select(F.col("id").alias(e), F.struct("node", "n", *_sketch_of(sets.columns)).alias(f"{e}_set")) for e in ("a", "b"))
    both = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b")
    close = (_agreements("a_set", "b_set") >= threshold(SKETCHED, percent, BITS)) & _alike(F.col("a_set.n"), F.col("b_set.n"), percent)
    if PARITY[0] in sets.columns:
        differ = [F.bit_count(F.col(f"a_set.{p}").bitwiseXOR(F.col(f"b_set.{p}"))) for p in PARITY]
        close = close & _within(sum(differ[1:], differ[0]), F.col("a_set.n"), F.col("b_set.n"), percent)
    found = both.where(close).select(F.col("a_set.node").alias("a"), F.col("b_set.node").alias("b")).where("a != b")
    return stored(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "candidate-pairs")


def _confirmed(close: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole shingle sets are similar. Only texts of such pairs are dealt out."""
    named = stored(close.select(F.col("a").alias("id")).unionByName(close.select(F.col("b").alias("id"))).distinct(), "paired")
    texts = stored(only(docs, named), "paired-texts")
    both = close.join(texts.select(F.col("id").alias("a"), F.col("body").alias("x")).hint("merge"), "a").join(texts.select(F.col("id").alias("b"), F.col("body").alias("y")).hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            keep = []
            for k in range(batch.num_rows):
                text = y[k].as_py()
                if text != last:
                    last, held = text, shingles(text, size)
                own = shingles(x[k].as_py(), size)
                inside = len(own & held)
                keep.append(100 * inside >= percent * (len(own) + len(held) - inside))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = close.schema["a"].dataType.simpleString()
    return both.select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def grouped(
    postings: DataFrame,
    sets: DataFrame,
    confirmed: Callable[[DataFrame], DataFrame],
    codes: Callable[[DataFrame], DataFrame],
    percent: int,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Components (``node``, ``component``) of the similar pairs among those that share a key.

    postings: ``key`` and ``id``. sets: ``id``, its ``node`` in the graph, ``n`` (set size) and the sketch, with
    parities or without, for all ids of the postings. confirmed: gives those of pairs (``a``, ``b``) of nodes that are links. codes: gives
    ``id`` and ``codes`` (sorted 64-bit codes of the set, binary) of rows with ``id`` and ``node``. pairs: pairs
    (``a``, ``b``) of ids that share keys of which the postings have none.
    """
    leader = apart(postings.groupBy("key").agg(F.min("id").alias("b"))).hint("merge")
    star = postings.join(leader, "key").where("id != b").select(F.col("id").alias("a"), "b")
    star = stored((star if pairs is None else star.unionByName(pairs)).distinct(), "star-pairs")
    groups = stored(connected(stored(confirmed(_agreeing(star, sets, percent)), "links")), "components")

    def joined(more: DataFrame) -> DataFrame:
        # components stand for the links that made them
        links = groups.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        return stored(connected(links.unionByName(more)), "components")

    # the only pair of a list of two has been tried
    left = _split(postings, sets, groups, 3)
    near = stored(_to_medoids(left, percent), "candidate-pairs")
    if not near.isEmpty():
        links = stored(confirmed(near), "links")
        groups = joined(links)
        # few links leave nearly all lists as they are; members that they join are only compared once more
        if links.count() * FEW_LINKS > left.count():
            left = _split(left.select(F.explode("lists.key").alias("key"), "id"), sets, groups, 3)
    met = stored(_across(left, percent), "merged-lists")
    if met.isEmpty():
        return groups
    met = stored(_once(met, percent), "merged-once")
    more = stored(_links(met, stored(codes(met.select("id", "node").distinct()), "set-codes"), percent), "links")
    return groups if more.isEmpty() else joined(more)


def _split(postings: DataFrame, sets: DataFrame, groups: DataFrame, least: int) -> DataFrame:
    """Sets and components of ids, with their ``lists`` that have ``least`` members or more and lie in several components."""
    where = sets.join(groups.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = stored(postings.join(where.select("id", "component").hint("merge"), "id").select("key", "id", "component"), "placed-postings")
    counts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"))
    lists = counts.groupBy("key").agg(F.max(F.struct("members", "component")).alias("bulk"), F.sum("members").alias("members"), F.count(F.lit(1)).alias("components"))
    lists = lists.where((F.col("components") > 1) & (F.col("members") >= least)).select("key", "members", "bulk")
    left = placed.join(apart(lists).hint("merge"), "key").groupBy("id").agg(F.min("component").alias("component"), F.collect_list(F.struct("key", "members", "bulk")).alias("lists"))
    return stored(left.join(sets.hint("merge"), "id"), "split-sets")


def _listed(left: DataFrame) -> DataFrame:
    """A row for each id and list."""
    return left.withColumn("list", F.explode("lists")).select("id", "node", "component", "n", *_sketch_of(left.columns), "list.*")


_UNIT = ("key", "sides", "x", "y")


def _units(rows: DataFrame, merge: Callable[[pa.Table, np.ndarray, int], Iterator[pa.RecordBatch]], percent: int, columns: tuple[str, ...], kinds: str) -> DataFrame:
    """What ``merge`` makes of units, the rows of equal key, sides, x and y; a task holds a unit or an Arrow batch at a time."""
    rows = rows.select(*_UNIT, *columns).repartition(*_UNIT).sortWithinPartitions(*_UNIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if waiting is None else pa.concat_tables([waiting, table])
            starts = _starts(table)
            yield from merge(table.slice(0, starts[-1]), starts[:-1], percent)
            waiting = table.slice(starts[-1])
        if waiting is not None:
            yield from merge(waiting, _starts(waiting), percent)

    return rows.mapInArrow(run, kinds)


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _to_medoids(left: DataFrame, percent: int) -> DataFrame:
    """Members of longer lists with the medoid of their block of the list, the one closest to what most sketches there say.

    Copies that differ from a common origin are closer to it, and to what is like it, than to each other.
    """
    zero = F.lit(0)
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.ceil(F.col("members") / BLOCK_SETS)).cast("int")
    rows = _listed(left).where(F.col("members") > FEW).withColumns({"sides": zero, "x": block, "y": zero})
    kind = left.schema["node"].dataType.simpleString()
    return _pairs(_units(rows, _medoids, percent, ("node", "component", "n", *_sketch_of(left.columns)), f"a {kind}, b {kind}"))


def _across(left: DataFrame, percent: int) -> DataFrame:
    """Those members of each unit of a list whose sketches agree with one of another component there: no more rows than members.

    A list of more than BLOCK_SETS members is dealt into blocks, a unit has one or two. Members of its largest
    component are not compared with each other, so their blocks meet those of the other members only. Blocks
    grow with the list: a task walks through a unit's pairs in pieces and holds its members once.
    """
    bulk = F.col("component") == F.col("bulk.component")
    block = F.least(F.greatest(F.col("members") / 3, F.lit(BLOCK_SETS)), F.lit(LARGEST))
    large = F.ceil(F.col("bulk.members") / block).cast("int")
    rest = F.ceil((F.col("members") - F.col("bulk.members")) / block).cast("int")
    h = F.pmod(F.xxhash64("id", F.lit("block")), F.when(bulk, large).otherwise(rest)).cast("int")

    def unit(sides: int, x: Column, y: Column) -> Column:
        return F.struct(F.lit(sides).alias("sides"), x.cast("int").alias("x"), y.cast("int").alias("y"))

    own = F.transform(F.sequence(F.lit(0), rest - 1), lambda o: unit(2, F.col("h"), o))
    other = F.concat(
        F.transform(F.sequence(F.lit(0), large - 1), lambda o: unit(2, o, F.col("h"))),
        F.transform(F.sequence(F.lit(0), rest - 1), lambda o: unit(1, F.least("h", o), F.greatest("h", o))),
    )
    units = F.when(F.col("members") <= BLOCK_SETS, F.array(unit(1, F.lit(0), F.lit(0)))).when(bulk, own).otherwise(other)
    rows = _listed(left).withColumn("h", h).withColumn("bulky", bulk).withColumn("unit", F.explode(units))
    return _units(rows.select("*", "unit.*"), _meetings, percent, _member(left), _member_kinds(left))


def _member(rows: DataFrame) -> tuple[str, ...]:
    return ("bulky", "id", "node", "component", "n", *_sketch_of(rows.columns))


def _member_kinds(rows: DataFrame) -> str:
    own, node = rows.schema["id"].dataType.simpleString(), rows.schema["node"].dataType.simpleString()
    return f"key long, sides int, x int, y int, bulky boolean, id {own}, node {node}, component {node}, n long, " + ", ".join(f"{k} long" for k in _sketch_of(rows.columns))


def _once(met: DataFrame, percent: int) -> DataFrame:
    """Those members, with their ``mates`` (sorted keys of all their lists here), that are in a pair which meets in no earlier list."""
    mates = met.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("mates"))
    return _units(met.join(mates.hint("merge"), "id"), _meetings, percent, (*_member(met), "mates"), _member_kinds(met) + ", mates array<bigint>")


def _links(met: DataFrame, codes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of similar nodes of different components within the units, as many as join what hangs together there."""
    kind = met.schema["node"].dataType.simpleString()
    rows = met.join(codes.hint("merge"), "id")
    return _pairs(_units(rows, _forest, percent, (*_member(met), "mates", "codes"), f"a {kind}, b {kind}"))


def _starts(table: pa.Table) -> np.ndarray:
    """Where the rows of each unit begin."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in _UNIT:
        values = table[name].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _missed(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """In how many coordinates sketches, given word by word, differ."""
    differ = [p ^ q for p, q in zip(x, y)]
    return sum(np.bitwise_count((d | d >> np.uint64(1)) & np.uint64(_EVEN)).astype(np.int64) for d in differ)


def _differing(table: pa.Table) -> Callable[[np.ndarray, np.ndarray], np.ndarray] | None:
    """In how many parities sketches of these rows differ, where the table has them."""
    if PARITY[0] not in table.column_names:
        return None
    words = [table[p].to_numpy().view(np.uint64) for p in PARITY]
    return lambda i, j: sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in words)


def _medoids(table: pa.Table, starts: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Of each unit the pairs of its medoid with members of other components whose sketches agree; units of one size together."""
    if not len(starts):
        return
    table = table.combine_chunks()
    component = table["component"].combine_chunks().dictionary_encode().indices.to_numpy()
    nodes = table["node"].combine_chunks()
    sketch, n, differing = np.stack([table[s].to_numpy().view(np.uint64) for s in SKETCH], axis=1), table["n"].to_numpy(), _differing(table)
    sizes = np.diff(np.append(starts, table.num_rows))
    for size in np.unique(sizes[sizes > 1]).tolist():
        some, step = starts[sizes == size], max(1, (1 << 14) // size)
        for at in range(0, len(some), step):
            members = some[at : at + step, None] + np.arange(size)
            own = sketch[members]
            most = np.unpackbits(own.view(np.uint8), axis=2).sum(axis=1) * 2 > size
            middle = np.packbits(most, axis=1).view(np.uint64)[:, None, :]
            nearest = _missed([own[:, :, k] for k in range(len(SKETCH))], [middle[:, :, k] for k in range(len(SKETCH))]).argmin(axis=1)
            medoid = members[np.arange(len(members)), nearest]
            i, j = members.ravel(), np.repeat(medoid, size)
            live = component[i] != component[j]
            i, j = i[live], j[live]
            near = SKETCHED - _missed(list(sketch[i].T), list(sketch[j].T)) >= threshold(SKETCHED, percent, BITS)
            if differing:
                near &= _within(differing(i, j), n[i], n[j], percent)
            if near.any():
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(i[near])), nodes.take(pa.array(j[near]))], names=["a", "b"])


def _tried(starts: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs within units of one size, about PAIRS at a time: where units start, and the two members of each pair there."""
    if size * (size - 1) // 2 <= PAIRS:
        one, two = (x.astype(np.int32) for x in np.triu_indices(size, 1))
        step = max(1, PAIRS // len(one))
        for at in range(0, len(starts), step):
            yield starts[at : at + step, None], one, two
        return
    side = int(PAIRS**0.5)
    for start in starts.tolist():
        for a in range(0, size, side):
            for b in range(a, size, side):
                one, two = (x.ravel() for x in np.meshgrid(np.arange(a, min(a + side, size), dtype=np.int32), np.arange(b, min(b + side, size), dtype=np.int32), indexing="ij"))
                if a == b:
                    one, two = one[one < two], two[one < two]
                yield np.array([[start]], np.int32), one, two


def _near(table: pa.Table, starts: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows and agreements of the pairs within units whose components differ and whose sketches agree; units of one size together.

    Where the table has ``mates``, a pair counts in the first of the lists that both are in, alone.
    """
    mates, keys = None, table["key"].to_numpy()
    if "mates" in table.column_names:
        lists = table["mates"].combine_chunks()
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        mates = lru_cache(None)(lambda row: frozenset(flat[ends[row] : ends[row + 1]].tolist()))
    component = table["component"].combine_chunks().dictionary_encode().indices.to_numpy()
    n, sketch = table["n"].to_numpy(), [table[s].to_numpy().view(np.uint64) for s in SKETCH]
    differing = _differing(table)
    bulky, both = table["bulky"].to_numpy(zero_copy_only=False), table["sides"].to_numpy() == 2
    sizes = np.diff(np.append(starts, table.num_rows))
    for size in np.unique(sizes[sizes > 1]).tolist():
        some = starts[sizes == size]
        for first, one, two in _tried(some, size):
            i, j = (first + one).ravel(), (first + two).ravel()
            live = (component[i] != component[j]) & ((bulky[i] != bulky[j]) | ~both[i])
            live &= np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent
            i, j = i[live], j[live]
            agreed = SKETCHED - _missed([s[i] for s in sketch], [s[j] for s in sketch])
            near = np.flatnonzero(agreed >= threshold(SKETCHED, percent, BITS))
            if differing:
                near = near[_within(differing(i[near], j[near]), n[i[near]], n[j[near]], percent)]
            if mates is not None:
                near = near[[min(mates(p) & mates(q)) == keys[p] for p, q in zip(i[near].tolist(), j[near].tolist())]] if len(near) else near
            if len(near):
                yield i[near], j[near], agreed[near]


def _meetings(table: pa.Table, starts: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """The rows that are in a pair of ``_near``."""
    table, keep = table.combine_chunks(), np.zeros(table.num_rows, bool)
    for i, j, _ in _near(table, starts, percent) if len(starts) else ():
        keep[i] = keep[j] = True
    yield from table.filter(pa.array(keep)).to_batches()


def _forest(table: pa.Table, starts: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Links of some units: pairs of ``_near`` whose whole sets are similar, those with most agreements first, but for
    pairs that hang together already."""
    if not len(starts):
        return
    table = table.combine_chunks()
    found = [np.concatenate(x) for x in zip(*_near(table, starts, percent))]
    if not found:
        return
    order = np.argsort(-found[2], kind="stable")
    i, j = found[0][order], found[1][order]
    rows = np.unique(np.concatenate((i, j)))
    sets = dict(zip(rows.tolist(), [np.frombuffer(x, "<u8") for x in table["codes"].take(pa.array(rows)).to_pylist()]))
    component = table["component"].combine_chunks().dictionary_encode().indices.to_numpy()
    group = np.arange(component.max() + 1)
    a, b = [], []
    while len(i):
        x, y = i[:CHECKED], j[:CHECKED]
        alike = similar_sets(sets, x, y, percent)
        for p, q in zip(x[alike].tolist(), y[alike].tolist()):
            one, other = group[component[p]], group[component[q]]
            if one != other:
                group[group == other] = one
                a.append(p)
                b.append(q)
        i, j = i[CHECKED:], j[CHECKED:]
        still = group[component[i]] != group[component[j]]
        i, j = i[still], j[still]
    if a:
        nodes = table["node"].combine_chunks()
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b))], names=["a", "b"])


def similar_sets(sets: dict[int, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sets of each pair of rows are similar; the codes of a set are distinct."""
    sizes = np.array([len(sets[p]) + len(sets[q]) for p, q in zip(i.tolist(), j.tolist())], np.int64)
    out, at = np.zeros(len(i), bool), 0
    while at < len(i):
        # as many pairs as have about MERGED codes; a bijection of its own for each keeps the pairs apart
        ends = np.cumsum(sizes[at:])
        n = max(1, int(np.searchsorted(ends, MERGED)))
        some = [x for p, q in zip(i[at : at + n].tolist(), j[at : at + n].tolist()) for x in (sets[p], sets[q])]
        pair = np.repeat(np.arange(n, dtype=np.uint64), sizes[at : at + n])
        codes = (np.concatenate(some) + pair * _MIX) * _MIX
        order = np.argsort(codes)
        codes, pair = codes[order], pair[order]
        inside = np.bincount(pair[1:][(codes[1:] == codes[:-1]) & (pair[1:] == pair[:-1])].astype(np.int64), minlength=n)
        out[at : at + n] = 100 * inside >= percent * (sizes[at : at + n] - inside)
        at += n
    return out


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    Returns per input row: ``id_col``, ``n_shingles`` long, ``component_id`` (smallest id reachable over
    links, the own one included) and ``kept`` boolean (the id is the component's). A text of fewer words
    than a shingle is one shingle; null and empty texts, and ones of white space, have an empty set and
    are linked with nothing. Equal sets are one node, however many documents have them. Rows with equal
    ids are one document; rows without an id are linked with nothing, have no component and are kept.
    Texts are compared whole; other columns are neither read nor returned.

    A link of similarity exactly 0.8 is missed if its signatures agree in fewer than 36 of 64
    coordinates, or its sketches in fewer than 90 of 128, which happens about six times in a million.
    """
    rows = stored(signatures(docs, shingle_words, id_col=id_col, text_col=text_col), "signatures")
    # equal sets become one node: the smallest id
    firsts = [F.first(c).alias(c) for c in ("n", "signature", *SKETCH)]
    sets = stored(rows.where("n > 0 AND id IS NOT NULL").groupBy("same").agg(F.min("id").alias("id"), *firsts), "distinct-sets")
    postings = stored(_postings(sets, COORDINATES, percent), "postings")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    nodes = sets.select("id", F.col("id").alias("node"), "n", *SKETCH)

    def codes(ids: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [_shingle_codes(t, shingle_words).astype("<u8").tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "codes"])

        return only(texts, ids.select("id")).mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, codes binary")

    groups = grouped(postings, nodes, lambda pairs: _confirmed(pairs, texts, shingle_words, percent), codes, percent)

    known = sets.select("same", F.col("id").alias("node")).join(groups.hint("merge"), "node", "left").select("same", F.coalesce("component", "node").alias("component"))
    found = rows.select("id", "n", "same").join(known.hint("merge"), "same", "left")
    component = F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component", "id"))
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
