"""Packing documents into as few fixed-length sequences as possible by a grouping genetic algorithm.

Pieces are dealt into shards of bounded size. Every shard is evolved on several islands: an individual
is a whole packing, and a crossover injects well-filled bins of one parent into the other, removes the
bins that now hold duplicates, and best-fits the documents that this displaced. A child's emptiest bins
are then relieved: their pieces are moved, or exchanged for slightly shorter ones of bins that have room
for the difference, until a bin is empty. Between rounds each island sends its elite to the next. The
emptiest bins of all shards are dealt anew into fewer shards, until one shard holds them all.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tracelake.llm.bpe import ROWS, word_bpe
from tracelake.llm.tables import stored

#: Pieces of a shard, about: what one task holds and evolves.
SHARD = 4000
ISLANDS = 2
ROUNDS = 2
GENERATIONS = 12
POPULATION = 4
#: Bins of a child that are relieved, emptiest first, and pieces exchanged for it at most.
RELIEVED = 12
EXCHANGED = 1500

Bins = list[list[int]]


def _fit(bins: Bins, loose: list[int], size: list[int], room: int) -> Bins:
    """Puts loose pieces, longest first, each where it leaves the least room; opens bins for the rest."""
    left = sorted((room - sum([size[i] for i in b]), k) for k, b in enumerate(bins))
    for i in sorted(loose, key=lambda i: -size[i]):
        at = bisect_left(left, (size[i], -1))
        if at == len(left):
            bins.append([i])
            insort(left, (room - size[i], len(bins) - 1))
        else:
            rest, k = left.pop(at)
            bins[k].append(i)
            insort(left, (rest - size[i], k))
    return bins


def _worth(bins: Bins, size: list[int], room: int) -> tuple[int, float]:
    """Fewer bins first, then bins that are fuller."""
    return len(bins), -sum([(sum([size[i] for i in b]) / room) ** 2 for b in bins])


def _cross(one: Bins, other: Bins, size: list[int], room: int, rng: np.random.Generator) -> Bins:
    """Injects some of the fullest bins of ``other`` into ``one``."""
    filled = sorted(other, key=lambda b: -sum([size[i] for i in b]))
    good = filled[: max(1, len(filled) * 2 // 3)]
    injected = [list(b) for b in good if rng.random() < 0.3] or [list(good[0])]
    taken = {i for b in injected for i in b}
    kept = [list(b) for b in one if taken.isdisjoint(b)]
    loose = [i for b in one if not taken.isdisjoint(b) for i in b if i not in taken]
    return _fit(kept + injected, loose, size, room)


def _mutate(bins: Bins, size: list[int], room: int, rng: np.random.Generator) -> Bins:
    """Empties the worst bins and a few others and fits their pieces anew."""
    order = sorted(range(len(bins)), key=lambda k: sum([size[i] for i in bins[k]]))
    gone = {*order[: max(1, len(bins) // 50)], *rng.integers(0, len(bins), max(1, len(bins) // 50)).tolist()}
    return _fit([list(b) for k, b in enumerate(bins) if k not in gone], [i for k in gone for i in bins[k]], size, room)


def relieve(bins: Bins, size: np.ndarray, room: int, rng: np.random.Generator) -> Bins:
    """Moves what the emptiest bins hold into the room that others have left, by moves and by exchanges of single pieces.

    An exchange gives another bin a longer piece for a shorter one of its own, so the bin that is relieved holds less
    after each. Bins are taken in turn, emptiest first; one that cannot be emptied keeps what is left.
    """
    of = np.zeros(len(size), np.int64)
    for k, b in enumerate(bins):
        of[b] = k
    free = room - np.bincount(of, size, len(bins)).astype(np.int64)
    done = np.zeros(len(bins), bool)
    swaps = 0
    for _ in range(min(RELIEVED, len(bins) - 1)):
        k = int(np.where(done, -1, free).argmax())
        done[k] = True
        held = np.flatnonzero(of == k).tolist()
        others = np.arange(len(free)) != k
        while held and swaps < EXCHANGED:
            # bins that were relieved before are emptier: nothing goes back to them but whole pieces
            open_bins = np.where(done, -1, free)
            best = None
            for i in sorted(held, key=lambda i: -size[i]):
                fits = np.flatnonzero(others & (free >= size[i]))
                if len(fits):
                    best = (i, None, int(fits[free[fits].argmin()]))
                    break
                more = size[i] - size
                gain = np.where((more > 0) & (more <= open_bins[of]), more, 0)
                j = int(gain.argmax())
                if gain[j] > 0 and (best is None or gain[j] > best[3]):
                    best = (i, j, int(of[j]), int(gain[j]))
            if best is None:
                break
            i, j, to = best[:3]
            swaps += 1
            held.remove(i)
            of[i] = to
            free[to] -= size[i]
            free[k] += size[i]
            if j is not None:
                of[j] = k
                free[to] += size[j]
                free[k] -= size[j]
                held.append(j)
    out: Bins = [[] for _ in bins]
    for i, k in enumerate(of.tolist()):
        out[k].append(i)
    return [b for b in out if b]


def evolve(size: list[int], room: int, guests: list[Bins], seed: int) -> Bins:
    """The best packing of some generations that start from ``guests`` and best-fit packings.

    It ends before only where no packing can have fewer bins.
    """
    rng = np.random.default_rng(seed)
    sizes = np.array(size, np.int64)
    large = int((sizes * 2 > room).sum())
    least = max(-(-int(sizes.sum()) // room), large)
    people = [g for g in guests if g]
    if not people:
        people = [_fit([], [*range(len(size))], size, room)]
    if len(people[0]) <= least:
        return people[0]
    while len(people) < POPULATION:
        some = rng.random(len(size)) < 0.5
        half = _fit([], np.flatnonzero(some).tolist(), size, room)
        people.append(_fit(half, np.flatnonzero(~some).tolist(), size, room))
    people = sorted([relieve(p, sizes, room, rng) for p in people], key=lambda p: _worth(p, size, room))
    for _ in range(GENERATIONS):
        if len(people[0]) <= least:
            break
        a, b = rng.permutation(len(people))[:2].tolist()
        children = [_cross(people[a], people[b], size, room, rng), _cross(people[b], people[a], size, room, rng), _mutate(people[0], size, room, rng)]
        children = [relieve(c, sizes, room, rng) for c in children]
        people = sorted(people + children, key=lambda p: _worth(p, size, room))[:POPULATION]
    return people[0]


def _bins(numbers: np.ndarray) -> Bins:
    found: dict[int, list[int]] = {}
    for i, k in enumerate(numbers.tolist()):
        found.setdefault(k, []).append(i)
    return [*found.values()]


def _evolved(pieces: DataFrame, shards: int, room: int) -> DataFrame:
    """``uid``, ``length``, ``shard`` and ``bin`` of every piece after all rounds."""
    state = pieces.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard"), F.array_repeat(F.lit(-1), ISLANDS).alias("elites"))

    def island(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid", ignore_index=True)
        guests = [_bins(group[c].to_numpy()) for c in ("own", "guest") if group[c].iloc[0] >= 0]
        best = evolve(group["length"].tolist(), room, guests, int(key[0]) * ISLANDS + int(key[1]))
        numbers = np.zeros(len(group), np.int32)
        for k, members in enumerate(best):
            numbers[members] = k
        return pd.DataFrame({"shard": key[0], "island": key[1], "uid": group["uid"], "length": group["length"], "bin": numbers})

    for _ in range(ROUNDS):
        there = state.select("shard", "uid", "length", F.posexplode("elites").alias("island", "own"), F.col("elites").alias("e"))
        there = there.withColumn("guest", F.element_at("e", F.pmod(F.col("island") + 1, F.lit(ISLANDS)) + 1)).drop("e")
        moved = there.groupBy("shard", "island").applyInPandas(island, "shard int, island int, uid long, length int, bin int")
        pairs = stored(moved.groupBy("shard", "uid").agg(F.first("length").alias("length"), F.sort_array(F.collect_list(F.struct("island", "bin"))).alias("b")), "islands")
        state = pairs.select("uid", "length", "shard", F.col("b.bin").alias("elites"))
    counts = [F.max(F.element_at("elites", i + 1)).alias(f"n{i}") for i in range(ISLANDS)]
    # the island with the fewest bins
    order = F.array_sort(F.array(*[F.struct(F.col(f"n{i}").alias("n"), F.lit(i + 1).alias("at")) for i in range(ISLANDS)]))
    best = state.groupBy("shard").agg(*counts).select("shard", order[0]["at"].alias("at"))
    return state.join(best, "shard").select("uid", "length", "shard", F.element_at("elites", F.col("at")).alias("bin"))


def pieces_of(docs: DataFrame, vocabulary: str, *, room: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``room`` tokens of every document with its end token: uid, key, piece, start, length, ids_crc32."""
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("body"))
    names = ["uid", "key", "piece", "start", "length", "ids_crc32"]
    kinds = (pa.int64(), None, pa.int32(), pa.int64(), pa.int32(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, made = word_bpe(vocabulary), TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out: list[tuple] = []
                for k, coded in enumerate(bpe.encode(part.column(1).to_pylist())):
                    ids = coded + end
                    for n, start in enumerate(range(0, len(ids), 4 * room)):
                        own = ids[start : start + 4 * room]
                        out.append((made, k, n, start // 4, len(own) // 4, zlib.crc32(own)))
                        made += 1
                columns = [part.column(0).take(pa.array([x[1] for x in out], pa.int32())) if t is None else pa.array([x[c] for x in out], t) for c, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        bpe.forget()

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"uid long, key {kind}, piece int, start long, length int, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, *, room: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document, ended by ``end_id``, into sequences of at most ``room`` tokens.

    Only documents longer than a sequence are cut. Returns per piece: ``id_col``, piece int (from 0),
    start long (its document's ids before it), length long, ids_crc32 long, sequence_id long and offset
    long (its place in the sequence, without gaps). Null and empty texts are their end token alone.
    Repeated rows, rows without an id and rows with equal ids are packed as documents of their own;
    an empty table gives no rows. Other columns are neither read nor returned.
    """
    pieces = stored(pieces_of(docs, vocabulary, room=room, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    whole = pieces.where(F.col("length") == room).select("uid", (-1 - F.col("uid")).alias("sequence_id"))
    open_pieces, placed, level = pieces.where(F.col("length") < room).select("uid", "length"), [whole], 0
    while True:
        shards = max(1, -(-open_pieces.count() // SHARD))
        found = _evolved(open_pieces, shards, room).withColumn("sequence_id", F.lit(level << 56) + F.shiftleft(F.col("shard").cast("long"), 20) + F.col("bin"))
        if shards == 1:
            placed.append(found.select("uid", "sequence_id"))
            break
        # the emptiest bins of each shard, half of them at most, go to the next level
        bins = found.groupBy("shard", "sequence_id").agg(F.sum("length").alias("fill"))
        place = F.row_number().over(Window.partitionBy("shard").orderBy("fill", "sequence_id"))
        half = F.floor(F.count(F.lit(1)).over(Window.partitionBy("shard")) / 2)
        bins = bins.withColumn("goes_on", (F.col("fill") * 200 < room * 199) & (place <= half))
        found = stored(found.join(bins.select("sequence_id", "goes_on"), "sequence_id"), "packed")
        placed.append(found.where(~F.col("goes_on")).select("uid", "sequence_id"))
        open_pieces, level = found.where("goes_on").select("uid", "length"), level + 1
    sequences = placed[0]
    for more in placed[1:]:
        sequences = sequences.unionByName(more)
    before = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.join(sequences, "uid").select(
        F.col("key").alias(id_col),
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"),
    )
