"""Nearest neighbours by a block matrix join with int8 tiles.

Vectors are packed into blocks, each row quantised to int8 with its own scale. For a block of queries
and a block of candidates one product of int8 values gives all inner products with an error bound for
each. Candidates whose upper bound reaches the k-th largest lower bound are computed again in double
precision, and heaps merge what the tiles of a group of blocks find. Nothing is lost: the recall is 1.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelake.llm.tables import stored

#: Pairs whose products are computed again at a time.
PAIRS = 1 << 16

_BLOCK = "block long, dim int, ids binary, vectors binary"
_BLOCK_TYPES = (pa.int64(), pa.int32(), pa.binary(), pa.binary())


def _packed(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors of one dimension, as they lie in the partitions: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        waiting: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, values = (np.concatenate(x) for x in waiting.pop(dim))
            made += 1
            columns = [[made], [dim], [ids.astype("<i8").tobytes()], [values.astype("<f8").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BLOCK_TYPES)], names=["block", "dim", "ids", "vectors"])

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids, lists = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                for dim in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == dim)
                    values = flat[(ends[own] - dim)[:, None] + np.arange(dim)]
                    held = waiting.setdefault(dim, ([], []))
                    held[0].append(ids[own])
                    held[1].append(values)
                    if sum(map(len, held[0])) >= rows:
                        ids_all, values_all = (np.concatenate(x) for x in held)
                        waiting[dim] = ([ids_all[:rows]], [values_all[:rows]])
                        yield block(dim)
                        if len(ids_all) > rows:
                            waiting[dim] = ([ids_all[rows:]], [values_all[rows:]])
        for dim in [*waiting]:
            yield block(dim)

    return vectors.mapInArrow(run, _BLOCK)


class Block:
    """Ids and vectors with their int8 form: scale * whole, its length, and the length of what it misses."""

    def __init__(self, dim: int, ids: bytes, vectors: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.vectors = np.frombuffer(vectors, "<f8").reshape(-1, dim)
        self.scale = np.abs(self.vectors).max(1, keepdims=True) / 127
        whole = np.rint(self.vectors / self.scale).astype(np.int8)
        near = self.scale * whole
        self.length = np.linalg.norm(self.vectors, axis=1)
        self.near_length = np.linalg.norm(near, axis=1)
        self.missed = np.linalg.norm(self.vectors - near, axis=1)
        # sums of int8 products are whole numbers, which float32 holds up to 2**24: BLAS can make them
        self.whole = whole.astype(np.float32 if dim <= 1040 else np.float64)


def _tile(queries: Block, some: Block, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries, rows of candidates and exact products of the pairs that may be among the k nearest.

    floor: per query a product that k candidates reach already; it is raised in place.
    """
    product = (queries.whole @ some.whole.T).astype(np.float64) * queries.scale * some.scale.T
    slack = queries.missed[:, None] * some.length + queries.near_length[:, None] * some.missed
    slack += 1e-9 * (queries.length[:, None] * some.length)
    own = queries.ids[:, None] == some.ids
    if len(some.ids) > k:
        lower = np.where(own, -np.inf, product - slack)
        np.maximum(floor, np.partition(lower, -k, axis=1)[:, -k], out=floor)
    row, column = np.nonzero((product + slack >= floor[:, None]) & ~own)
    exact = np.zeros(len(row))
    for at in range(0, len(row), PAIRS):
        a, b = queries.vectors[row[at : at + PAIRS]], some.vectors[column[at : at + PAIRS]]
        for d in range(a.shape[1]):  # one dimension after the other: equal vectors get equal sums
            exact[at : at + PAIRS] += a[:, d] * b[:, d]
    return row, column, exact


def _merged(queries: Block, held: list[Block], k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of each query among the blocks that are held, from a heap for each query."""
    heaps, floor = [[] for _ in queries.ids], np.full(len(queries.ids), -np.inf)
    for block in held:
        r, c, s = _tile(queries, block, k, floor)
        order = np.lexsort((block.ids[c], -s, r))
        r, c, s = r[order], c[order], s[order]
        first = np.searchsorted(r, r)
        best = np.arange(len(r)) - first < k
        for q, i, x in zip(r[best].tolist(), block.ids[c[best]].tolist(), s[best].tolist()):
            if len(heaps[q]) < k:
                heapq.heappush(heaps[q], (x, -i))
            elif (x, -i) > heaps[q][0]:
                heapq.heapreplace(heaps[q], (x, -i))
    flat = [(int(q), -i, s) for q, heap in zip(queries.ids, heaps) for s, i in heap]
    if flat:
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in flat], t) for n, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_rows: int = 1024,
    block_rows: int = 2048,
    group_blocks: int = 32,
    lot_blocks: int = 256,
) -> DataFrame:
    """Each query's k rows with the largest inner product, in double precision.

    is_query: condition on ``vectors`` that marks the queries, e.g. a share of the ids. Candidates are
    all rows but those with the query's id. Returns query_id long, rank int from 1, vec_id long and
    score double, nearest first, ties to the smaller id; all candidates if there are fewer than k.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id,
    take no part; a query meets only candidates of its own dimension. Repeated rows stay repeated
    candidates; a repeated query has its list once. Other columns are not read.

    The work of a search is queries times candidates. Candidates are dealt out once, in groups of about ``group_blocks``
    blocks, for each lot of ``lot_blocks`` blocks of queries; the queries, which are far fewer, are sent to every group. A task holds a
    group of candidates, and one block of queries at a time.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asks"))
    numbers = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & numbers & F.exists("vector", lambda x: x != 0))
    blocks = stored(_packed(rows.select("id", "vector"), block_rows), "ann-blocks")
    asked = _packed(rows.where("asks").select("id", "vector").dropDuplicates(["id"]), query_rows)
    asked = stored(asked, "ann-queries")
    groups, lots = max(1, -(-blocks.count() // group_blocks)), max(1, -(-asked.count() // lot_blocks))
    columns = [f.split()[0] for f in _BLOCK.split(", ")]

    def dealt(rows: DataFrame, own: str, n: int, other: str, copies: int, kind: int) -> DataFrame:
        """Blocks with one of n numbers of their own, sent to all of the other side's."""
        placed = rows.withColumns({own: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))})
        return placed.select("lot", "part", F.lit(kind).alias("kind"), *columns)

    both = dealt(blocks, "part", groups, "lot", lots, 0).unionByName(dealt(asked, "lot", lots, "part", groups, 1))
    tiles = both.repartition("lot", "part").sortWithinPartitions("lot", "part", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                if key != (row["lot"], row["part"]):
                    key, held = (row["lot"], row["part"]), {}
                block = Block(row["dim"], row["ids"], row["vectors"])
                if row["kind"] == 0:
                    held.setdefault(row["dim"], []).append(block)
                elif row["dim"] in held:
                    yield from _merged(block, held[row["dim"]], k)

    partial = tiles.mapInArrow(search, "query_id long, vec_id long, score double")
    nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
