"""Connected components of a graph of any size: distributed union-find by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracelake.llm.tables import stored

#: Edges that one task joins into a forest at a time, at least. As few as this, all together, are joined by one task alone.
FOREST = 200_000


def apart(df: DataFrame) -> DataFrame:
    """The same rows, which a join by their key deals out anew.

    An aggregate that already lies by the join's key would bind the other side to its partitions; dealt out
    by the join itself, a key with very many rows there can be split over several tasks.
    """
    return df.coalesce(1 << 20)


def _forests(edges: DataFrame) -> DataFrame:
    """The edges of every task joined by union-find: each node with the smallest one it hangs together with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):  # noqa: ANN001, ANN202
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def stars() -> pa.RecordBatch:
            found = [(x, r) for x in [*up] if (r := root(x)) != x]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            kind = batch.schema.field(0).type
            if len(up) >= 2 * FOREST:
                yield stars()
        if up:
            yield stars()

    spark_kind = edges.schema["u"].dataType.simpleString()
    return edges.mapInArrow(run, f"u {spark_kind}, v {spark_kind}")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for every node that an edge names.

    Every task first joins its own edges to a forest; where no more than FOREST edges are left, a bounded number, a
    last task joins these. Otherwise large and small star steps (Kiveris et al.,
    "Connected Components in MapReduce and Beyond", 2014) alternate until nothing changes. Every step
    takes each node's smallest neighbour by a partial aggregate; the join that follows deals out both
    sides, so a hub's neighbours can be split over tasks. Every round's edges are a table in the shared
    folder. Loops, repeated edges and edges with a null end are harmless. An empty graph has no rows.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links = stored(_forests(pairs), "edges")
    mark = _mark(links)
    if mark[0] <= FOREST:
        links, mark = stored(_forests(links.coalesce(1)), "edges"), (0,)
    while mark[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = apart(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(least).hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _mark(links)
        if now == mark:
            break
        mark = now
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return roots.unionByName(links.select(F.col("u").alias("node"), F.col("v").alias("component")))


def _mark(links: DataFrame) -> tuple:
    """Tells two tables of edges apart, in any order of rows."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
