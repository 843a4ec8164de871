"""Gradient-boosted trees for several classes: a softmax over one tree per class and round, grown level by level.

Features are cut into bins once. A level of all trees of a round is one job: tasks add up gradients and curvatures by
class, node, feature and bin, Spark adds up the tasks' sums, finds the best split of every node from running sums over
its bins, and the driver hears one row per node. Margins are written with the rows every few rounds, so that a task
only evaluates the trees since then.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tracelake.operators.trees import Tree, shapley
from tracelake.storage import stored

#: Rounds after which margins are written anew.
KEEP = 10
#: Rows of one evaluation.
ROWS = 20_000


@dataclass(frozen=True)
class Boosted:
    """One tree per round and class, over raw feature values; a class's margin is its start and the sum of its trees' values."""

    features: list[str]
    classes: list[str]
    start: np.ndarray
    rounds: list[list[Tree]]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.start, (len(x), 1))
        for trees in self.rounds:
            for c, tree in enumerate(trees):
                out[:, c] += tree.value[tree.leaves(x), 0]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.margins(x))

    def base(self) -> np.ndarray:
        """Mean margins over the training rows."""
        return self.start + sum((np.array([tree.expected()[0] for tree in trees]) for trees in self.rounds), np.zeros(len(self.start)))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Shapley values of the margins by row, feature and class; with ``base`` they add up to the margins."""
        out = np.zeros((len(x), len(self.features), len(self.classes)))
        for trees in self.rounds:
            for c, tree in enumerate(trees):
                out[:, :, c] += shapley(tree, x)[:, :, 0]
        return out

    def table(self) -> list[tuple]:
        """All nodes as rows: round, class, node, feature, threshold, left, right, size, value."""
        return [
            (r, c, i, int(t.feature[i]), float(t.threshold[i]), int(t.left[i]), int(t.right[i]), float(t.size[i]), float(t.value[i, 0]))
            for r, trees in enumerate(self.rounds)
            for c, t in enumerate(trees)
            for i in range(len(t.feature))
        ]


NODES = "round int, class int, node int, feature int, threshold double, left int, right int, size double, value double"


def from_table(rows: list[tuple], features: list[str], classes: list[str], start: list[float]) -> Boosted:
    trees: dict[int, dict[int, list[tuple]]] = {}
    for r in sorted(rows, key=lambda r: tuple(r)[:3]):
        trees.setdefault(r[0], {}).setdefault(r[1], []).append(tuple(r)[3:])

    def tree(nodes: list[tuple]) -> Tree:
        kinds = (int, float, int, int, float)
        return Tree(*[np.array([n[i] for n in nodes], k) for i, k in enumerate(kinds)], np.array([[n[5]] for n in nodes], float))

    return Boosted(features, classes, np.array(start), [[tree(t[c]) for c in range(len(classes))] for _, t in sorted(trees.items())])


def _softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class _Growing:
    """A tree over bins while it grows: its nodes' splits, children, sums and rows."""

    def __init__(self, g: float, h: float, n: float):
        self.feature, self.bin, self.left, self.right, self.sums = [-1], [0], [-1], [-1], [(g, h, n)]

    def split(self, node: int, feature: int, bin_: int, low: tuple) -> None:
        whole = self.sums[node]
        self.feature[node], self.bin[node] = feature, bin_
        for side, sums in (("left", low), ("right", tuple(a - b for a, b in zip(whole, low)))):
            getattr(self, side)[node] = len(self.feature)
            for column, value in zip((self.feature, self.bin, self.left, self.right, self.sums), (-1, 0, -1, -1, sums)):
                column.append(value)

    def over_bins(self, rate: float, l2: float) -> Tree:
        values = np.array([[-rate * g / (h + l2)] for g, h, _ in self.sums])
        return Tree(np.array(self.feature), np.array(self.bin, float), np.array(self.left), np.array(self.right), np.array([n for _, _, n in self.sums]), values)


def _bins(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Up to ``bins`` - 1 values per feature that part its rows about evenly."""
    shares = [k / bins for k in range(1, bins)]
    found = df.agg(*[F.percentile_approx(F.col(f"`{f}`").cast("double"), shares, 100 * bins).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(found[f"q{i}"] or [], float)) for i in range(len(features))]


def fit(df: DataFrame, features: list[str], number: str, classes: list[str], *, rounds: int = 50, depth: int = 4, rate: float = 0.3, bins: int = 64, l2: float = 1.0, least_curvature: float = 1.0) -> Boosted:
    """Trees of ``depth`` levels for the rows' classes (``number``: their place in ``classes``) after so many rounds.

    Missing and NaN values are below all others. ``bins`` is at most 256. A split needs ``least_curvature`` on either side;
    a node without a gainful split stays a leaf. Model and sums grow with rounds, classes, nodes, features and bins, never with rows.
    """
    edges, k, many = _bins(df, features, bins), len(classes), len(features)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, many), np.uint8)
            for i in range(many):
                v = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                x[:, i] = np.where(np.isnan(v), 0, np.searchsorted(edges[i], v, "left"))
            empty = pa.array([b""] * batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(many), empty], names=["x", "y", "margins"])

    rows = stored(df.select(*[F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col(number).cast("int").alias("y")).mapInArrow(binned, "x binary, y int, margins binary"), "boosting-rows")
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    start = np.log([max(counts.get(c, 0), 1e-9) for c in range(k)]) - np.log(sum(counts.values()))
    base, recent, done = start, [], []

    def evaluated(batch: pa.RecordBatch, base: np.ndarray, recent: list[list[Tree]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(-1, many)
        kept = b"".join(batch.column("margins").to_pylist())
        margins = np.frombuffer(kept).reshape(-1, k).copy() if kept else np.tile(base, (len(x), 1))
        for trees in recent:
            for c, tree in enumerate(trees):
                margins[:, c] += tree.value[tree.leaves(x), 0]
        return x, margins

    def level(growing: list[_Growing], open_nodes: list[dict[int, int]]) -> DataFrame:
        """Sums by class, open node, feature and bin over all rows."""
        partial = [g.over_bins(rate, l2) for g in growing]
        width = max(len(o) for o in open_nodes)
        places = [np.array([o.get(i, -1) for i in range(len(t.feature))]) for o, t in zip(open_nodes, partial)]
        known, now = base, list(recent)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((3, k, width, many, bins))
            for whole in batches:
                for low in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(low, ROWS)
                    x, margins = evaluated(batch, known, now)
                    p, y = _softmax(margins), batch.column("y").to_numpy()
                    for c in range(k):
                        place = places[c][partial[c].leaves(x)]
                        held = place >= 0
                        slot = ((place[held, None] * many + np.arange(many)) * bins + x[held]).ravel()
                        g, h = p[held, c] - (y[held] == c), 2 * p[held, c] * (1 - p[held, c])
                        for i, w in enumerate((g, h, np.ones(held.sum()))):
                            sums[i, c] += np.bincount(slot, np.repeat(w, many), width * many * bins).reshape(width, many, bins)
            at = np.flatnonzero(sums[2])
            if len(at):
                flat = sums.reshape(3, -1)[:, at]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *[pa.array(s) for s in flat]], names=["slot", "g", "h", "n"])

        told = rows.select("x", "y", "margins").mapInArrow(run, "slot long, g double, h double, n double")
        added = told.groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
        by = lambda size, many_: F.floor(F.col("slot") / size) % many_
        return added.select((F.floor(F.col("slot") / (bins * many * width))).alias("c"), by(bins * many, width).alias("node"), by(bins, many).alias("f"), (F.col("slot") % bins).alias("b"), "g", "h", "n")

    def best(sums: DataFrame) -> list:
        """The best split of every open node, from running sums over each feature's bins."""
        one = Window.partitionBy("c", "node", "f")
        upto = one.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cut = sums.withColumns({**{f"{v}l": F.sum(v).over(upto) for v in ("g", "h", "n")}, **{f"{v}t": F.sum(v).over(one) for v in ("g", "h", "n")}})
        score = lambda g, h: g * g / (h + l2)
        gain = score(F.col("gl"), F.col("hl")) + score(F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")) - score(F.col("gt"), F.col("ht"))
        fits = (F.col("hl") >= least_curvature) & (F.col("ht") - F.col("hl") >= least_curvature) & (F.col("nl") < F.col("nt"))
        # equal gains go to the first feature and bin
        place = F.struct(F.round(gain, 9).alias("gain"), (-F.col("f")).alias("f"), (-F.col("b")).alias("b"))
        told = cut.where(fits & (gain > 1e-9)).groupBy("c", "node").agg(F.max_by(F.struct("f", "b", "gl", "hl", "nl"), place).alias("s"))
        return told.collect()

    for r in range(rounds):
        # the roots' sums come with the first level; until then they are not known
        growing, open_nodes = [_Growing(0.0, 0.0, 0.0) for _ in range(k)], [{0: 0} for _ in range(k)]
        for d in range(depth):
            if not any(open_nodes):
                break
            sums = stored(level(growing, open_nodes), "boosting-sums")
            if d == 0:
                for t in sums.where("f = 0").groupBy("c").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect():
                    growing[t.c].sums[0] = (t.g, t.h, t.n)
            nodes = [{place: node for node, place in o.items()} for o in open_nodes]
            open_nodes = [{} for _ in range(k)]
            for t in sorted(best(sums), key=lambda t: (t.c, t.node)):
                tree, node = growing[t.c], nodes[t.c][t.node]
                tree.split(node, t.s.f, t.s.b, (t.s.gl, t.s.hl, t.s.nl))
                for child in (tree.left[node], tree.right[node]):
                    open_nodes[t.c][child] = len(open_nodes[t.c])
        done.append([g.over_bins(rate, l2) for g in growing])
        recent.append(done[-1])
        if len(recent) == KEEP and r + 1 < rounds:
            known, now = base, list(recent)

            def added_up(batches: Iterator[pa.RecordBatch], known: np.ndarray = known, now: list = now) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    _, margins = evaluated(batch, known, now)
                    yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array([m.tobytes() for m in margins], pa.binary())], names=["x", "y", "margins"])

            rows, recent = stored(rows.mapInArrow(added_up, "x binary, y int, margins binary"), "boosting-rows"), []

    def raw(tree: Tree) -> Tree:
        """The same tree over feature values instead of bins."""
        at = [edges[f][int(b)] if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.threshold)]
        return Tree(tree.feature, np.array(at, float), tree.left, tree.right, tree.size, tree.value)

    return Boosted(features, classes, start, [[raw(t) for t in trees] for trees in done])
