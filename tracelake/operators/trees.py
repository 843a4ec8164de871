"""Decision trees as arrays, and exact Shapley values along their paths.

What a tree expects of a row when only some features are known follows every split on a known one and weighs both
sides of the others by their training rows. The Shapley weights of subsets by size are integrals of t to the
subset's size times 1 - t to that of the rest, so a leaf's share in a feature's value is the integral over t of a product,
with one factor for each other feature on the path: 1 - t times the share of rows that go the path's way, plus t if the row does.
A fixed number of Gauss-Legendre points integrates it exactly. The products are carried down the tree and what the
leaves make of them comes up again, so the work is linear in the number of nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays: feature (-1 at leaves), threshold (left if not above), children, training rows, and a row of values per node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    value: np.ndarray

    @property
    def depth(self) -> int:
        depth, nodes = 0, np.array([0])
        while (nodes := nodes[self.feature[nodes] >= 0]).size:
            depth, nodes = depth + 1, np.concatenate([self.left[nodes], self.right[nodes]])
        return depth

    def expected(self) -> np.ndarray:
        """The mean value over the training rows."""
        out = np.array(self.value, float)
        for node in reversed(range(len(self.feature))):  # children come after their parents
            if self.feature[node] >= 0:
                a, b = self.left[node], self.right[node]
                out[node] = (self.size[a] * out[a] + self.size[b] * out[b]) / self.size[node]
        return out[0]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (inner := self.feature[at] >= 0).any():
            f = np.maximum(self.feature[at], 0)
            to = np.where(x[rows, f] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(inner, to, at)
        return at


def shapley(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Shapley values by row, feature and output; with ``expected`` they add up to the tree's value."""
    out = np.zeros((*x.shape, tree.value.shape[1]))
    depth = tree.depth
    if not depth or not len(x):
        return out
    t, weight = np.polynomial.legendre.leggauss((depth + 1) // 2)
    t, weight = (t + 1) / 2, weight / 2

    def below(node: int, product: np.ndarray, known: dict[int, tuple]) -> np.ndarray:
        """Sums over the leaves below of value times product: rows, points, outputs. known: each feature's excess, factor, share and way on the path."""
        if tree.feature[node] < 0:
            return product[:, :, None] * tree.value[node]
        f = int(tree.feature[node])
        goes_left = x[:, f] <= tree.threshold[node]
        total = 0
        for child, goes in ((int(tree.left[node]), goes_left), (int(tree.right[node]), ~goes_left)):
            share, one = tree.size[child] / tree.size[node], goes.astype(float)
            before = known.get(f)
            if before:  # a further split on a feature narrows the one before
                share, one = share * before[2], one * before[3]
            factor = (1 - t) * share + t * one[:, None]
            carried = product * factor if before is None else product / before[1] * factor
            excess = (one - share)[:, None] / factor * weight
            sums = below(child, carried, {**known, f: (excess, factor, share, one)})
            # leaves below count with this factor alone, not also with the one before
            out[:, f] += np.einsum("rq,rqk->rk", excess if before is None else excess - before[0], sums)
            total = total + sums
        return total

    below(0, np.ones((len(x), len(t))), {})
    return out
