"""A Merkle tree over a table's rows in their full order: blocks by count, a root, and proofs for single rows.

Rows are dealt into ranges of their order, numbered without gaps, and hashed together in blocks of a fixed count, level
by level, until one hash is left. No block holds more rows than that, whatever their order numbers are, and a row's
proof is the hashes beside it in its block, and beside its block in the next one, up to the root.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tracelake.operators import scan

#: Rows, or blocks of the level below, of one block.
BLOCK = 4096


def row_hash(*columns: Column) -> Column:
    """SHA-256 of a row as JSON with sorted keys."""
    return F.sha2(F.to_json(F.parse_json(F.to_json(F.struct(*columns)))), 256)


def folded(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """The next level of (number, h, n): the SHA-256 of each block's joined hashes, in order, and the rows below it."""
    # hashes move as bytes, half as long as their digits
    inside = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", F.unhex("h").alias("h")))), lambda r: F.lower(F.hex(r.h))), "")
    level = nodes.groupBy(F.floor(F.col("number") / block).cast("long").alias("block")).agg(F.sha2(inside, 256).alias("h"), F.sum("n").alias("n"))
    return level.select(F.col("block").alias("number"), "h", "n")


@dataclass(frozen=True)
class Step:
    """The hashes of one block, of which the proven one is at ``at``."""

    at: int
    hashes: tuple[str, ...]


@dataclass(frozen=True)
class Tree:
    """Written levels of a tree, the rows' own first, and what they fold to."""

    levels: tuple[DataFrame, ...]
    root: str
    n: int
    block: int

    @property
    def rows(self) -> DataFrame:
        """``number`` and ``h`` of every row."""
        return self.levels[0].select("number", "h")

    def proof(self, h: str) -> list[Step] | None:
        """The steps from a row's hash to the root; None where no row has it. Reads one block of every level."""
        found = self.levels[0].where(F.col("h") == h).agg(F.min("number")).first()[0]
        if found is None:
            return None
        steps, number = [], found
        for level in self.levels:
            low = number // self.block * self.block
            near = level.where(F.col("number").between(low, low + self.block - 1)).orderBy("number").collect()
            steps.append(Step(number - low, tuple(r.h for r in near)))
            number //= self.block
        return steps


def proves(h: str, steps: list[Step], root: str) -> bool:
    """Whether the steps lead from a row's hash to the root. Needs no table."""
    for step in steps:
        if not 0 <= step.at < len(step.hashes) or step.hashes[step.at] != h:
            return False
        h = hashlib.sha256("".join(step.hashes).encode()).hexdigest()
    return h == root


def tree(df: DataFrame, order: list[str], *, block: int = BLOCK, least: int = 1) -> Tree:
    """The tree of all rows in the order of the columns ``order``, then of the rows' hashes; ``least`` levels above the rows at least.

    Rows that differ in nothing follow each other, so equal tables have equal roots, however they are partitioned. An
    empty table's root is the hash of nothing. Only the order's columns and the rows' hashes are dealt out.
    """
    names = [f"o{i}" for i in range(len(order))]
    hashed = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(order, names)], F.unhex(row_hash(*[F.col(f"`{c}`") for c in df.columns])).alias("h"))
    level = scan.placed(hashed, [*names, "h"]).select("number", F.lower(F.hex("h")).alias("h"), F.lit(1).cast("long").alias("n"))
    n = level.count()
    if not n:
        return Tree((level,), hashlib.sha256(b"").hexdigest(), 0, block)
    levels, width = [level], n
    while width > 1 or len(levels) <= least:
        level = folded(level, block)
        width = -(-width // block)
        if width > 1 or len(levels) < least:
            level = scan.stored(level, "tree-level")
            levels.append(level)
        else:
            break
    top = level.first()
    return Tree(tuple(levels), top.h, top.n, block)
