"""Caps, quotas and splits that pick the same rows in every run: order is by a hash, never random.

The rows wanted of a class are those up to a limit, the hash of a certain rank, which is found by counting. A split is
then a comparison with its class's limit: no class is sorted, and none has to fit a task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelake.storage import stored

#: Hexadecimal digits of the hashes that are counted at a time: 4096 counts a class.
DIGITS = 3
#: Rows that are looked at one by one, and classes that are sent to all tasks, at most.
FEW = 10_000


@dataclass(frozen=True)
class Quotas:
    """Rows to train on and to synthesise."""

    seed: int = 42
    train_total: int = 250_000
    train_normal: int = 140_000
    train_attack: int = 35_000
    synth_normal: int = 200_000
    synth_attack: int = 30_000


def order_hash(key: Column, seed: int = 42) -> Column:
    """md5 of seed and key, as DuckDB computes it too."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _met(rows: DataFrame, limits: DataFrame, on: Column) -> DataFrame:
    """Every row (r) beside what its class has (l). A row per class is sent to all tasks where classes are few, else they meet in a join that can be split."""
    right = F.broadcast(limits) if limits.count() <= FEW else limits.coalesce(1 << 20).hint("merge")
    return rows.alias("r").join(right.alias("l"), on, "left")


def limits(df: DataFrame, by: Column, key: Column, wanted: Callable[[Column, Column], Column], seed: int = 42) -> DataFrame:
    """The last (hash, key) of each class that is wanted, as a written table: of, h, key.

    wanted: how many rows of a class, from the class and its size. The hashes' first digits are counted per class, and again the
    next digits of what begins like the wanted rank's hash, until few rows do; only these are looked at one by
    one. Nothing is sorted by class. Rows with equal keys are taken together or not at all, so no class has more than is wanted.
    """
    rows = df.select(by.alias("by"), order_hash(key, seed).alias("h"), key.alias("key"))
    left, depth = rows.withColumn("k", F.lit(None).cast("long")), 0
    while True:
        depth += DIGITS
        counted = left.groupBy("by", F.left("h", F.lit(depth)).alias("begins"), "k").agg(F.count(F.lit(1)).alias("n"))
        # these windows are over the few beginnings of a class, not over its rows
        counted = counted.withColumn("size", F.sum("n").over(Window.partitionBy("by")))
        counted = counted.withColumn("k", F.coalesce("k", F.least(wanted(F.col("by"), F.col("size")).cast("long"), F.col("size"))))
        upto = F.sum("n").over(Window.partitionBy("by").orderBy("begins"))
        here = counted.withColumn("upto", upto).where((F.col("k") > 0) & (F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
        chosen = stored(here.select(F.col("by").alias("of"), "begins", (F.col("k") - F.col("upto") + F.col("n")).alias("rest"), "n"), "sample-digits")
        on = F.col("r.by").eqNullSafe(F.col("l.of")) & (F.left(F.col("r.h"), F.lit(depth)) == F.col("l.begins"))
        left = _met(rows, chosen, on).where("l.begins IS NOT NULL").select("r.*", F.col("l.rest").alias("k"), "l.begins")
        if depth + DIGITS > 32 or (chosen.agg(F.max("n")).first()[0] or 0) <= FEW:
            break
    last = left.groupBy("by", "begins", "k", "h", "key").agg(F.count(F.lit(1)).alias("n"))
    last = last.withColumn("upto", F.sum("n").over(Window.partitionBy("by").orderBy("h", "key")))
    fits = F.when(F.col("upto") <= F.col("k"), F.struct("h", "key"))
    # where even the first of them are too many, the limit lies before all that begins so
    found = last.groupBy(F.col("by").alias("of")).agg(F.coalesce(F.max(fits), F.first(F.struct(F.col("begins").alias("h"), F.lit(None).cast(rows.schema["key"].dataType).alias("key")))).alias("last"))
    return stored(found.select("of", "last.h", "last.key"), "sample-limits")


def _within(df: DataFrame, by: Column, key: Column, wanted: Callable[[Column, Column], Column], seed: int, name: str) -> DataFrame:
    """The rows with ``name``: whether they are among the wanted ones of their class."""
    rows = df.withColumns({"__by": by, "__h": order_hash(key, seed), "__key": key})
    before = (F.col("r.__h") < F.col("l.h")) | ((F.col("r.__h") == F.col("l.h")) & (F.col("r.__key") <= F.col("l.key")))
    met = _met(rows, limits(df, by, key, wanted, seed), F.col("r.__by").eqNullSafe(F.col("l.of")))
    return met.select(*[F.col(f"r.`{c}`") for c in df.columns], F.coalesce(before, F.lit(False)).alias(name))


def class_cap(df: DataFrame, by: str, key: str, n: int, *, seed: int = 42) -> DataFrame:
    """At most n rows of each class, the first in hash order."""
    return _within(df, F.col(by), F.col(key), lambda c, size: F.lit(n), seed, "__in").where("__in").drop("__in")


def stratified_quota(df: DataFrame, by: str, key: str, quotas: Quotas = Quotas()) -> DataFrame:
    """Up to the quota of Normal and of each attack class, then up to the total, the first in hash order."""
    quota = lambda c, size: F.when(F.lower(F.trim(c)) == "normal", quotas.train_normal).otherwise(quotas.train_attack)
    picked = _within(df, F.col(by), F.col(key), quota, quotas.seed, "__in").where("__in").drop("__in")
    return _within(picked, F.lit(0), F.col(key), lambda c, size: F.lit(quotas.train_total), quotas.seed, "__in").where("__in").drop("__in")


def stratified_split(df: DataFrame, by: str, key: str, *, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: the first share of each class in hash order, to the nearest row."""
    return _within(df, F.col(by), F.col(key), lambda c, size: F.round(size * test), seed, "is_test")
