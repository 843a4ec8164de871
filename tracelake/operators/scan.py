"""Prefix scans over keys of any size: running aggregates, neighbours and row numbers that no key has to fit one task for.

Rows are cut into ranges of about equal row count in the order of key and place, whatever the keys' sizes. Windows run
within a range; a key's ranges, a handful of rows, are scanned for what each of them starts from.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracelake.storage import stored

#: Rows of a key beyond which it is cut into ranges, and rows of a range.
MOST = 500_000
#: Ranges that a table is cut into before they grow beyond what is asked for, up to ``MOST`` rows.
RANGES = 64
#: Rows, or about so many, of one partition of a table whose size is known.
TASK = 100_000
#: Partitions that Spark writes to as rows come; for more of them a task first gathers all rows that it deals out.
DIRECT = 200
#: Large keys that are broadcast at most, and copies of each that meet its rows where there are more.
FEW, COPIES = 10_000, 32


def tasks(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: the session's own number, and more where a task would have more than ``TASK``."""
    return max(ceil(rows / TASK), int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def spread(df: DataFrame, number: str, rows: int) -> DataFrame:
    """The rows, dealt out evenly by their ``number`` where so many ``rows`` are made of them that a shuffle has more than ``DIRECT`` partitions.

    A task of that shuffle gathers what it deals out: without this a whole split of the input, times the rows that are made of each.
    """
    if rows <= TASK or tasks(df.sparkSession, rows) <= DIRECT:
        return df
    return df.repartition(DIRECT, number)


def counted_keys(df: DataFrame, keys: list[str], most: int = MOST) -> tuple[int, DataFrame | None]:
    """How many rows there are, and the keys with more than ``most`` of them and their counts, as a written table; None where there is none."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    rows, largest = counts.agg(F.sum("rows"), F.max("rows")).first()
    return rows or 0, None if (largest or 0) <= most else stored(counts.where(F.col("rows") > most), "large-keys")


def large_keys(df: DataFrame, keys: list[str], most: int = MOST) -> DataFrame | None:
    """The keys with more than ``most`` rows and their counts, as a written table; None where there is none."""
    return counted_keys(df, keys, most)[1]


def met(df: DataFrame, keys: dict[str, str], large: DataFrame, how: str) -> DataFrame:
    """A semi or anti join of rows with ``large`` keys (columns of df: of large). No task gets all rows of a key.

    Up to ``FEW`` keys are broadcast and no row moves. Beyond that a key's rows are dealt to ``COPIES`` tasks, each with a copy of the key.
    """
    table = large.select(F.struct(*_named(keys.values())).alias("__key"))
    left = df.withColumn("__key", F.struct(*_named(keys)))
    if large.limit(FEW + 1).count() <= FEW:
        return left.join(F.broadcast(table), "__key", how).drop("__key")
    left = left.withColumn("__copy", F.pmod(F.monotonically_increasing_id(), F.lit(COPIES)).cast("int"))
    right = table.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return left.join(right.hint("merge"), ["__key", "__copy"], how).drop("__key", "__copy")


def _named(columns: Iterable[str]) -> list[Column]:
    """Key columns under common names; structs with null fields are equal where their fields are, as null keys are one key."""
    return [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)]


def split(df: DataFrame, keys: list[str], large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of other keys, and those of ``large`` ones."""
    both = dict(zip(keys, keys))
    return met(df, both, large, "left_anti"), met(df, both, large, "left_semi")


def ranges(df: DataFrame, keys: list[str], order: list[str], *, most: int = MOST) -> DataFrame:
    """The rows with ``part``: numbers of ranges that rise in order of keys and place, each of about ``most`` rows or fewer.

    Beyond ``RANGES`` ranges they have more rows than that, up to ``MOST``: every range costs a task, a file and a
    sample that the driver reads. The table is written, as Spark draws the ranges from a sample: later steps must see the same ones.
    """
    dealt = df.repartitionByRange(_parts(df, most), *keys, *order).withColumn("part", F.spark_partition_id())
    return stored(dealt, "ranges")


def _parts(df: DataFrame, most: int) -> int:
    rows = df.count()
    least = max(ceil(rows / MOST), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return max(min(ceil(rows / most), max(RANGES, ceil(rows / TASK))), least)


def placed(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """The rows with each one's place in the whole table, from 0 and without gaps, in one shuffle: they are sorted and
    counted within the ranges that are written, and where a range starts, one row for each, is broadcast.
    """
    dealt = df.repartitionByRange(_parts(df, MOST), *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    # the upper bits tell the task, the lower 33 the row within it
    rows = stored(dealt, "placed").withColumn("__part", F.shiftright("__id", 33))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start")), "starts")
    number = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__start")
    return rows.join(F.broadcast(starts), "__part").select(*df.columns, number.alias(name))


def _keyed(parts: DataFrame, keys: list[str]) -> DataFrame:
    # structs with null fields are equal where their fields are, as null keys are one key
    return parts.withColumn("__key", F.struct(*keys))


def _carried(local: DataFrame, carries: DataFrame) -> DataFrame:
    """Rows (l) beside what their key's range starts from (c). Both sides lie by key and range already."""
    on = (F.col("l.__key") == F.col("c.__key")) & (F.col("l.part") == F.col("c.part"))
    return local.alias("l").join(carries.alias("c").hint("merge"), on, "left")


def running(parts: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds running aggregates per key up to each row: name -> (sum, min or max; column). ``order`` tells all rows of a key apart.

    parts: as ``ranges`` returns it. Nulls count nothing; the aggregate of nothing is null.
    """
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    both = {"sum": lambda a, b: F.when(a.isNull(), b).otherwise(a + F.coalesce(b, F.lit(0))), "min": F.least, "max": F.greatest}
    rows = _keyed(parts, keys)
    within = Window.partitionBy("__key", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({name: how[kind](column).over(within) for name, (kind, column) in values.items()})
    totals = rows.groupBy("__key", "part").agg(*[how[kind](column).alias(name) for name, (kind, column) in values.items()])
    before = Window.partitionBy("__key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select("__key", "part", *[how[kind](name).over(before).alias(name) for name, (kind, _) in values.items()])
    joined = _carried(local, carries)
    kept = [F.col(f"l.{c}") for c in parts.columns]
    return joined.select(*kept, *[both[kind](F.col(f"l.{name}"), F.col(f"c.{name}")).alias(name) for name, (kind, _) in values.items()])


def previous(parts: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """Adds the value of ``column`` in a key's row before, null for its first row.

    A range's first row takes it from the last row of the key's range before, of which each passes one on.
    """
    rows = _keyed(parts, keys)
    within = Window.partitionBy("__key", "part").orderBy(*order)
    ends = rows.groupBy("__key", "part").agg(F.max_by(F.struct(F.col(column).alias("v")), F.struct(*order)).alias("last"))
    carries = ends.select("__key", "part", F.lag("last").over(Window.partitionBy("__key").orderBy("part")).alias("last"))
    local = rows.withColumns({"__first": F.row_number().over(within) == 1, name: F.lag(column).over(within)})
    value = F.when(F.col("l.__first"), F.col("c.last.v")).otherwise(F.col(f"l.{name}"))
    return _carried(local, carries).select(*[F.col(f"l.{c}") for c in parts.columns], value.alias(name))


def numbered(parts: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Adds each row's place in the whole table, from 0 and without gaps. ``order`` tells all rows apart."""
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # one row per range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    local = parts.withColumn(name, F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
    joined = local.alias("l").join(starts.alias("s").hint("merge"), F.col("l.part") == F.col("s.part"))
    return joined.select(*[F.col(f"l.{c}") for c in parts.columns], (F.col(f"l.{name}") + F.col("s.start")).cast("long").alias(name))
