"""Reading a query's tables and cutting lineage in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: 64-bit words of the filter in ``only``: 4 MB, however many ids it is made from.
FILTER = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder. Only Spark opens the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a session on one machine (local mode) gets a folder of its own; on a cluster, where such
    a folder would not do, RuntimeError.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tracelake-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


#: Paths that were written since each scratch area that is open began.
_AREAS: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """An area whose tables are deleted when it ends; a path that is taken off the list it gives stays.

    What is to outlive it must be written and taken off: a frame that still reads a deleted table fails.
    """
    area: list[str] = []
    _AREAS.append(area)
    try:
        yield area
    finally:
        _AREAS.remove(area)
        for path in area:
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, what: str, plain: tuple[str, ...] = ()) -> DataFrame:
    """Writes a table to the shared folder and reads it back: the lineage ends there.

    The values of columns in ``plain`` hardly recur, so no dictionary is tried for them. Unlike a cached block, the files outlive the executors that wrote them. Within a ``scratch`` area they are deleted when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    for area in _AREAS[-1:]:
        area.append(path)
    df.write.options(compression="zstd", **{f"parquet.enable.dictionary#{c}": "false" for c in plain}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Bits:
    """A filter of a fixed size, made from 64-bit hashes in ``column`` and broadcast: 4 MB, however many there are.

    ``has`` is true for all of them, and for others the more often the more there are.
    """

    def __init__(self, hashes: DataFrame, column: str):
        bit = F.shiftright(F.col(column), 1).bitwiseAND(F.lit(FILTER * 64 - 1))
        words = hashes.select(bit.alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))
        found, bits = words.toArrow(), np.zeros(FILTER, np.int64)
        bits[found["word"].to_numpy()] = found["mask"].to_numpy()
        self.shared = hashes.sparkSession.sparkContext.broadcast(bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> 1) & (FILTER * 64 - 1)
        return (self.shared.value[at >> 6] >> (at & 63)) & 1 == 1


def only(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """The rows whose ``column`` is in ``ids``, of which few are expected: a semi join behind a bit filter.

    Rows that the filter rejects are never dealt out. If the ids are so many that it lets everything pass,
    the join alone does the work.
    """
    bits = Bits(ids.select(F.xxhash64(column).alias("hash")), "hash")

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        return pd.Series(bits.has(hashes.to_numpy()))

    return df.where(maybe(F.xxhash64(column))).join(ids.select(column).hint("merge"), column, "left_semi")
