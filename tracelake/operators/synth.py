"""Synthetic rows from a Gaussian copula: each column's own distribution, and the correlation of their normal scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

POINTS = 101
#: Rows that are drawn with random numbers of their own.
BLOCK = 1000


@dataclass(frozen=True)
class Copula:
    columns: list[str]
    quantiles: np.ndarray
    factor: np.ndarray

    def metadata(self) -> dict:
        return {"columns": self.columns, "quantiles": self.quantiles.tolist()}


def _numbers(df: DataFrame, columns: list[str], by: Column) -> DataFrame:
    return df.select(by.alias("of"), *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(columns)])


def fit_by(df: DataFrame, columns: list[str], by: Column) -> dict[str, Copula]:
    """A copula for every class: two jobs, however many classes there are.

    The first summarises every column's quantiles per class. In the second, tasks look values up among these by binary search and
    add up normal scores and their products per class; what reaches the driver grows with classes and columns alone. Rows
    without a class take no part.
    """
    share = [k / (POINTS - 1) for k in range(POINTS)]
    rows, many = _numbers(df, columns, by.cast("string")).where("of IS NOT NULL"), len(columns)
    found = rows.groupBy("of").agg(*[F.percentile_approx(f"v{i}", share, 10_000).alias(f"q{i}") for i in range(many)]).collect()
    quantiles = {r.of: np.array([r[f"q{i}"] for i in range(many)], float) for r in found}
    normal = NormalDist()
    z = np.array([normal.inv_cdf(min(max((k + 0.5) / POINTS, 1e-6), 1 - 1e-6)) for k in range(POINTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            of = batch.column(0).dictionary_encode()
            codes, names = of.indices.to_numpy(), of.dictionary.to_pylist()
            values = np.stack([batch.column(i + 1).to_numpy() for i in range(many)], 1)
            for code, name in enumerate(names):
                own = values[codes == code]
                # the point below the value: how many quantiles it reaches
                reached = np.stack([np.searchsorted(quantiles[name][i], own[:, i], "right") for i in range(many)], 1)
                scores = np.hstack([np.ones((len(own), 1)), z[np.maximum(reached, 1) - 1]])
                sums[name] = sums.get(name, 0) + scores.T @ scores
        at = [(name, i, float(v)) for name, s in sums.items() for i, v in enumerate(s.ravel())]
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in at], t) for k, t in enumerate((pa.string(), pa.int32(), pa.float64()))], names=["of", "at", "v"])

    total = rows.mapInArrow(run, "of string, at int, v double").groupBy("of", "at").agg(F.sum("v").alias("v")).collect()
    moments = {name: np.zeros((many + 1) ** 2) for name in quantiles}
    for r in total:
        moments[r.of][r.at] = r.v
    return {name: Copula(columns, quantiles[name], _factor(m.reshape(many + 1, many + 1))) for name, m in moments.items()}


def _factor(moments: np.ndarray) -> np.ndarray:
    """The Cholesky factor of the correlations, from the count, sums and products of scores; a constant column has none."""
    n, mean = moments[0, 0], moments[0, 1:] / moments[0, 0]
    covariance = moments[1:, 1:] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(covariance), 0))
    known = np.outer(spread > 1e-9, spread > 1e-9)
    corr = np.where(known, covariance / np.where(known, np.outer(spread, spread), 1), 0.0)
    np.fill_diagonal(corr, 1.0)
    return np.linalg.cholesky(0.999 * np.clip(corr, -1, 1) + 0.001 * np.eye(len(corr)))


def fit(df: DataFrame, columns: list[str]) -> Copula:
    """One copula of all rows; ValueError where there is none."""
    found = fit_by(df, columns, F.lit(""))
    if not found:
        raise ValueError("no rows to fit")
    return found[""]


def sample(spark: SparkSession, copula: Copula, n: int, *, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """n rows; each block of 1000 has random numbers of its own, so a task that runs again gives the same rows."""
    return _sampled(spark, [("", n, seed)], {"": copula}, partitions).drop("of")


def _sampled(spark: SparkSession, wanted: list[tuple[str, int, int]], copulas: dict[str, Copula], partitions: int | None) -> DataFrame:
    """Rows of each (class, number, seed), with the class in ``of``: one plan, whose blocks are each of one class."""
    columns = next(iter(copulas.values())).columns
    kinds = "of string, " + ", ".join(f"`{c}` double" for c in columns)
    ends = np.cumsum([-(-n // BLOCK) for _, n, _ in wanted])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        below = np.vectorize(NormalDist().cdf, otypes=[float])
        for batch in batches:
            for at in batch["id"]:
                k = int(np.searchsorted(ends, at, "right"))
                name, n, seed = wanted[k]
                block, copula = int(at - (ends[k - 1] if k else 0)), copulas.get(name) or copulas[""]
                rng = np.random.default_rng([seed, block])
                u = below(rng.standard_normal((min(BLOCK, n - block * BLOCK), len(columns))) @ copula.factor.T)
                values = {c: np.interp(u[:, i], np.linspace(0, 1, POINTS), copula.quantiles[i]) for i, c in enumerate(columns)}
                yield pd.DataFrame({"of": name, **values})

    return spark.range(0, int(ends[-1]) if len(ends) else 0, 1, partitions).mapInPandas(run, kinds)


def by_quota(spark: SparkSession, copulas: dict[str, Copula], quotas: dict[str, int], *, seed: int = 42) -> DataFrame:
    """Rows of each class by its quota, with ``attack_cat`` and ``label``; one copula for all classes or one for each."""
    rows = _sampled(spark, [(c, n, seed + k) for k, (c, n) in enumerate(sorted(quotas.items()))], copulas, None)
    return rows.select(F.col("of").alias("attack_cat"), (F.lower("of") != "normal").cast("int").alias("label"), *[F.col(f"`{c}`") for c in rows.columns[1:]])
