"""Text quality by a regularised quadratic discriminant over transformed document statistics.

Each text is reduced to a dozen statistics, transformed towards normal shape. Each class has a mean
and a covariance, shrunk towards the pooled variances; the score is the logistic of the difference of
the two Mahalanobis log densities, computed with the classes' Cholesky factors, which are made once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracelake.llm.tables import stored

STATISTICS = (
    "words", "word_length", "lines", "upper", "digits", "symbols", "shouts", "stops",
    "non_ascii", "repeated_next", "distinct", "repeated_lines",
)

_KINDS = np.zeros((256, 6), np.float64)
_KINDS[ord("A") : ord("Z") + 1, 0] = 1
_KINDS[ord("0") : ord("9") + 1, 1] = 1
_KINDS[list(b"#*$%&|<>@^~_=+\\/{}[]"), 2] = 1
_KINDS[list(b"!?"), 3] = 1
_KINDS[list(b".,;:'\"()-"), 4] = 1
_KINDS[128:, 5] = 1


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; those of an empty one if it is null."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = max(len(words), 1)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS / max(len(raw), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, digits, symbols, shouts, stops, non_ascii = np.sqrt(shares)
    return [
        np.log1p(len(words)),
        np.log1p(sum(map(len, words)) / n),
        np.log1p(100 * len(lines) / n),
        upper,
        digits,
        symbols,
        shouts,
        stops,
        non_ascii,
        (sum(map(bytes.__eq__, words, words[1:])) / n) ** 0.5,
        len(set(words)) / n * np.log1p(n) / 10,
        ((len(lines) - len(set(lines))) / max(len(lines), 1)) ** 0.5,
    ]


def with_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``stats`` (array of double, in the order of STATISTICS) per input row, without a shuffle."""
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], names=["key", "stats"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, stats array<double>").withColumnRenamed("key", id_col)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and constants of classes 0 and 1; ``only`` replaces all scores if a class had no row."""

    mean: np.ndarray
    whiten: np.ndarray
    constant: np.ndarray
    temperature: float
    only: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        density = [self.constant[c] - 0.5 * (((x - self.mean[c]) @ self.whiten[c].T) ** 2).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / self.temperature, -700, 700)))


def fit(stats: DataFrame, label: Column, *, shrinkage: float = 0.1, temperature: float = 4.0) -> Discriminant:
    """Learns from rows with ``stats`` and a label of 0 or 1, all of them, by sums that Spark aggregates.

    shrinkage: share of the pooled variances in each class covariance. temperature: divides the log
    odds, which a quadratic discriminant overstates. Where a class has no row, every score is the
    label of the other; without any row it is 0.5.
    """
    d = len(STATISTICS)
    x = [F.element_at("stats", i + 1) for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = (
        stats.select("stats", label.cast("int").alias("label"))
        .where("label IN (0, 1)")
        .groupBy("label")
        .agg(F.count(F.lit(1)), *[F.sum(v) for v in x], *[F.sum(x[i] * x[j]) for i, j in pairs])
        .collect()
    )
    if len(sums) < 2:
        return Discriminant(np.zeros(0), np.zeros(0), np.zeros(0), temperature, float(sums[0][0]) if sums else 0.5)
    count, mean, scatter = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for c, n, *rest in sums:
        count[c], mean[c] = n, np.array(rest[:d]) / n
        for (i, j), v in zip(pairs, rest[d:]):
            scatter[c, i, j] = scatter[c, j, i] = v
        scatter[c] -= n * np.outer(mean[c], mean[c])
    pooled = np.diag(np.diag(scatter.sum(0)) / count.sum() + 1e-4)
    whiten, constant = np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - shrinkage) * scatter[c] / count[c] + shrinkage * pooled)
        whiten[c] = np.linalg.inv(factor)
        constant[c] = np.log(count[c] / count.sum()) - np.log(np.diag(factor)).sum()
    return Discriminant(mean, whiten, constant, temperature)


def score(stats: DataFrame, model: Discriminant, *, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``score`` double (0 to 1) per row of ``stats``."""
    rows = stats.select(F.col(id_col).alias("key"), "stats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            scores = model.score(flat.reshape(batch.num_rows, -1)) if batch.num_rows else flat
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["key", "score"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", id_col)


def accepted(text: Column, model: Discriminant, *, keep_at: float = 0.3) -> Column:
    """Whether a text scores ``keep_at`` or more: for filters that keep all columns, without a shuffle."""

    @F.arrow_udf("boolean")
    def judge(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t.as_py()) for t in texts]).reshape(len(texts), len(STATISTICS))
        return pa.array(model.score(x) >= keep_at)

    return judge(text.cast("string"))


def learn(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """``fit`` on rows of ``stats`` (see ``with_statistics``) whose id has a label of 0 or 1; rows without an id teach nothing."""
    known = labels.select(F.col(id_col).alias("key"), F.col(label_col).alias("label"))
    return fit(stats.alias("d").join(known, F.col(f"d.{id_col}") == F.col("key")), F.col("label"))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    keep_at: float = 0.3,
) -> DataFrame:
    """Learns from the labelled documents and scores every whole text.

    labels: ``id_col`` and ``label_col`` (0 or 1; other rows teach nothing). Returns per row of docs:
    ``id_col``, ``score`` double and ``predicted`` int (1 from ``keep_at`` on). Null and empty texts
    are scored by the statistics of an empty text. Repeated rows give repeated rows and teach as often;
    null ids are scored and teach nothing. Other columns are neither read nor returned. The texts are
    read once: their statistics go to a table in the shared folder.
    """
    stats = stored(with_statistics(docs, id_col=id_col, text_col=text_col), "quality-statistics")
    model = learn(stats, labels, id_col=id_col, label_col=label_col)
    return score(stats, model, id_col=id_col).withColumn("predicted", (F.col("score") >= keep_at).cast("int"))
