"""Counts, distributions and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelake.operators.quantiles import group_quantiles
from tracelake.schema import NORMAL


def class_counts(df: DataFrame, by: Column) -> DataFrame:
    return df.groupBy(F.trim(by).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, by: Column) -> DataFrame:
    """Counts with shares, rounded to three places. The window runs over one row per category."""
    whole = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return class_counts(df, by).withColumn("share", F.round(F.col("n") / whole, 3))


def top_k(df: DataFrame, by: Column, k: int) -> DataFrame:
    return class_counts(df, by).orderBy(F.desc("n"), "category").limit(k)


def group_medians(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Exact medians per group."""
    return group_quantiles(df, by, {f"median_{c}": (F.col(c), 0.5) for c in columns})


def label_consistency(df: DataFrame, label: Column, category: Column) -> DataFrame:
    """How many rows break label 0 = Normal, and how many there are."""
    normal = F.lower(category) == "normal"
    return df.agg(
        F.count_if((label == 0) & ~normal).alias("zero_not_normal"),
        F.count_if((label == 1) & normal).alias("one_normal"),
        F.count(F.lit(1)).alias("n"),
    )


def malicious_split(df: DataFrame, label: Column, category: Column) -> DataFrame:
    """The canonical count of malicious findings and the two older ways to count them."""
    return df.agg(
        F.count_if(~category.isin(*NORMAL)).alias("malicious"),
        F.count_if(label == 1).alias("label_is_one"),
        F.count_if((label != 0) & (category != "Normal")).alias("label_and_category"),
        F.count(F.lit(1)).alias("n"),
    )


def classification_metrics(df: DataFrame, truth: Column, prediction: Column) -> DataFrame:
    """Accuracy, F1, precision and recall (macro over classes in truth or prediction; 0 where undefined), from the confusion counts."""
    cells = df.groupBy(truth.alias("t"), prediction.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("c"), "n", F.lit(0).alias("pn")), F.struct(F.col("p").alias("c"), F.lit(0).alias("n"), F.col("n").alias("pn")))).alias("s"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    per = sides.groupBy("s.c").agg(F.sum("s.n").alias("truth"), F.sum("s.pn").alias("predicted"), (F.sum("hit") / 2).alias("hit"))
    precision = F.when(F.col("predicted") > 0, F.col("hit") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("truth") > 0, F.col("hit") / F.col("truth")).otherwise(0.0)
    f1 = F.when(F.col("hit") > 0, 2 * F.col("hit") / (F.col("truth") + F.col("predicted"))).otherwise(0.0)
    return per.agg(
        F.round(F.sum("hit") / F.sum("truth"), 6).alias("accuracy"),
        F.round(F.avg(f1), 6).alias("f1_macro"),
        F.round(F.sum(f1 * F.col("truth")) / F.sum("truth"), 6).alias("f1_weighted"),
        F.round(F.avg(precision), 6).alias("precision_macro"),
        F.round(F.avg(recall), 6).alias("recall_macro"),
    )
