"""The jobs that make training data: cleaned data sets, the scenario table, and synthetic rows by quota."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracelake.functions.scalars import day_first_seconds, number
from tracelake.operators import clean, sample, synth
from tracelake.operators.causal import tie_ordered_window

# Columns of the two data sets of the scenario table, by their common names.
SCENARIO_SOURCES = {
    "unsw": {
        "src_ip": "srcip", "dst_ip": "dstip", "dst_port": "dsport", "time": "stime",
        "duration": "dur", "packets_out": "spkts", "packets_in": "dpkts",
    },
    "cicids": {
        "src_ip": "source_ip", "dst_ip": "destination_ip", "dst_port": "destination_port", "time": "timestamp",
        "duration": "flow_duration", "packets_out": "total_fwd_packets", "packets_in": "total_backward_packets",
    },
}

# The columns of the scenario table, in order.
SCENARIO_COLUMNS = (
    "attack_cat", "label", "duration", "packets_in", "packets_out",
    "agg_distinct_dst_hosts", "agg_distinct_dst_ports", "agg_events_in_window", "agg_events_per_second",
)

# Names of an internal label column of a capture's table, and what there means ordinary traffic.
CAPTURE_LABELS = ("label", "class", "attack", "anomaly", "is_anomaly", "malicious")
BENIGN = ("0", "benign", "false", "no", "normal")


def scenario_features(df: DataFrame, names: dict[str, str], key: str, *, day_first: bool, seconds: float = 60.0) -> DataFrame:
    """The scenario table of one data set (text columns in snake case), with its ``key``.

    names: the data set's columns by their common names (see SCENARIO_SOURCES). Times are epoch seconds, or day-first dates with ``day_first``. Rows
    without source or readable time are dropped; numbers that are none count as 0. Of rows with equal source
    and time only those up to a row's own key count in its window.
    """
    rows = df.withColumnsRenamed({old: new for new, old in names.items()})
    ts = day_first_seconds(F.col("time")).cast("double") if day_first else F.col("time").try_cast("double")
    rows = rows.withColumn("us", F.round(ts * 1_000_000).cast("long"))
    rows = rows.withColumns({c: number(F.col(c)) for c in ("duration", "packets_out", "packets_in")})
    found = tie_ordered_window(rows.select(key, "attack_cat", "label", "src_ip", "dst_ip", "dst_port", "us", "duration", "packets_in", "packets_out"), "src_ip", "us", key, "dst_ip", "dst_port", seconds=seconds)
    return found.select(key, *SCENARIO_COLUMNS)


def combined_scenarios(tables: list[DataFrame], key: str, *, per_class: int = 40_000) -> DataFrame:
    """The data sets' tables together, at most ``per_class`` rows of each category, picked by a hash of the key; the smaller taxonomy's names."""
    rows = reduce(DataFrame.unionByName, tables).withColumn("attack_cat", clean.scenario_category(F.col("attack_cat")))
    return sample.class_cap(rows, "attack_cat", key, per_class).select(*SCENARIO_COLUMNS)


def labels_first(df: DataFrame) -> DataFrame:
    """``attack_cat`` and ``label`` before all other columns."""
    return df.select("attack_cat", "label", *[F.col(f"`{c}`") for c in df.columns if c not in ("attack_cat", "label")])


def _cleaned(df: DataFrame, category: Column) -> DataFrame:
    """Category and label set, missing numbers imputed, constant columns dropped, labels first."""
    labeled = df.withColumn("attack_cat", category)
    labeled = labeled.withColumn("label", clean.label_bit(F.col("attack_cat")))
    numeric = [c for c, t in labeled.dtypes if t in ("double", "float") and c != "label"]
    filled = clean.impute_median(labeled, numeric)
    dropped = [c for c in clean.constant_columns(filled) if c not in ("attack_cat", "label")]
    return labels_first(filled.drop(*dropped))


def clean_unsw(df: DataFrame) -> DataFrame:
    """A table with ``attack_cat`` or, without it, a label from which the category falls back."""
    if "attack_cat" in df.columns:
        return _cleaned(df, clean.label_unsw(F.col("attack_cat")))
    return _cleaned(df, clean.fallback_category(F.col("label").try_cast("int")))


def clean_capture(df: DataFrame, path: str = "source_path") -> DataFrame:
    """Tables of captures whose file names tell the attack: rows that an internal label calls benign are Normal.

    The first of the internal label columns is read, and all of them are dropped.
    """
    inside = [c for c in df.columns if c in CAPTURE_LABELS]
    category = clean.label_kitsune(clean.label_from_path(F.col(path)))
    if inside:
        benign = F.lower(F.trim(F.col(f"`{inside[0]}`").cast("string"))).isin(*BENIGN)
        category = F.when(benign, "Normal").otherwise(category)
    named = df.withColumn("attack_cat", category).drop(*inside)
    return _cleaned(named.drop(path), F.col("attack_cat"))


def clean_flows(df: DataFrame) -> DataFrame:
    """Flow tables whose label column is found by its name; text columns that hold Infinity are dropped, numbers winsorized."""
    label = clean.find_label_column(df.columns)
    if label is None:
        raise ValueError(f"no label among the columns {', '.join(df.columns)}")
    category = clean.hyphens(clean.label_cicids(F.col(f"`{label}`").cast("string")))
    named = df.withColumn("attack_cat", category)
    kept = clean.drop_containing(named if label in ("attack_cat", "label") else named.drop(label))
    return clean.winsorize(_cleaned(kept, F.col("attack_cat")))


@dataclass(frozen=True)
class Generated:
    """What a generation job found and wrote."""

    source: str
    attack_categories: list[str]
    trained_on: dict[str, int]
    written: dict[str, int]
    output: str
    metadata: str


def generate(spark: SparkSession, source: str, real: DataFrame, columns: list[str], key: str, output: str, *, quotas: sample.Quotas = sample.Quotas(), by_class: bool = False) -> Generated:
    """Counts the categories, samples, fits, samples by quota, and writes CSV and metadata.

    One copula for all classes, or with ``by_class`` one for each. RuntimeError where no attack category is found.
    The rows are written as they are made, below ``output``; the metadata as one JSON line beside them.
    """
    counts = {r.category: r.n for r in real.groupBy(F.trim("attack_cat").alias("category")).agg(F.count(F.lit(1)).alias("n")).collect()}
    attacks = sorted(c for c in counts if c and c.lower() != "normal")
    if not attacks:
        raise RuntimeError(f"no attack category in {source}")
    picked = sample.stratified_quota(real, "attack_cat", key, quotas)
    trained = {r.attack_cat: r.n for r in picked.groupBy("attack_cat").agg(F.count(F.lit(1)).alias("n")).collect()}
    if by_class:
        copulas = synth.fit_by(picked, columns, F.trim("attack_cat"))
    else:
        copulas = {"": synth.fit(picked, columns)}
    wanted = {c: quotas.synth_attack for c in attacks if not by_class or c in copulas}
    if not by_class or "Normal" in copulas:
        wanted["Normal"] = quotas.synth_normal
    rows = synth.by_quota(spark, copulas, wanted, seed=quotas.seed)
    rows.write.mode("overwrite").option("header", True).csv(output)
    facts = {"source": source, "quotas": asdict(quotas), "copulas": {c: m.metadata() for c, m in copulas.items()}}
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{output}.metadata.json")
    written = {r.attack_cat: r.n for r in spark.read.option("header", True).csv(output).groupBy("attack_cat").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Generated(source, attacks, trained, written, output, f"{output}.metadata.json")
