"""Events to numeric features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracelake.functions.scalars import finite
from tracelake.operators.causal import AGGREGATES, causal_window
from tracelake.schema import TIME_FEATURES, TRAFFIC


def aggregate_events(events: DataFrame, *, seconds: float = 60.0) -> DataFrame:
    """Adds the causal aggregates of each event's source (its address) to the events."""
    ip = F.nullif(F.col("src_endpoint.ip"), F.lit(""))
    return causal_window(events, ip, F.col("event_us"), F.col("dst_endpoint.ip"), F.col("dst_endpoint.port"), seconds=seconds).withColumn("aggregation_window_seconds", F.lit(float(seconds)))


def feature_map(events: DataFrame) -> Column:
    """Name to value: raw features, overridden by connection and traffic, with the aggregates; finite, no times, no labels."""
    named = {"duration": F.col("connection_info.duration"), "protocol_raw": F.col("connection_info.protocol_raw").try_cast("double")}
    named |= {f: F.col(f"traffic.{f}") for f in TRAFFIC} | {a: F.col(a).cast("double") for a in AGGREGATES if a in events.columns}
    over = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in named]), F.array(*named.values())), lambda _, v: v.isNotNull())
    raw = F.coalesce(F.col("unmapped.raw_flow_features"), F.create_map().cast("map<string,double>"))
    merged = F.map_concat(F.map_filter(raw, lambda k, _: ~F.map_contains_key(over, k)), over)
    dropped = [*TIME_FEATURES, "attack_cat", "label"]
    return F.transform_values(F.map_filter(merged, lambda k, v: ~k.isin(*dropped) & v.isNotNull()), lambda _, v: finite(v))


def feature_names(events: DataFrame) -> list[str]:
    """The sorted union of all features that any event has; the driver gets one row per name."""
    return sorted(r[0] for r in events.select(F.explode(F.map_keys(feature_map(events)))).distinct().collect())


def feature_matrix(events: DataFrame, names: list[str]) -> DataFrame:
    """A DOUBLE column per name, in the given order; 0.0 where an event lacks it."""
    rows = events.withColumn("__f", feature_map(events))
    kept = [c for c in events.columns if c not in names]
    return rows.select(*[F.col(f"`{c}`") for c in kept], *[F.coalesce(F.try_element_at("__f", F.lit(n)), F.lit(0.0)).alias(n) for n in names])


def label_of() -> Column:
    """The event's label; an error where it has none."""
    label = F.col("unmapped.label")
    return F.when(label.isNotNull(), label).otherwise(F.raise_error(F.lit("the event has no label")).cast("int"))
