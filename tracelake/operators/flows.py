"""Packets to flows: direction-free keys, gaps of inactivity, counts for either direction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracelake.operators import scan


def canonical_key(df: DataFrame, src_ip: str, src_port: str, dst_ip: str, dst_port: str) -> DataFrame:
    """Adds ``low`` and ``high``: the two (ip, port) endpoints in order of ip text, then port."""
    one = F.struct(F.col(src_ip).cast("string").alias("ip"), F.col(src_port).alias("port"))
    other = F.struct(F.col(dst_ip).cast("string").alias("ip"), F.col(dst_port).alias("port"))
    return df.withColumns({"low": F.least(one, other), "high": F.greatest(one, other)})


def gap_sessions(df: DataFrame, keys: list[str], us: str, ordinal: str, *, gap_seconds: float, most: int = scan.MOST) -> DataFrame:
    """Adds ``flow_no``: how often, in order of ``ordinal``, more than the gap lay between a row and the one before.

    A key with more than ``most`` rows is cut into ranges of its order: each counts on its own, from its own gaps and
    the one at its border, and what the ranges before it counted is added. ``ordinal`` tells a key's rows apart.
    """
    gap = int(gap_seconds * 1_000_000)
    large = scan.large_keys(df, keys, most)
    rest, hot = (df, None) if large is None else scan.split(df, keys, large)
    order = Window.partitionBy(*keys).orderBy(ordinal)
    late = (F.col(us) - F.lag(us).over(order) > gap).cast("int")
    counted = rest.withColumn("__new", F.coalesce(late, F.lit(0))).withColumn("flow_no", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    if hot is None:
        return counted
    told = scan.previous(scan.ranges(hot, keys, [ordinal], most=most), keys, [ordinal], us, "__before")
    told = told.withColumn("__new", F.coalesce((F.col(us) - F.col("__before") > gap).cast("int"), F.lit(0)))
    return counted.unionByName(scan.running(told, keys, [ordinal], {"flow_no": ("sum", "__new")}).select(*df.columns, "flow_no"))


def packet_flows(packets: DataFrame, *, flow_timeout: float = 120.0, protocols: tuple[str, ...] = ("TCP", "UDP"), most: int = scan.MOST) -> DataFrame:
    """Flows of packets (ordinal, ts in seconds, src_ip, src_port, dst_ip, dst_port, protocol, length, and path for several captures).

    A flow is a direction-free 5-tuple of one capture between two silences of more than ``flow_timeout`` seconds, in
    order of capture. Its first packet is the initiator's; packets and bytes are counted from there and
    back. Returns src_ip, src_port, dst_ip, dst_port, protocol, duration (rounded to 6), packets_out,
    packets_in, bytes_out, bytes_in, first_seen, and ``seq`` by capture, first appearance of key, then flow.
    """
    rows = packets.where(F.col("protocol").isin(*protocols)).withColumn("us", F.round(F.col("ts") * 1_000_000).cast("long"))
    if "path" not in packets.columns:
        rows = rows.withColumn("path", F.lit(""))
    key = ["path", "low", "high", "protocol"]
    keyed = gap_sessions(canonical_key(rows, "src_ip", "src_port", "dst_ip", "dst_port"), key, "us", "ordinal", gap_seconds=flow_timeout, most=most)
    # a flow has at most two directions: packets are added up by direction where they lie, then the earlier one is the initiator's
    first = F.struct("src_ip", "src_port", "dst_ip", "dst_port", "us", "ordinal")
    ways = keyed.groupBy(*key, "flow_no", "src_ip", "src_port").agg(
        F.min_by(first, "ordinal").alias("f"),
        F.max(F.struct("ordinal", "us")).alias("last"),
        F.count(F.lit(1)).alias("packets"),
        F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"),
    )
    both = ways.groupBy(*key, "flow_no").agg(
        F.min_by("f", "f.ordinal").alias("f"),
        F.max("last").alias("last"),
        F.min_by("packets", "f.ordinal").alias("packets_out"),
        F.sum("packets").alias("packets"),
        F.min_by("bytes", "f.ordinal").alias("bytes_out"),
        F.sum("bytes").alias("bytes"),
    )
    flows = both.select(
        *key, "flow_no", "f", F.col("last.us").alias("last"), "packets_out", (F.col("packets") - F.col("packets_out")).alias("packets_in"),
        "bytes_out", (F.col("bytes") - F.col("bytes_out")).alias("bytes_in"), F.col("f.ordinal").alias("at"),
    )
    key_order = F.min("at").over(Window.partitionBy(*key))
    return flows.withColumn("seq", F.struct("path", key_order.alias("key"), F.col("flow_no"))).select(
        "seq", "f.src_ip", "f.src_port", "f.dst_ip", "f.dst_port", "protocol",
        F.round((F.col("last") - F.col("f.us")) / 1_000_000, 6).alias("duration"),
        "packets_out", "packets_in", "bytes_out", "bytes_in",
        F.date_format(F.timestamp_micros("f.us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("first_seen"),
    )
