"""Causal window aggregates: what each source did in the seconds before and up to an event.

An event counts from its own time until the window has passed, so what a window holds is a running sum over
arrivals and expiries: the work grows with the number of events, however many a window holds. A host or port
counts once: at an arrival if it was not seen within the window before, and it goes with an expiry if it is not
seen again within the window after.

A source with very many events within one window (a flood) is cut into ranges of equal row count. Each range
knows, for every host and port in it, when the ranges around it saw the same one; changes are added up by time
before they are scanned, range by range, and each range starts from what those before it add up to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelake.operators import scan

AGGREGATES = ("agg_distinct_dst_ports", "agg_distinct_dst_hosts", "agg_events_in_window", "agg_events_per_second")
_GROUP = ["source", "bucket"]
#: Rows of a range and what its neighbours tell it, in their order.
_BEFORE, _ROW, _AFTER = -1, 0, 1


def _placed(df: DataFrame, source: Column, us: Column, host: Column, port: Column, tie: Column | None, width: int, count: int) -> DataFrame:
    """Every row of the ``count`` that count in its own bucket, one window long, and as a copy without its columns in the next one; ``salt`` numbers the rows."""
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.when(us.isNotNull(), source).alias("source"), us.cast("long").alias("us"), host.alias("host"), port.alias("port"),
        (F.lit(0) if tie is None else tie).alias("tie"),
        (source.isNotNull() & us.isNotNull()).alias("known"),
        # numbers of rows as they are read, which stay the same if a task runs again
        F.monotonically_increasing_id().alias("salt"),
    )
    bucket = F.floor(F.col("us") / width)

    def place(at: Column, own: bool) -> Column:
        return F.struct(at.cast("long").alias("bucket"), F.lit(own).alias("own"))

    # rows that count nothing are spread out instead of meeting in one partition
    nowhere = F.array(place(F.pmod("salt", F.lit(1024)), True))
    placed = scan.spread(rows, "salt", 2 * count).withColumn("place", F.explode(F.when(F.col("known"), F.array(place(bucket, True), place(bucket + 1, False))).otherwise(nowhere)))
    return placed.select(F.when(F.col("place.own"), F.col("row")).alias("row"), "place.*", "source", "us", "host", "port", "tie", "known", "salt")


def _large_groups(df: DataFrame, source: Column, us: Column, width: int, most: int) -> tuple[int, DataFrame | None]:
    """How many rows count, and the sources and buckets in which more than ``most`` rows and copies can meet; None where there is none."""
    known = df.where(source.isNotNull() & us.isNotNull()).select(source.alias("source"), F.floor(us.cast("long") / width).alias("bucket"))
    rows, large = scan.counted_keys(known, _GROUP, most // 2)
    return rows, None if large is None else large.select("source", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket")).distinct()


def _seen(group: list[str], c: str, order: list[str], width: int) -> dict[str, Column]:
    """Whether a host (port) comes with a row, and goes with its expiry."""
    same = Window.partitionBy(*group, c).orderBy(*order)
    before, after = F.col("us") - F.lag("us").over(same), F.lead("us").over(same) - F.col("us")
    return {f"{c}_comes": (F.col(c).isNotNull() & (F.coalesce(before, F.lit(width + 1)) > width)).cast("int"), f"{c}_goes": (F.col(c).isNotNull() & (F.coalesce(after, F.lit(width + 1)) > width)).cast("int")}


def _changes(told: DataFrame, width: int) -> DataFrame:
    """Arrivals (phase 1) and expiries (phase 0) with what they add to the counts; ``rest`` is the time of the event after an expired one."""

    def change(at: Column, phase: int, n: int, hosts: Column, ports: Column, rest: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(phase).alias("phase"), F.lit(n).alias("n"), hosts.alias("hosts"), ports.alias("ports"), rest.alias("rest"))

    comes = change(F.col("us"), 1, 1, F.col("host_comes"), F.col("port_comes"), F.lit(None).cast("long"))
    goes = change(F.col("us") + width + 1, 0, -1, -F.col("host_goes"), -F.col("port_goes"), F.col("following"))
    # a bucket's own rows are all still counted at its end
    changes = told.withColumn("e", F.explode(F.when(F.col("own"), F.array(comes)).otherwise(F.array(comes, goes))))
    return changes.select("row", *_GROUP, "own", "known", "us", "tie", "e.*")


def _counted(out: DataFrame, n: Column, hosts: Column, ports: Column, rest: Column, least: Column) -> DataFrame:
    """The rows with their four aggregates, from the sums up to each."""
    # the event after the last expired one is the oldest that still counts
    span = F.greatest((F.col("us") - F.coalesce(rest, least)) / 1_000_000, F.lit(1.0))
    zero = F.lit(0).cast("long")
    values = {
        "agg_distinct_dst_ports": F.when(F.col("known"), ports).otherwise(zero),
        "agg_distinct_dst_hosts": F.when(F.col("known"), hosts).otherwise(zero),
        "agg_events_in_window": F.when(F.col("known"), n).otherwise(zero),
        "agg_events_per_second": F.when(F.col("known"), F.round(n / span, 6)).otherwise(F.lit(0.0)),
    }
    return out.withColumns(values).where("own").select("row.*", *AGGREGATES)


def _by_group(placed: DataFrame, width: int, ties: bool, rows: int) -> DataFrame:
    """Groups that fit a task: all sorts are within the partitions of one shuffle by source and bucket, as many as the ``rows`` that count ask for."""
    following = F.lead("us").over(Window.partitionBy(*_GROUP).orderBy("us", "tie"))
    # a row and its copy; a number of its own keeps partitions from growing with the table
    told = placed.drop("salt").repartition(scan.tasks(placed.sparkSession, 2 * rows), *_GROUP).withColumns(_seen(_GROUP, "host", ["us", "tie"], width)).withColumns(_seen(_GROUP, "port", ["us", "tie"], width)).withColumn("following", following)
    within = Window.partitionBy(*_GROUP)
    frame = within.orderBy("at", "phase", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow) if ties else within.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(c).over(frame) for c in ("n", "hosts", "ports")]
    return _counted(_changes(told, width), *sums, F.max("rest").over(frame), F.min("us").over(frame))


def _neighbours(parts: DataFrame, c: str | None) -> DataFrame:
    """What a range's neighbours tell it: of every host (port) in it the last time before and the first after; without one, the time that follows it."""
    key = [*_GROUP] if c is None else [*_GROUP, c]
    ends = (parts if c is None else parts.where(F.col(c).isNotNull())).groupBy(*key, "part").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    order = Window.partitionBy(*key).orderBy("part")
    beside = ends.select(*key, "part", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    told = [F.struct(F.lit(_BEFORE).alias("side"), F.col("before").alias("us")), F.struct(F.lit(_AFTER).alias("side"), F.col("after").alias("us"))]
    rows = beside.select(*key, "part", F.explode(F.array(*(told[1:] if c is None else told))).alias("e")).where("e.us IS NOT NULL")
    return rows.select(*key, "part", "e.*", F.lit(c or "time").alias("about"))


def _by_range(placed: DataFrame, width: int, ties: bool, most: int) -> DataFrame:
    """Groups of any size, by ranges of about ``most`` rows."""
    # the salt lets a range end amid very many rows of one time
    parts = scan.ranges(placed, _GROUP, ["us", "tie", "salt"], most=most).drop("salt")
    both = parts.withColumns({"side": F.lit(_ROW), "about": F.lit("time")})
    for c in ("host", "port", None):
        both = both.unionByName(_neighbours(parts, c), allowMissingColumns=True)
    # a neighbour's word about a host is in no port's order, nor in that of time
    group, order = [*_GROUP, "part"], ["side", "us", "tie"]
    about = {c: F.when(F.col("about") == c, F.col(c)).when(F.col("side") == _ROW, F.col(c)) for c in ("host", "port")}
    told = both.repartition(scan.tasks(parts.sparkSession, 2 * parts.count()), *group).withColumns(about)
    told = told.withColumns(_seen(group, "host", order, width)).withColumns(_seen(group, "port", order, width))
    in_time = Window.partitionBy(*group, F.col("about") == "time").orderBy(*order)
    told = told.withColumn("following", F.lead("us").over(in_time)).where(F.col("side") == _ROW)
    changes = scan.stored(_changes(told, width), "changes")
    place = ["at", "phase", "tie"] if ties else ["at"]
    sums = [F.sum(c).alias(c) for c in ("n", "hosts", "ports")]
    by_time = changes.groupBy(*_GROUP, *place).agg(*sums, F.max("rest").alias("rest"), F.min("us").alias("least"))
    how = {c: ("sum", c[4:]) for c in ("all_n", "all_hosts", "all_ports")} | {"all_rest": ("max", "rest"), "all_least": ("min", "least")}
    up_to = scan.running(scan.ranges(by_time, _GROUP, place, most=most), _GROUP, place, how).select(*_GROUP, *place, *how)
    own = changes.where("own AND phase = 1").select("row", "own", "known", "us", *_GROUP, *place)
    # dealt out by the join, so that a time with very many rows can be split
    joined = own.join(up_to.coalesce(1 << 20).hint("merge"), [*_GROUP, *place])
    return _counted(joined, *[F.col(c) for c in how])


def _aggregated(df: DataFrame, source: Column, us: Column, host: Column, port: Column, tie: Column | None, seconds: float, most: int) -> DataFrame:
    """All columns of df and the four aggregates. tie: of equal times only rows up to a row's own ``tie`` count; all do without."""
    width = int(seconds * 1_000_000)
    rows, large = _large_groups(df, source, us, width, most)
    placed = _placed(df, source, us, host, port, tie, width, rows)
    if large is None:
        return _by_group(placed, width, tie is not None, rows)
    rest, flooded = scan.split(placed, _GROUP, large)
    return _by_group(rest, width, tie is not None, rows).unionByName(_by_range(flooded, width, tie is not None, most))


def causal_window(df: DataFrame, source: Column, us: Column, host: Column, port: Column, *, seconds: float = 60.0, most: int = scan.MOST) -> DataFrame:
    """Adds the four aggregates over [time - seconds, time] of the same source, ties included.

    us: event time in microseconds. Rows without source or time stay, with zeros; null hosts and ports are not
    counted. A task holds no window: it sorts and sums, at most what a source has in two windows; where
    that may be more than ``most`` rows, the source's rows are cut into ranges.
    """
    return _aggregated(df, source, us, host, port, None, seconds, most)


def tie_ordered_window(df: DataFrame, source: str, us: str, order: str, host: str, port: str, *, seconds: float = 60.0, most: int = scan.MOST) -> DataFrame:
    """The offline variant: of rows with equal times only those not later in ``order`` count.

    Rows without source or time are left out, as in the offline tables.
    """
    rows = df.where(F.col(source).isNotNull() & F.col(us).isNotNull())
    return _aggregated(rows, F.col(source), F.col(us), F.col(host), F.col(port), F.col(order), seconds, most)


def range_self_join(df: DataFrame, key: str, source: str, us: str, host: str, port: str, *, seconds: float = 60.0, most: int = 50_000) -> DataFrame:
    """The window as a join of each event (known by ``key``) with those of its source's last seconds: exact distinct counts.

    Buckets one window long make the range an equality: a row meets only its own and the bucket before. A
    join makes all pairs, so sources and buckets where more than ``most`` rows may meet are left to the prefix scan, which makes none.
    """
    width = int(seconds * 1_000_000)
    rows = df.where(F.col(source).isNotNull() & F.col(us).isNotNull()).withColumn("__b", F.floor(F.col(us) / width))
    counts = [F.count_distinct("p").alias("agg_distinct_dst_ports"), F.count_distinct("h").alias("agg_distinct_dst_hosts"), F.count(F.lit(1)).alias("agg_events_in_window")]

    def joined(asking: DataFrame) -> DataFrame:
        now = asking.select(F.col(key), F.col(source).alias("s"), F.col(us).alias("t"), F.explode(F.array("__b", F.col("__b") - 1)).alias("b"))
        then = rows.select(F.col(source).alias("s2"), F.col(us).alias("t2"), F.col("__b").alias("b2"), F.col(host).alias("h"), F.col(port).alias("p"))
        met = now.join(then, (F.col("s") == F.col("s2")) & (F.col("b") == F.col("b2")) & F.col("t2").between(F.col("t") - width, F.col("t")))
        return met.groupBy(key).agg(*counts)

    _, large = _large_groups(rows, F.col(source), F.col(us), width, most)
    if large is None:
        return joined(rows)
    large, there = scan.stored(large, "large-groups"), {source: "source", "__b": "bucket"}
    scanned = causal_window(scan.met(rows, {source: "source"}, large.select("source").distinct(), "left_semi"), F.col(source), F.col(us), F.col(host), F.col(port), seconds=seconds, most=most)
    return joined(scan.met(rows, there, large, "left_anti")).unionByName(scan.met(scanned, there, large, "left_semi").select(key, *AGGREGATES[:3]))
