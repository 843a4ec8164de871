"""Prefix scans against plain loops; sessions whose packets are cut into ranges."""

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tracelake.operators import causal, flows, scan

ROWS = st.lists(st.tuples(st.sampled_from(["a", "a", "b", None]), st.integers(0, 50), st.integers(-5, 5) | st.none()), min_size=1, max_size=40)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ROWS)
def test_running_values_neighbours_and_numbers(spark, rows):
    rows = [(k, o, i, v) for i, (k, o, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k string, o int, i int, v int")
    parts = scan.ranges(df, ["k"], ["o", "i"], most=3)
    found = {r.i: r for r in scan.running(parts, ["k"], ["o", "i"], {"total": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v")}).collect()}
    last = {r.i: r.last for r in scan.previous(parts, ["k"], ["o", "i"], "v", "last").collect()}
    place = {r.i: r.number for r in scan.numbered(parts, ["k", "o", "i"]).collect()}
    assert len(found) == len(last) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    assert [place[r[2]] for r in ordered] == [*range(len(rows))]
    for k, o, i, _ in rows:
        upto = [r[3] for r in ordered if r[0] == k and (r[1], r[2]) <= (o, i)]
        held = [v for v in upto if v is not None]
        assert (found[i].total, found[i].low, found[i].high) == ((sum(held), min(held), max(held)) if held else (None, None, None))
        assert last[i] == (upto[-2] if len(upto) > 1 else None)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "a", None]), st.integers(0, 12)), max_size=40), st.integers(1, 8))
def test_sessions_of_large_keys(spark, rows, most):
    df = spark.createDataFrame([(k, t * 1_000_000, i) for i, (k, t) in enumerate(rows)], "k string, us long, i int")
    plain, cut = ({r.i: r.flow_no for r in flows.gap_sessions(df, ["k"], "us", "i", gap_seconds=3, most=m).collect()} for m in (10**6, most))
    want, before, number = {}, {}, {}
    for i, (k, t) in enumerate(rows):
        number[k] = number.get(k, 0) + (k in before and t - before[k] > 3)
        before[k] = t
        want[i] = number[k]
    assert plain == cut == want


def test_flows_of_one_large_talk(spark):
    """One pair of hosts with a third of all packets: the same flows, however it is cut."""
    talk = F.col("id") % 3 == 0
    ip = lambda c, n: F.when(talk, c).otherwise(F.concat(F.lit("10.0.0."), (F.col("id") % n).cast("string")))
    away = F.col("id") % 2 == 0
    rows = spark.range(3000).select(
        F.col("id").alias("ordinal"), (F.col("id") * 1.0 + F.when(F.col("id") > 1500, 500).otherwise(0)).alias("ts"), F.when(away, ip("a", 7)).otherwise(ip("b", 7)).alias("src_ip"), F.when(away, ip("b", 5)).otherwise(ip("a", 5)).alias("dst_ip"),
        F.when(away, 1).otherwise(2).alias("src_port"), F.when(away, 2).otherwise(1).alias("dst_port"), F.lit("TCP").alias("protocol"), (F.col("id") % 90).cast("int").alias("length"),
    )
    plain, cut = (sorted(map(str, flows.packet_flows(rows, flow_timeout=60, most=m).collect())) for m in (10**6, 100))
    assert plain == cut and len(plain) > 3


def test_ranges_do_not_multiply_with_the_table(spark):
    """Very small ranges are asked for: beyond a number they grow instead, in the same order."""
    parts = scan.ranges(spark.range(20_000).withColumn("k", F.col("id") % 3), ["k"], ["id"], most=10)
    found = parts.groupBy("part").agg(F.count("id").alias("n"), F.min(F.struct("k", "id")).alias("low"), F.max(F.struct("k", "id")).alias("high")).orderBy("part").collect()
    assert len(found) <= scan.RANGES and sum(r.n for r in found) == 20_000
    assert all(a.high < b.low for a, b in zip(found, found[1:]))


def test_large_keys_meet_their_rows(spark, monkeypatch):
    """The same rows, whether the keys are broadcast or too many for it."""
    rows = spark.range(8_000).selectExpr("CASE WHEN id % 2 = 0 THEN NULL ELSE id % 5 END AS k", "id")
    large = scan.large_keys(rows, ["k"], 2000)
    few = [{r.id for r in part.collect()} for part in scan.split(rows, ["k"], large)]
    monkeypatch.setattr(scan, "FEW", 0)
    many = [{r.id for r in part.collect()} for part in scan.split(rows, ["k"], large)]
    assert few == many and few[1] == {*range(0, 8_000, 2)} and few[0] == {*range(1, 8_000, 2)}


def test_places_in_one_shuffle(spark):
    """Rows are numbered in their order without gaps; only the deal itself moves rows."""
    rows = spark.range(5_000).selectExpr("id * 7919 % 5000 AS o", "id")
    found = scan.placed(rows, ["o"])
    assert all(r.o == r.number for r in found.collect())
    assert "Window" not in found._jdf.queryExecution().toString() and "SortMergeJoin" not in found._jdf.queryExecution().toString()


def test_rows_of_many_partitions_are_dealt_out_first(spark, monkeypatch):
    """Beyond a number of partitions no task deals out a whole split of the input; the rows stay the same."""
    rows = spark.range(0, 3_000, 1, 1).selectExpr("id", "IF(id % 7 = 0, NULL, id % 3) AS source", "id * 1000000 AS us", "id % 5 AS host", "id % 11 AS port")

    def found(most):
        return causal.causal_window(rows, *map(F.col, ("source", "us", "host", "port")), most=most)

    plain = sorted(found(10**6).collect())
    monkeypatch.setattr(scan, "TASK", 20)
    for most in (10**6, 500):
        assert sorted(found(most).collect()) == plain
    # a task of the deal by groups reads its share of the rows, not all of them
    many = found(10**6)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(salt#" in many and f", {scan.DIRECT}), REPARTITION_BY_NUM" in many
