"""The causal window: causality, edges, ties, isolation, missing values, and equal plans."""

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tracelake.operators.causal import AGGREGATES, causal_window, range_self_join, tie_ordered_window

SCHEMA = "id long, src string, us long, host string, port string"


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    out = causal_window(df, F.col("src"), F.col("us"), F.col("host"), F.col("port"), **options)
    return {r.id: tuple(r[a] for a in AGGREGATES) for r in out.collect()}


def at(seconds):
    return int(seconds * 1_000_000)


def test_scan_counts_ports_and_is_causal(spark):
    found = run(spark, [(i, "a", at(i), "h", str(i)) for i in range(5)])
    assert found[0] == (1, 1, 1, 1.0)
    assert found[4] == (5, 1, 5, 1.25)


def test_edges_are_inclusive_and_older_events_leave(spark):
    found = run(spark, [(0, "a", at(0), "h", "1"), (1, "a", at(60), "h", "2"), (2, "a", at(121), "h", "3")])
    assert found[1][2] == 2 and found[2][2] == 1


def test_ties_see_each_other(spark):
    assert {v[2] for v in run(spark, [(i, "a", at(1), "h", None) for i in range(3)]).values()} == {3}


def test_sources_are_apart_and_missing_ones_count_nothing(spark):
    rows = [(0, "a", at(0), "h", "1"), (1, "b", at(0), "h", "1"), (2, None, at(0), "h", "1"), (3, "a", None, "h", "1"), (4, None, None, None, None)]
    found = run(spark, rows)
    assert len(found) == 5
    assert found[0][2] == found[1][2] == 1
    assert found[2] == found[3] == found[4] == (0, 0, 0, 0.0)


def test_empty_table(spark):
    assert run(spark, []) == {}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 200), st.sampled_from(["x", "y", None]), st.integers(0, 3)), max_size=25))
def test_plans_agree_with_each_other_and_with_a_loop(spark, events):
    rows = [(i, s, at(t), h, str(p)) for i, (s, t, h, p) in enumerate(events)]
    plain = run(spark, rows)
    for i, s, us, _, _ in rows:
        near = [r for r in rows if r[1] == s and us - at(60) <= r[2] <= us]
        span = max((us - min(r[2] for r in near)) / 1e6, 1.0)
        want = (len({r[4] for r in near}), len({r[3] for r in near if r[3]}), len(near))
        assert plain[i][:3] == want and abs(plain[i][3] - len(near) / span) < 1e-6
    df = spark.createDataFrame(rows, SCHEMA)
    joined = {r.id: r.agg_events_in_window for r in range_self_join(df, "id", "src", "us", "host", "port").collect()}
    assert joined == {k: v[2] for k, v in plain.items()}


def test_tie_ordered_variant_hides_later_ties(spark):
    df = spark.createDataFrame([(i, "a", at(1), "h", str(i)) for i in range(3)], SCHEMA)
    found = {r.id: (r.agg_events_in_window, r.agg_distinct_dst_ports) for r in tie_ordered_window(df, "src", "us", "id", "host", "port").collect()}
    assert found == {0: (1, 1), 1: (2, 2), 2: (3, 3)}


def test_a_hot_source_in_one_window(spark):
    """Thousands of events of one source within the window: the work must not grow with the window's size."""
    rows = [(i, "hot", at(i / 1000), f"h{i % 7}", str(i % 5000)) for i in range(20_000)]
    found = run(spark, rows)
    assert found[19_999] == (5000, 7, 20_000, round(20_000 / 19.999, 6)) and found[100][:3] == (101, 7, 101)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 90), st.sampled_from(["x", "y", None]), st.integers(0, 3)), max_size=25))
def test_tie_ordered_variant_agrees_with_a_loop(spark, events):
    rows = [(i, s, at(t), h, str(p)) for i, (s, t, h, p) in enumerate(events)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r.id: tuple(r[a] for a in AGGREGATES) for r in tie_ordered_window(df, "src", "us", "id", "host", "port", seconds=20).collect()}
    assert found.keys() == {r[0] for r in rows}
    for i, s, us, _, _ in rows:
        near = [r for r in rows if r[1] == s and us - at(20) <= r[2] and (r[2], r[0]) <= (us, i)]
        span = max((us - min(r[2] for r in near)) / 1e6, 1.0)
        assert found[i][:3] == (len({r[4] for r in near}), len({r[3] for r in near if r[3]}), len(near)) and abs(found[i][3] - len(near) / span) < 1e-6


def ranged(spark, rows, most, **options):
    from tracelake.operators import causal

    df = spark.createDataFrame(rows, SCHEMA)
    out = causal.causal_window(df, F.col("src"), F.col("us"), F.col("host"), F.col("port"), most=most, **options)
    return {r.id: tuple(r[a] for a in AGGREGATES) for r in out.collect()}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("aab"), st.integers(0, 90) | st.sampled_from([5, 5, 61]), st.sampled_from(["x", "y", None]), st.sampled_from([0, 1, None])), max_size=40), st.integers(2, 9))
def test_ranges_of_a_large_source_agree_with_one_task(spark, events, most):
    rows = [(i, s, at(t), h, None if p is None else str(p)) for i, (s, t, h, p) in enumerate(events)] + [(1000, None, 5, "x", "1"), (1001, "a", None, "x", "1")]
    assert ranged(spark, rows, most) == run(spark, rows)
    df = spark.createDataFrame(rows, SCHEMA)
    both = [{tuple(r) for r in tie_ordered_window(df, "src", "us", "id", "host", "port", seconds=20, **o).collect()} for o in ({}, {"most": most})]
    assert both[0] == both[1]


def test_a_flood_is_spread_evenly(spark):
    """A third of all rows from one source within one window, most of them at one time: no task has much more than the others."""
    from tracelake.operators import scan

    rows = spark.range(60_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 997) END AS src", "CASE WHEN id % 6 = 0 THEN 7 ELSE id END AS us", "id")
    parts = scan.ranges(rows, ["src"], ["us", "id"], most=4000)
    sizes = sorted(r["count"] for r in parts.groupBy("part").count().collect())
    assert len(sizes) == 15 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert parts.where("src = 'hot'").select("part").distinct().count() >= 5


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("aaab"), st.integers(0, 200), st.sampled_from(["x", "y", None]), st.integers(0, 3)), min_size=5, max_size=40), st.integers(2, 12))
def test_self_join_leaves_floods_to_the_scan(spark, events, most):
    rows = [(i, s, at(t), h, str(p)) for i, (s, t, h, p) in enumerate(events)]
    df = spark.createDataFrame(rows, SCHEMA)
    one, two = ({tuple(r) for r in range_self_join(df, "id", "src", "us", "host", "port", most=m).collect()} for m in (10**6, most))
    assert one == two and len(one) == len(rows)
