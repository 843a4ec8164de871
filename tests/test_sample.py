"""Selection by counted hashes against a plain sort, on every depth of digits."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tracelake.operators import sample


def ranked(rows, k):
    """Keys among the first k(size) of their class in hash order; equal keys together or not at all."""
    out = set()
    for c in {r[0] for r in rows}:
        own = sorted((hashlib.md5(f"42:{key}".encode()).hexdigest(), key) for x, key in rows if x == c)
        want = min(k(c, len(own)), len(own))
        while 0 < want < len(own) and own[want] == own[want - 1]:
            want -= 1
            while 0 < want and own[want - 1] == own[want]:
                want -= 1
        out |= {(c, key) for _, key in own[:want]}
    return out


@pytest.mark.parametrize("few", [10_000, 2])
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["Normal", "a", "b", None]), st.integers(0, 60)), min_size=1, max_size=70), st.integers(0, 12))
def test_caps_and_splits_are_those_of_a_sort(spark, few, rows, n):
    old, sample.FEW = sample.FEW, few
    try:
        df = spark.createDataFrame(rows, "c string, id long")
        assert {(r.c, r.id) for r in sample.class_cap(df, "c", "id", n).collect()} == ranked(rows, lambda c, size: n)
        split = sample.stratified_split(df, "c", "id", test=0.3).collect()
        assert len(split) == len(rows)
        assert {(r.c, r.id) for r in split if r.is_test} == ranked(rows, lambda c, size: int(size * 0.3 + 0.5))
    finally:
        sample.FEW = old


def test_deeper_digits(spark, monkeypatch):
    monkeypatch.setattr(sample, "DIGITS", 1)
    monkeypatch.setattr(sample, "FEW", 1)
    rows = [("a" if i % 3 else "b", i) for i in range(400)]
    df = spark.createDataFrame(rows, "c string, id long")
    for n in (1, 57, 133, 10_000):
        assert {(r.c, r.id) for r in sample.class_cap(df, "c", "id", n).collect()} == ranked(rows, lambda c, size: n)


def test_a_split_needs_no_window(spark):
    df = spark.range(1000).selectExpr("id % 3 AS c", "id")
    found = sample.stratified_split(df, "c", "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    sizes = {(r.c, r.is_test): r["count"] for r in found.groupBy("c", "is_test").count().collect()}
    assert sizes == {(0, True): 67, (0, False): 267, (1, True): 67, (1, False): 266, (2, True): 67, (2, False): 266}


def test_total_and_empty(spark):
    quotas = sample.Quotas(train_total=30, train_normal=25, train_attack=10)
    df = spark.range(300).selectExpr("element_at(array('Normal', 'DoS', 'Bot'), cast(id % 3 AS int) + 1) AS c", "id")
    found = sample.stratified_quota(df, "c", "id", quotas).collect()
    assert len(found) == 30
    assert sample.stratified_quota(df.limit(0), "c", "id", quotas).count() == 0
    assert sample.class_cap(df, "c", "id", 0).count() == 0
