"""Cuts, forms and restored texts against plain Python, and ranks and selection against sums."""

import hashlib
import re

import numpy as np
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tracelake.llm import fill_in_middle as fim


def brute(key, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(spark, rows):
    df = spark.createDataFrame([(k, t, "x", 5) for k, t in rows], "doc_id long, text string, output string, n int")
    found = fim.transform(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in found), key=key) == sorted(((k, *brute(k, t), t or "") for k, t in rows), key=key)


def test_edges(spark):
    odd = [None, "", " ", "\n\t ", "a", " a ", "é 𝒳 ü x", "a<P>b c", "<S>", "x <M", "<<P >S> <", "a < b <P c", "word " * 5000, "x" * 100_000, "\x0b\x0c\r a"]
    check(spark, [(i, t) for i in range(40) for t in odd] + [(None, "a b c"), (3, "a b c"), (3, "a b c")])


def test_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-5, 10**12), st.text(st.sampled_from(" \n\x0ba<é𝒳>PSM\x1c"), max_size=40)), max_size=30))
def test_any_text(spark, rows):
    check(spark, rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=2000))
def test_rank_and_select(bits):
    bits = np.array(bits, bool)
    found = fim.RankSelect(bits)
    assert found.total == bits.sum()
    assert (found.rank(np.arange(len(bits) + 1)) == np.concatenate([[0], np.cumsum(bits)])).all()
    assert (found.select(np.arange(bits.sum())) == np.flatnonzero(bits)).all()


def test_texts_are_cut_into_parts_by_bytes(spark, monkeypatch):
    starts = np.array([0, 10, 20, 20, 90, 95, 300])
    monkeypatch.setattr(fim, "BYTES", 30)
    assert [*fim._parts(starts)] == [(0, 3), (3, 4), (4, 5), (5, 6)]
