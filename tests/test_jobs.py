"""Cleaning jobs, the scenario table and generation, end to end."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.operators.sample import Quotas
from tracelake.plans import jobs


def test_scenario_table(spark):
    unsw = spark.createDataFrame(
        [(0, "DoS", 1, "a", "h", "1", "100", "0.5", "3", "x"), (1, "Normal", 0, "a", "h", "2", "100", None, "1", "1"), (2, "Worms", 1, "a", "g", "2", "159.5", "1", "1", "1"), (3, "DoS", 1, None, "h", "1", "100", "1", "1", "1"), (4, "DoS", 1, "a", "h", "1", "soon", "1", "1", "1")],
        "k long, attack_cat string, label int, srcip string, dstip string, dsport string, stime string, dur string, spkts string, dpkts string",
    )
    found = {r.k: r for r in jobs.scenario_features(unsw, jobs.SCENARIO_SOURCES["unsw"], "k", day_first=False).collect()}
    assert found.keys() == {0, 1, 2}
    assert (found[0].duration, found[0].packets_out, found[0].packets_in) == (0.5, 3.0, 0.0) and found[1].duration == 0.0
    assert [found[k].agg_events_in_window for k in range(3)] == [1, 2, 3] and found[2].agg_distinct_dst_hosts == 2
    cicids = spark.createDataFrame([(9, "Bot", 1, "z", "h", "1", "3/7/2017 8:55", "1", "1", "1"), (10, "DoS", 1, "z", "h", "1", "3/7/2017 8:55:30", "1", "1", "1")], "k long, attack_cat string, label int, source_ip string, destination_ip string, destination_port string, timestamp string, flow_duration string, total_fwd_packets string, total_backward_packets string")
    more = jobs.scenario_features(cicids, jobs.SCENARIO_SOURCES["cicids"], "k", day_first=True)
    assert {r.k: r.agg_events_in_window for r in more.collect()} == {9: 1, 10: 2}
    both = jobs.combined_scenarios([jobs.scenario_features(unsw, jobs.SCENARIO_SOURCES["unsw"], "k", day_first=False), more], "k", per_class=1)
    assert both.columns == list(jobs.SCENARIO_COLUMNS)
    assert sorted(r.attack_cat for r in both.collect()) == ["DoS", "Generic", "Normal"]


def test_cleaning_jobs(spark):
    capture = spark.createDataFrame([("/d/Mirai.csv", "0", 1.0, 7.0), ("/d/Mirai.csv", "1", None, 7.0), ("/d/os_scan.csv", None, 3.0, 7.0)], "source_path string, anomaly string, size double, same double")
    found = jobs.clean_capture(capture)
    assert found.columns == ["attack_cat", "label", "size"]
    assert sorted((r.attack_cat, r.label, r["size"]) for r in found.collect()) == [("DDoS", 1, 2.0), ("Normal", 0, 1.0), ("Reconnaissance", 1, 3.0)]
    unsw = spark.createDataFrame([("0", 1.0), ("1", 2.0)], "label string, x double")
    assert sorted((r.attack_cat, r.label) for r in jobs.clean_unsw(unsw).collect()) == [("Generic", 1), ("Normal", 0)]
    named = spark.createDataFrame([(" Benign ", 1.0), ("Worm", float("inf"))], "attack_cat string, x double")
    assert sorted((r.attack_cat, r.label) for r in jobs.clean_unsw(named).collect()) == [("Normal", 0), ("Worms", 1)]
    flows = spark.createDataFrame([("BENIGN", 1.0, "Infinity", "a"), ("Web Attack - XSS", 5.0, "1", "b"), ("DoS Hulk", 9.0, "2", "c")], "Traffic_Class string, x double, rate string, t string")
    found = jobs.clean_flows(flows)
    assert found.columns == ["attack_cat", "label", "x", "t"]
    assert sorted((r.attack_cat, r.label) for r in found.collect()) == [("DoS", 1), ("Normal", 0), ("Web Attack – Xss", 1)]
    with pytest.raises(ValueError, match="no label"):
        jobs.clean_flows(flows.select("x"))


def test_generation(spark, tmp_path):
    real = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, "Normal").when(F.col("id") % 4 == 1, "DoS").otherwise("PortScan").alias("attack_cat"), F.when(F.col("id") % 2 == 0, F.col("id") % 10).otherwise(F.col("id") % 10 + 1000).cast("double").alias("x"))
    quotas = Quotas(train_total=300, train_normal=150, train_attack=60, synth_normal=50, synth_attack=20)
    for by_class in (False, True):
        out = jobs.generate(spark, "test", real, ["x"], "id", str(tmp_path / f"made{by_class}"), quotas=quotas, by_class=by_class)
        assert out.attack_categories == ["DoS", "PortScan"] and out.written == {"Normal": 50, "DoS": 20, "PortScan": 20} and sum(out.trained_on.values()) == 270
        facts = json.loads(spark.read.text(out.metadata).first()[0])
        assert facts["source"] == "test" and facts["quotas"]["synth_attack"] == 20
        rows = spark.read.option("header", True).csv(out.output).select("attack_cat", "label", F.col("x").cast("double"))
        assert {(r.attack_cat, r.label) for r in rows.collect()} == {("Normal", "0"), ("DoS", "1"), ("PortScan", "1")}
        if by_class:
            assert rows.where("attack_cat = 'Normal'").agg(F.max("x")).first()[0] < 10 < rows.where("attack_cat = 'DoS'").agg(F.min("x")).first()[0]
    with pytest.raises(RuntimeError, match="no attack category"):
        jobs.generate(spark, "test", real.where("attack_cat = 'Normal'"), ["x"], "id", str(tmp_path / "none"), quotas=quotas)
