"""Training, freezing, scoring, custody, reports and the whole case."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import clean, custody, model, report, sample, synth
from tracelake.plans.case import run_case

FEATURES = ["agg_distinct_dst_ports", "agg_events_in_window"]


def training(spark):
    rng = np.random.default_rng(1)
    rows = [(i, c, float(rng.normal(m, 1)), float(rng.normal(2 * m, 1))) for i, (c, m) in enumerate([("Normal", 1), ("PortScan", 8), ("DoS", 20)] * 60)]
    return spark.createDataFrame(rows, ["key", "category", *FEATURES])


@pytest.fixture(scope="module")
def trained(spark):
    return model.train(training(spark), FEATURES, "category", "key", trees=8, depth=4)


def test_model_is_frozen_and_explained(spark, trained, tmp_path):
    assert trained.classes == ["DoS", "Normal", "PortScan"] and trained.metrics["f1_macro"] > 0.9
    model.certify(spark, trained, str(tmp_path), "v1")
    frozen = model.FrozenClassifier(spark, str(tmp_path), "v1")
    found = frozen.explain(frozen.predict(training(spark)), 1).collect()
    assert len(found) == 180 and all(abs(sum(r.prediction.class_probabilities.values()) - 1) < 1e-9 for r in found)
    assert all(len(r.top_features) == 1 for r in found)
    with pytest.raises(FileNotFoundError):
        model.FrozenClassifier(spark, str(tmp_path), "v9")
    path = tmp_path / "model_v1.manifest.json"
    part = next(path.glob("part-*"))
    part.write_text(part.read_text().replace('"model_hash": "', '"model_hash": "0'))
    for crc in path.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(model.ModelIntegrityError):
        model.FrozenClassifier(spark, str(tmp_path), "v1")
    assert model.next_version(["v1", "v3"]) == "v2"


def test_contributions_add_up(spark, trained):
    forest = model.Forest.of(trained.model)
    x = np.array([[1.0, 2.0], [8.0, 16.0], [20.0, 41.0], [0.0, 50.0]])
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], FEATURES)
    want = np.array([r.probability.toArray() for r in trained.model.setFeaturesCol("__x").transform(model._vectors(rows, FEATURES)).collect()])
    assert np.allclose(forest.base() + forest.contributions(x).sum(1), want, atol=1e-6)


def test_chain_holds_and_tampering_shows(spark, tmp_path):
    chain = custody.CustodyChain(spark, str(tmp_path / "chain"))
    for n in range(3):
        chain.append("a", f"step{n}", "test", None if n == 0 else str(n - 1), str(n), "ñ – note")
        chain.append("b", "other", "test", "x", "y")
    assert chain.verify("a") == {"case_id": "a", "valid": True, "total_records": 3, "issues": []}
    assert chain.verify("none") == {"case_id": "none", "valid": True, "total_records": 0, "issues": []}
    assert not chain.verify("a", expected=4)["valid"]
    rows = chain.chain("a")
    changed = custody.verify_chain(rows.withColumn("notes", F.when(F.col("idx") == 2, "other").otherwise(F.col("notes")))).first()
    assert len(changed.issues) == 1 and "#2" in changed.issues[0]
    cut = custody.verify_chain(rows.where("idx <> 2")).first()
    assert "#3" in cut.issues[0]


def test_digest_depends_on_order_and_content(spark):
    df = spark.createDataFrame([(i, f"v{i % 3}") for i in range(10_000)], "seq long, v string")
    one = custody.table_digest(df)
    assert one[1] == 10_000 and custody.table_digest(df.repartition(7)) == one
    assert custody.table_digest(df.withColumn("v", F.when(F.col("seq") == 7, "x").otherwise(F.col("v"))))[0] != one[0]
    assert custody.table_digest(df.limit(0))[1] == 0


def test_whole_case(spark, trained, tmp_path):
    model.certify(spark, trained, str(tmp_path), "v1")
    frozen = model.FrozenClassifier(spark, str(tmp_path), "v1")
    chain = custody.CustodyChain(spark, str(tmp_path / "chain"))
    alerts = [{"timestamp": f"2026-01-05T10:00:{s:02d}.000000+0000", "event_type": "alert", "src_ip": "1.1.1.1", "dest_ip": "2.2.2.2", "dest_port": s, "alert": {"severity": 1}} for s in range(9)]
    path = tmp_path / "eve.json"
    path.write_text("\n".join(map(json.dumps, alerts)))
    steps = []
    found = run_case(spark, "c1", "auto", str(path), frozen, chain, on_step=lambda s, i: steps.append(s))
    assert steps == ["ingest", "ocsf_normalize", "aggregate", "feature_extract", "classify", "verify"]
    assert found.verification["valid"] and found.verification["total_records"] == 5
    links = chain.chain("c1").collect()
    assert all(b.input_hash == a.output_hash for a, b in zip(links, links[1:]))
    rows = found.findings.orderBy("seq").collect()
    assert rows[0].category == "Normal" and rows[-1].category == "PortScan"
    text = report.markdown("c1", found.findings, found.verification)
    assert "PortScan" in text and "## Recommendation" in text
    report.write_case(spark, "c1", found.findings, chain.report("c1"), str(tmp_path / "report"))
    head = json.loads(spark.read.text(str(tmp_path / "report/case")).first()[0])
    assert head["case_id"] == "c1" and head["findings"] == 9 and head["verification"]["valid"] and len(head["custody"]) == 5
    annex = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "report/annex")).collect())
    bad = [r for r in rows if r.category != "Normal"]
    assert annex.count("### Event") == len(bad) and "- contributions: " in annex and "- probabilities: " in annex
    assert spark.read.json(str(tmp_path / "report/findings")).count() == 9
    # the evidence changes: what was returned does not
    path.write_text(json.dumps(alerts[0]))
    assert [r.seq for r in found.findings.orderBy("seq").collect()] == [r.seq for r in rows]
    assert report.markdown("c1", found.findings, found.verification) == text
    path.write_text(json.dumps({"event_type": "flow"}))
    steps.clear()
    empty = run_case(spark, "c2", "suricata_eve", str(path), frozen, chain, on_step=lambda s, i: steps.append(s))
    assert steps == ["ingest", "ocsf_normalize", "done"] and empty.findings is None and empty.verification["total_records"] == 2
    with pytest.raises(ValueError, match="unknown source"):
        run_case(spark, "c3", "nothing", str(path), frozen, chain)


def test_report_aggregates(spark):
    f = "array<struct<feature: string, shap_value: double>>"
    rows = [(0, "PortScan", "b", "x", 0.9, [("p", -5.0), ("q", 1.0)]), (1, "Normal", "", "x", 0.5, []), (2, "PortScan", "a", None, 0.95, [("p", 3.0)])]
    df = spark.createDataFrame(rows, f"seq long, category string, src_ip string, dst_ip string, probability double, top_features {f}")
    summary = {r.category: r for r in report.category_overview(df).collect()}
    assert summary["PortScan"].src_ips == ["a", "b"] and abs(summary["PortScan"].mean_probability - 0.925) < 1e-12
    assert [(r.feature, r.total) for r in report.feature_rank(df).orderBy("rank").collect()] == [("p", 8.0), ("q", 1.0)]
    assert report.filter_categories(df, ["Normal"]).count() == 1 and report.filter_categories(df, None).count() == 3


def test_cleaning(spark):
    df = spark.createDataFrame([(1.0, 5.0, "x"), (float("inf"), 5.0, "Infinity"), (3.0, 5.0, None), (None, 5.0, "y")], "a double, b double, t string")
    assert [r.a for r in clean.impute_median(df, ["a"]).collect()] == [1.0, 2.0, 3.0, 2.0]
    assert clean.constant_columns(df) == ["b"] and clean.columns_containing(df, "Infinity") == ["t"]
    names = spark.createDataFrame([(x,) for x in ["Web Attack - XSS", "FTP-Patator", "  benign ", "DoS slowloris", "infiltration", None]], "c string")
    assert [r[0] for r in names.select(clean.hyphens(clean.label_cicids(F.col("c")))).collect()] == ["Web Attack – Xss", "BruteForce", "Normal", "DoS", "Infiltration", "Normal"]
    paths = spark.createDataFrame([("/d/Mirai_1.csv",), ("/d/os_scan.csv",), ("/d/new-thing.csv",)], "p string")
    assert [r[0] for r in paths.select(clean.label_from_path(F.col("p"))).collect()] == ["DDoS", "Reconnaissance", "New Thing"]


def test_quotas_and_synthesis(spark):
    df = spark.range(600).select("id", F.when(F.col("id") % 2 == 0, "Normal").otherwise("DoS").alias("attack_cat"), (F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 50 * 2).cast("double").alias("y"))
    quotas = sample.Quotas(train_total=120, train_normal=100, train_attack=40)
    counts = {r.attack_cat: r["count"] for r in sample.stratified_quota(df, "attack_cat", "id", quotas).groupBy("attack_cat").count().collect()}
    assert sum(counts.values()) == 120 and counts["DoS"] <= 40
    copula = synth.fit(df, ["x", "y"])
    rows = synth.by_quota(spark, {"": copula}, {"Normal": 20, "DoS": 10})
    assert {(r.attack_cat, r.label): r["count"] for r in rows.groupBy("attack_cat", "label").count().collect()} == {("Normal", 0): 20, ("DoS", 1): 10}
    assert synth.sample(spark, copula, 2500).agg(F.corr("x", "y")).first()[0] > 0.9


def test_every_vector_and_component_is_trained_on_and_scored(spark, tmp_path, monkeypatch):
    from tracelake.plans.catalog import QUERIES

    rng = np.random.default_rng(5)
    # only the last of eight components tells the ten labels apart; two vectors lack a label or components
    rows = [(i, [*rng.normal(0, 1, 7).tolist(), 10.0 * (i % 10)], i % 10) for i in range(200)] + [(200, [0.0] * 7 + [50.0], None), (201, [1.0], 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    trained = []
    train = model.train
    monkeypatch.setattr(model, "train", lambda rows, features, *a, **k: trained.append((rows.count(), features)) or train(rows, features, *a, **k))
    found = {r.vec_id: r for r in QUERIES["m6_m9_train_and_score"](spark, str(tmp_path)).collect()}
    assert trained == [(201, [f"x{i}" for i in range(8)])]
    assert found.keys() == set(range(202)) and {r.attack_cat for r in found.values()} == {f"c{k}" for k in range(10)}
    assert sum(found[i].attack_cat == f"c{i % 10}" for i in range(200)) > 180


def test_every_file_of_the_evidence_is_hashed(spark, tmp_path):
    import hashlib

    folder = tmp_path / "some evidence"
    folder.mkdir()
    for name, text in (("a.csv", "x,y\n1,2\n"), ("b.csv", "x,y\n3,4\n"), ("c%20d.csv", "x,y\n5,6\n")):
        (folder / name).write_text(text)
    one = custody.file_digest(spark, f"{folder}/a.csv")
    assert one == hashlib.sha256(b"x,y\n1,2\n").hexdigest()
    whole, glob = custody.file_digest(spark, str(folder)), custody.file_digest(spark, f"{folder}/*.csv")
    assert whole == glob != one
    for name in ("a.csv", "b.csv", "c%20d.csv"):
        held = (folder / name).read_text()
        (folder / name).write_text(held.replace("x", "z"))
        assert custody.file_digest(spark, str(folder)) != whole
        (folder / name).write_text(held)
    assert custody.file_digest(spark, str(folder)) == whole
    (folder / "b.csv").rename(folder / "e.csv")
    assert custody.file_digest(spark, str(folder)) != whole


def test_a_link_has_one_writer(spark, tmp_path):
    one = custody.CustodyChain(spark, str(tmp_path / "chain"))
    other = custody.CustodyChain(spark, str(tmp_path / "chain"))
    one.append("a", "x", "t", None, "1")
    assert other._claimed("a", 2)
    with pytest.raises(custody.CustodyConflict, match="link 2"):
        one.append("a", "y", "t", "1", "2")
    assert one.verify("a")["total_records"] == 1 and one.append("b", "x", "t", None, "1").idx == 1


def test_manifests_are_read_as_they_are_written(spark, trained, tmp_path):
    from tracelake.sources.files import read_manifests

    with pytest.raises(FileNotFoundError):
        read_manifests(spark, str(tmp_path))
    for version in ("v2", "v1"):
        model.certify(spark, trained, str(tmp_path), version)
    found = read_manifests(spark, str(tmp_path)).collect()
    assert [r.version for r in found] == ["v1", "v2"] and found[0].feature_names == FEATURES


def test_digest_of_numbers_with_wide_gaps(spark):
    """Numbers as monotonically_increasing_id gives them: the driver gets few hashes however many partitions there are."""
    df = spark.range(500).select(((F.col("id") % 100) * (1 << 33) + F.col("id")).alias("seq"), F.col("id").alias("v"))
    one = custody.table_digest(df)
    assert one[1] == 500 and custody.table_digest(df.repartition(5)) == one
    assert custody.table_digest(df.withColumn("v", F.col("v") + 1))[0] != one[0]


def test_exact_quantiles(spark):
    from tracelake.operators import quantiles as q

    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(0, 5, 4000), np.full(3000, 2.0), [1e9, -1e9]])
    rng.shuffle(values)
    df = spark.createDataFrame([(float(v), "a" if k % 3 else "b") for k, v in enumerate(values)] + [(None, "a"), (None, "c")], "v double, g string")
    wanted = {str(s): (F.col("v"), s) for s in (0.0, 0.001, 0.25, 0.5, 0.6, 0.999, 1.0)}
    found = q.quantiles(df, wanted)
    assert all(abs(found[k] - np.quantile(values, s)) < 1e-9 for k, (_, s) in wanted.items())
    assert q.quantiles(df.where("g = 'c'"), {"x": (F.col("v"), 0.5)}) == {"x": None}
    groups = {r.g: r.m for r in q.group_quantiles(df, "g", {"m": (F.col("v"), 0.5)}).collect()}
    for g in "ab":
        assert abs(groups[g] - np.median([v for k, v in enumerate(values) if ("a" if k % 3 else "b") == g])) < 1e-9
    assert groups["c"] is None


def test_quantiles_that_need_narrowing(spark, monkeypatch):
    from tracelake.operators import quantiles as q

    monkeypatch.setattr(q, "ACCURACY", 40)
    monkeypatch.setattr(q, "INSIDE", 450)
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("double").alias("v"))
    found = q.quantiles(df, {"m": (F.col("v"), 0.5), "low": (F.col("v"), 0.01)})
    assert found == {"m": 9999.5, "low": pytest.approx(199.99)}


def test_overview_of_addresses(spark):
    rows = [(k, "DoS", f"10.0.0.{k % 12:02d}", "", 0.5) for k in range(40)] + [(99, "Normal", None, "x", 1.0)]
    df = spark.createDataFrame(rows, "seq long, category string, src_ip string, dst_ip string, probability double")
    found = {r.category: r for r in report.category_overview(df).collect()}
    assert found["DoS"].n_src_ips == 12 and found["DoS"].src_ips == [f"10.0.0.{k:02d}" for k in range(5)] and found["DoS"].dst_ips == []
    assert found["Normal"].n_src_ips == 0 and found["Normal"].n_dst_ips == 1
    blocks = report.case_blocks(df).collect()
    assert [b.category for b in blocks] == ["DoS"] and blocks[0].meaning == report.MEANINGS["DoS"] and blocks[0].advice is None


def test_overview_of_all_addresses(spark):
    """Without a number every address of a category is there, once and in order."""
    rows = [(k, "DoS", f"10.0.0.{k * 7 % 12:02d}", "" if k % 2 else f"d{k % 8}", 0.5) for k in range(40)] + [(99, "Normal", None, "x", 1.0)]
    df = spark.createDataFrame(rows, "seq long, category string, src_ip string, dst_ip string, probability double")
    found = {r.category: r for r in report.category_overview(df, None).collect()}
    assert found["DoS"].src_ips == [f"10.0.0.{k:02d}" for k in range(12)] and found["DoS"].dst_ips == ["d0", "d2", "d4", "d6"]
    assert found["Normal"].src_ips == [] and found["Normal"].dst_ips == ["x"]
