"""A kind of evidence that is registered at run time, and evidence as data sources."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import custody, model, normalize
from tracelake.plans.case import normalize_any, run_case
from tracelake.plans.registry import Handler, default_registry
from tracelake.sources import files, formats


def test_a_case_on_a_fourth_kind(spark, tmp_path):
    """Tab-separated lines of a sensor of one's own: read, sniffed, normalised, scored, and named in the chain."""

    def read(spark, path, **options):
        parts = F.split("raw_line", "\t")
        return files.read_text_lines(spark, path).select("seq", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("tag", "when", "host", "peer", "port"))])

    def events(raw):
        alert = F.struct(F.struct(F.col("tag").alias("signature"), F.lit(1).alias("severity")).alias("alert"), F.lit("alert").alias("event_type"), F.col("when").alias("timestamp"), F.col("host").alias("src_ip"), F.col("peer").alias("dest_ip"), F.col("port").alias("dest_port"))
        return normalize.eve_events(raw.select("seq", F.parse_json(F.to_json(alert)).alias("raw")))

    registry = default_registry()
    registry.register(Handler("sensor", read, events, "sensor_reader_2", begins=lambda head, lines: bool(lines) and lines[0].startswith("SENSOR\t")), "my_sensor")
    path = tmp_path / "x.dat"
    path.write_text("".join(f"SENSOR\t2026-01-05T10:00:0{i}Z\t1.1.1.1\t2.2.2.2\t{i}\n" for i in range(6)))
    assert registry.sniff(spark, str(path)) == "sensor" and registry.kind_of("my_sensor") == "sensor"
    found = normalize_any(spark, str(path), registry=registry)
    assert found.kind == "sensor" and found.events.count() == 6 and not found.labeled
    df = spark.createDataFrame([(i, "Normal" if i % 2 else "DoS", float(i % 2), 1.0) for i in range(40)], "id long, c string, agg_events_in_window double, x double")
    model.certify(spark, model.train(df, ["agg_events_in_window", "x"], "c", "id", trees=3, depth=2), str(tmp_path), "v1")
    chain = custody.CustodyChain(spark, str(tmp_path / "chain"))
    for source in ("my_sensor", "sensor", "auto"):
        case = run_case(spark, source, source, str(path), model.FrozenClassifier(spark, str(tmp_path), "v1"), chain, registry=registry)
        assert case.verification["valid"] and case.findings.count() == 6
    components = [r.component for r in chain.chain("auto").orderBy("idx").collect()]
    assert components[:2] == ["ingest:sensor:sensor_reader_2", "normalize:sensor:sensor_reader_2"]
    with pytest.raises(ValueError, match="another source"):
        registry.register(Handler("other", read, events, "x"), "my_sensor")
    registry.unregister("sensor")
    with pytest.raises(ValueError, match="unknown source"):
        run_case(spark, "c", "my_sensor", str(path), None, chain, registry=registry)
    assert "sensor" not in default_registry().handlers


def test_registered_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\ny\n")
    files.register_reader("plain", lambda spark, path: files.read_text_lines(spark, path))
    try:
        assert files.read_source(spark, "plain", str(tmp_path / "a.txt")).count() == 2
    finally:
        files.READERS.pop("plain")


def test_lines_of_any_ranges(tmp_path):
    rng = random.Random(1)
    content = b"".join(rng.choice([b"a", b"bc", b"\n", b"\r\n", b"\n\n"]) for _ in range(300))
    for text in (content, content + b"\n", b"", b"\n", b"x" * 50):
        (tmp_path / "x").write_bytes(text)
        want = text.split(b"\n")
        want = [x.removesuffix(b"\r") for x in (want[:-1] if want[-1] == b"" else want)]
        for size in (1, 2, 7, 1000):
            found = [x for low in range(0, len(text), size) for x in formats.lines_of(formats.FileRange(str(tmp_path / "x"), low, min(low + size, len(text))))]
            assert [x for _, x in found] == want and all(text[at : at + len(x)] == x for at, x in found)


def test_formats(spark, tmp_path):
    formats.register(spark)
    alerts = [{"event_type": "alert", "src_ip": f"1.1.1.{i}", "alert": {"severity": 1 + i % 3}} for i in range(50)]
    (tmp_path / "eve.json").write_text("\n".join(map(json.dumps, alerts)) + "\n\n")
    read = spark.read.format("eve").option("rangeBytes", 100).load(str(tmp_path / "eve.json"))
    assert [json.loads(r.raw) for r in read.orderBy("seq").collect()] == alerts
    events = normalize.eve_events(read.withColumn("raw", F.parse_json("raw")))
    assert events.count() == 50 and events.where("src_endpoint.ip = '1.1.1.7'").first().severity_id == 4
    (tmp_path / "fw.log").write_text("CEF:0|v|p|1|7|name|5|src=1.1.1.1\n\nCEF:0|v|p|1|7|name|9|src=1.1.1.2\n")
    assert [e.severity_id for e in normalize.cef_events(spark.read.format("cef").load(str(tmp_path / "fw.log"))).orderBy("seq").collect()] == [3, 6]
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv/1.csv").write_text("﻿Proto,Flow Duration\ntcp,1\n\"u,dp\",\n")
    (tmp_path / "csv/2.csv").write_text("Flow Duration,Extra-Col\r\n3,x\r\n")
    flows = spark.read.format("flow_csv").load(str(tmp_path / "csv"))
    assert flows.columns == ["path", "seq", "proto", "flow_duration", "extra_col"]
    assert sorted(str(tuple(r)[2:]) for r in flows.collect()) == sorted(map(str, [("tcp", "1", None), ("u,dp", None, None), (None, "3", "x")]))
