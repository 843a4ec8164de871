"""Readers, sniffing and normalisation, on files written here."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from tracelake.operators import normalize
from tracelake.operators.flows import packet_flows
from tracelake.operators.matrix import aggregate_events, feature_matrix, feature_names
from tracelake.plans.case import normalize_any
from tracelake.sources import files
from tracelake.sources.pcap import read_packets

HEAD = "attack_cat,label,Destination Port,Protocol,Flow Duration,Total Fwd Packets,Total Backward Packets\n"


@pytest.fixture
def write(tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(path)

    return put


def test_clean_csv(spark, write):
    path = write("a.csv", HEAD + "Normal,0,80,6,100,2,3\nPortScan,1,22,6,,1,0\n")
    df = files.read_clean_csv(spark, path)
    assert df.columns[1:5] == ["attack_cat", "label", "destination_port", "protocol"]
    events = normalize.flow_events(df, files.sniff_dialect(df.columns)).orderBy("seq").collect()
    assert [e.severity_id for e in events] == [1, 3]
    assert events[0].connection_info.duration == 100.0 and events[1].connection_info.duration is None
    assert events[0].unmapped.raw_flow_features == {"destination_port": 80.0}
    with pytest.raises(ValueError, match="attack_cat"):
        files.read_clean_csv(spark, write("b.csv", "x,y\n1,2\n"))


def test_categories_outside_the_taxonomy_are_errors(spark, write):
    df = files.read_clean_csv(spark, write("a.csv", HEAD + "Nonsense,1,80,6,100,2,3\n"))
    with pytest.raises(Exception, match="outside the taxonomy"):
        normalize.flow_events(df, "cicids2017").collect()
    with pytest.raises(KeyError):
        normalize.flow_events(df.drop("attack_cat"), "cicids2017")
    with pytest.raises(ValueError, match="unknown dialect"):
        normalize.flow_events(df, "nothing")


def test_jsonl_and_alerts(spark, write):
    alert = {"timestamp": "2026-01-05T10:00:00.000000+0000", "event_type": "alert", "src_ip": "1.1.1.1", "src_port": 5, "dest_ip": "2.2.2.2", "dest_port": 80, "proto": "TCP", "alert": {"signature": "s", "severity": 2, "category": "scan"}, "flow": {"pkts_toserver": 3}}
    path = write("a.json", "﻿" + json.dumps(alert) + "\n\n" + json.dumps({"event_type": "flow"}) + "\n")
    raw = files.read_jsonl(spark, path)
    assert raw.count() == 2
    event = normalize.eve_events(raw).first()
    assert (event.severity_id, event.dst_endpoint.port, event.traffic.packets_out, event.finding_info.types) == (4, "80", 3.0, ["scan"])
    assert event.event_us == 1767607200000000
    with pytest.raises(ValueError, match="Línea 2"):
        files.read_jsonl(spark, write("b.json", "{}\nnot json\n{}\n"))


LINE = "<134>Aug  6 2026 10:00:00 fw CEF:0|Ven\\|dor|Prod|1.0|100|Drop it|%s|src=10.0.0.1 dst=10.0.0.2 spt=1 spt=2 dpt=443 proto=TCP cat=net msg=two words here"


def test_cef_lines(spark, write):
    path = write("fw.log", LINE % "8" + "\nnot a line\n\nCEF:0|too|few\n" + LINE % "Low" + "\n")
    events = normalize.cef_events(files.read_text_lines(spark, path)).orderBy("seq").collect()
    assert [e.severity_id for e in events] == [5, 2]
    e = events[0]
    assert (e.src_endpoint.port, e.dst_endpoint.port, e.metadata.product.vendor_name) == ("2", "443", "Ven|dor")
    assert e.unmapped.raw_text_fields["msg"] == "two words here" and e.time.startswith("2026-08-06T10:00:00")


def test_yearless_times_take_the_reference_year(spark, write):
    path = write("fw.log", (LINE % "3").replace(" 2026", ""))
    assert normalize.cef_events(files.read_text_lines(spark, path), reference_year=2020).first().time.startswith("2020-08-06")


def test_sniffing(spark, write):
    assert files.sniff_type(spark, write("a.csv", "")) == "csv"
    assert files.sniff_type(spark, write("x.log", LINE % "1")) == "cef_text"
    assert files.sniff_type(spark, write("y.log", '{"a": 1}\n')) == "jsonl"
    assert files.sniff_type(spark, write("z.bin", b"\xd4\xc3\xb2\xa1" + b"\0" * 20)) == "pcap"
    with pytest.raises(ValueError):
        files.sniff_type(spark, write("q.dat", b"\0\1\2\3"))
    assert files.sniff_dialect(["proto", "dur", "x"]) == "unsw_nb15"
    assert files.sniff_dialect(["a", "b", "c"]) == "generic_flow_csv"
    with pytest.raises(ValueError, match="known"):
        files.read_source(spark, "nothing", "x")


def packet(src, sport, dst, dport, proto=6):
    ip = bytes([0x45, 0, 0, 40, 0, 0, 0, 0, 64, proto, 0, 0]) + bytes(map(int, src.split("."))) + bytes(map(int, dst.split(".")))
    return b"\0" * 12 + b"\x08\0" + ip + struct.pack("!HH", sport, dport) + b"\0" * 16


def capture(packets):
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for ts, frame in packets:
        out += struct.pack("<IIII", int(ts), round(ts % 1 * 1e6), len(frame), len(frame)) + frame
    return out


def test_packets_become_flows(spark, write):
    a, b = ("10.0.0.1", 1000, "10.0.0.2", 80), ("10.0.0.2", 80, "10.0.0.1", 1000)
    arp = b"\0" * 12 + b"\x08\x06" + b"\0" * 40
    path = write("x.pcap", capture([(1, packet(*a)), (1.5, packet(*b)), (121.5, packet(*a)), (241.500001, packet(*b)), (242, arp), (243, packet("10.0.0.9", 7, "10.0.0.2", 53, 17))]))
    raw = read_packets(spark, path)
    assert raw.count() == 6 and raw.where("protocol IS NULL").count() == 1
    flows = packet_flows(raw).orderBy("seq").collect()
    assert [(f.src_ip, f.packets_out, f.packets_in, f.protocol) for f in flows] == [("10.0.0.1", 2, 1, "TCP"), ("10.0.0.2", 1, 0, "TCP"), ("10.0.0.9", 1, 0, "UDP")]
    assert flows[0].duration == 120.5
    assert read_packets(spark, path, max_packets=2).count() == 2
    found = normalize_any(spark, path)
    assert found.kind == "pcap" and found.events.count() == 3


def test_features(spark, write):
    df = files.read_flow_csv(spark, write("a.csv", "src,time,sport,frac,Flow Duration,Total Fwd Packets\nx,1,5,inf,2,3\ny,2,,0.5,,\n"))
    events = aggregate_events(normalize.flow_events(df, files.sniff_dialect(df.columns), require_label=False))
    assert feature_names(events) == ["agg_distinct_dst_hosts", "agg_distinct_dst_ports", "agg_events_in_window", "agg_events_per_second", "duration", "frac", "packets_out", "sport"]
    rows = feature_matrix(events, ["sport", "frac", "absent", "duration"]).orderBy("seq").collect()
    assert [(r.sport, r.frac, r.absent, r.duration) for r in rows] == [(5.0, 0.0, 0.0, 2.0), (0.0, 0.5, 0.0, 0.0)]


def test_union_of_files_and_headerless(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.csv").write_text("x,y\n1,2\n")
    (tmp_path / "a" / "2.csv").write_text("y,z\n3,4\n")
    df = files.read_many_csv(spark, str(tmp_path / "a"))
    assert {(r.x, r.y, r.z) for r in df.collect()} == {("1", "2", None), (None, "3", "4")}
    assert files.read_headerless_csv(spark, str(tmp_path / "a" / "1.csv"), ["One", "Two"]).columns == ["seq", "one", "two"]
    with pytest.raises(ValueError):
        files.read_headerless_csv(spark, str(tmp_path / "a" / "1.csv"), ["one"])
    assert df.where(F.col("source_path").endswith("1.csv")).count() == 1


def test_sniffing_long_and_odd_lines(spark, write):
    long = json.dumps({"event_type": "alert", "payload": "A" * 300_000}) + "\n"
    assert files.sniff_type(spark, write("long.log", long * 3)) == "jsonl"
    assert files.sniff_type(spark, write("odd.log", "{not json, but values\n1,2\n")) == "csv"
    with pytest.raises(ValueError):
        files.sniff_type(spark, write("empty.dat", ""))


def test_several_captures_are_apart(spark, tmp_path):
    a, b = ("10.0.0.1", 1000, "10.0.0.2", 80), ("10.0.0.2", 80, "10.0.0.1", 1000)
    (tmp_path / "caps").mkdir()
    (tmp_path / "caps/1.pcap").write_bytes(capture([(1, packet(*a)), (2, packet(*b))]))
    (tmp_path / "caps/2.pcap").write_bytes(capture([(1000, packet(*a)), (1001, packet(*b))]))
    raw = read_packets(spark, str(tmp_path / "caps"))
    flows = packet_flows(raw).orderBy("seq").collect()
    assert [(f.duration, f.packets_out, f.packets_in, f.first_seen[14:19]) for f in flows] == [(1.0, 1, 1, "00:01"), (1.0, 1, 1, "16:40")]
    events = normalize.packet_flow_events(packet_flows(raw)).collect()
    assert len({e.seq for e in events}) == 2 and [e.event_us for e in sorted(events)] == [1_000_000, 1_000_000_000]


def test_encodings_and_provenance(spark, write):
    path = write("latin.csv", "name,x\nañb – €,1\n".encode("windows-1252"))
    assert files.read_csv_any_encoding(spark, path).first()["name"] == "añb – €"
    assert files.read_csv_any_encoding(spark, path, ("UTF-8", "ISO-8859-1")).first()["name"].startswith("añb")
    df = files.read_flow_csv(spark, path, encoding="windows-1252")
    one, two = files.provenance(spark, path, df).first(), files.provenance(spark, path, df.withColumn("x", F.lit("2"))).first()
    assert one.row_count == 1 and one.file_sha256 == two.file_sha256 and one.events_sha256 != two.events_sha256
