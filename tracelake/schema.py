"""Event schemas and the fixed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The closed taxonomy of attack categories.
CATEGORIES = (
    "Analysis", "Backdoors", "Bot", "BruteForce", "DDoS", "DoS", "Exploits", "Fuzzers", "Generic", "Heartbleed",
    "Infiltration", "MitM", "Normal", "PortScan", "Reconnaissance", "Shellcode", "Web Attack – Sql Injection",
    "Web Attack – Xss", "Worms",
)

# The smaller taxonomy of the scenario table.
SCENARIO_CATEGORIES = (
    "Analysis", "Backdoors", "BruteForce", "DDoS", "DoS", "Exploits", "Fuzzers", "Generic", "MitM", "Normal",
    "PortScan", "Reconnaissance", "Shellcode",
)

# Categories that mean ordinary traffic.
NORMAL = ("Normal", "Tráfico normal")

# Columns of each flow CSV dialect, by event field.
DIALECTS = {
    "cicids2017": {
        "protocol_raw": "protocol",
        "duration": "flow_duration",
        "packets_out": "total_fwd_packets",
        "packets_in": "total_backward_packets",
        "bytes_out": "total_length_of_fwd_packets",
        "bytes_in": "total_length_of_bwd_packets",
    },
    "unsw_nb15": {
        "protocol_raw": "proto",
        "duration": "dur",
        "packets_out": "spkts",
        "packets_in": "dpkts",
        "bytes_out": "sbytes",
        "bytes_in": "dbytes",
    },
    "kitsune": {},
    "generic_flow_csv": {},
}

# Features that are absolute times and would leak the capture session.
TIME_FEATURES = ("first_seen", "ltime", "stime", "time", "timestamp")

# Severities of alerts and of CEF names, as event severities.
EVE_SEVERITY = {0: 1, 1: 5, 2: 4, 3: 3}
CEF_SEVERITY = {"low": 2, "medium": 3, "high": 5, "very-high": 6, "unknown": 1}

TRAFFIC = ("packets_out", "packets_in", "bytes_out", "bytes_in")



def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()
EVENT_TYPE = _struct(
    seq=_L,
    class_uid=_I,
    category_uid=_I,
    activity_id=_I,
    severity_id=_I,
    time=_S,
    event_us=_L,
    src_endpoint=_struct(ip=_S, port=_S),
    dst_endpoint=_struct(ip=_S, port=_S),
    connection_info=_struct(protocol_raw=_S, duration=_D),
    traffic=_struct(packets_out=_D, packets_in=_D, bytes_out=_D, bytes_in=_D),
    finding_info=_struct(title=_S, uid=_S, types=T.ArrayType(_S)),
    metadata=_struct(product=_struct(name=_S, vendor_name=_S), version=_S),
    unmapped=_struct(
        source_dataset=_S,
        attack_cat=_S,
        label=_I,
        first_seen=_S,
        raw_flow_features=T.MapType(_S, _D),
        raw_text_fields=T.MapType(_S, _S),
        raw_event=_S,
        flow_id=_S,
        action=_S,
        gid=_S,
        rev=_S,
        syslog_prefix=_S,
        cef_version=_S,
        device_version=_S,
    ),
)
EVENT_VERSION = "1.4.0"
