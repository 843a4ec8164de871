"""Raw records of each kind of evidence to one event schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tracelake import schema
from tracelake.functions.scalars import cef_severity, eve_severity, event_time, missing, number, syslog_time

_HEADER = r"(?<!\\)\|"
_PAIR = r"(\w+)=(.*?)(?=(?: \w+=)|$)"


def taxonomy(c: Column) -> Column:
    """The trimmed category; an error if it is outside the closed taxonomy."""
    name = F.trim(c)
    problem = F.concat(F.lit("attack_cat outside the taxonomy: "), F.coalesce(name, F.lit("null")))
    return F.when(name.isin(*schema.CATEGORIES), name).otherwise(F.raise_error(problem).cast("string"))


def _event(**fields: Column) -> list[Column]:
    """All columns of the event schema; those not given are null."""
    return [fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.EVENT_TYPE]


def _struct(name: str, **given: Column) -> Column:
    kind = schema.EVENT_TYPE[name].dataType
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])


def _product(name: Column, vendor: Column | None = None) -> Column:
    return F.struct(F.struct(name.alias("name"), (F.lit(None).cast("string") if vendor is None else vendor).alias("vendor_name")).alias("product"), F.lit(schema.EVENT_VERSION).alias("version"))


def flow_events(df: DataFrame, dialect: str, *, require_label: bool = True, seq: str = "seq") -> DataFrame:
    """Flow CSV rows (all text, snake case) as network activity events.

    Known columns of the dialect go to connection and traffic; the others that are numbers to
    ``raw_flow_features`` and the rest to ``raw_text_fields``. A category must be in the taxonomy. An
    attack has severity 3, anything else 1. Raises KeyError without category or label where these are required.
    """
    if dialect not in schema.DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}; known: {', '.join(sorted(schema.DIALECTS))}")
    known = schema.DIALECTS[dialect]
    labeled = "attack_cat" in df.columns
    if require_label:
        for column in ("attack_cat", "label"):
            if column not in df.columns:
                raise KeyError(column)
    own = {*known.values(), "attack_cat", "label", seq}
    others = [c for c in df.columns if c not in own]

    def column(field: str) -> Column:
        return F.col(f"`{known[field]}`") if field in known and known[field] in df.columns else F.lit(None).cast("string")

    def value(field: str) -> Column:
        return F.when(~missing(column(field)), number(column(field), None))

    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in others]).cast("array<string>"), F.array(*[F.col(f"`{c}`").cast("string") for c in others]).cast("array<string>"))
    numbers = F.transform_values(F.map_filter(pairs, lambda _, v: v.try_cast("double").isNotNull()), lambda _, v: v.cast("double"))
    category = taxonomy(F.col("attack_cat")) if labeled else F.lit(None).cast("string")
    return df.select(
        *_event(
            seq=F.col(seq),
            class_uid=F.lit(4001),
            category_uid=F.lit(4),
            activity_id=F.lit(6),
            severity_id=F.when(category != "Normal", 3).otherwise(1),
            connection_info=F.struct(column("protocol_raw").cast("string").alias("protocol_raw"), value("duration").alias("duration")),
            traffic=F.struct(*[value(f).alias(f) for f in schema.TRAFFIC]),
            metadata=_product(F.lit(dialect)),
            unmapped=_struct(
                "unmapped",
                source_dataset=F.lit(dialect),
                attack_cat=category,
                label=F.col("label").try_cast("int") if labeled and "label" in df.columns else F.lit(None),
                raw_flow_features=numbers,
                raw_text_fields=F.map_filter(pairs, lambda _, v: v.isNotNull() & v.try_cast("double").isNull()),
            ),
        )
    )


def eve_events(df: DataFrame, *, raw: str = "raw", seq: str = "seq") -> DataFrame:
    """Alerts among IDS records (a VARIANT column) as detection findings; other records are left out. The whole record stays as JSON text."""

    def get(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(F.col(raw), f"$.{path}", kind)

    category = F.nullif(get("alert.category"), F.lit(""))
    return df.where(get("event_type") == "alert").select(
        *_event(
            seq=F.col(seq),
            class_uid=F.lit(2004),
            category_uid=F.lit(2),
            activity_id=F.lit(1),
            severity_id=eve_severity(get("alert.severity")),
            time=get("timestamp"),
            event_us=event_time(get("timestamp")),
            src_endpoint=F.struct(get("src_ip").alias("ip"), get("src_port").alias("port")),
            dst_endpoint=F.struct(get("dest_ip").alias("ip"), get("dest_port").alias("port")),
            connection_info=F.struct(get("proto").alias("protocol_raw"), F.lit(None).cast("double").alias("duration")),
            traffic=F.struct(*[get(f"flow.{p}", "double").alias(f) for f, p in zip(schema.TRAFFIC, ("pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient"))]),
            finding_info=F.struct(get("alert.signature").alias("title"), get("alert.signature_id").alias("uid"), F.when(category.isNull(), F.array().cast("array<string>")).otherwise(F.array(category)).alias("types")),
            metadata=_product(F.lit("Suricata"), F.lit("OISF")),
            unmapped=_struct(
                "unmapped", source_dataset=F.lit("suricata_eve"), raw_event=F.to_json(F.col(raw)), flow_id=get("flow_id"), action=get("alert.action"), gid=get("alert.gid"), rev=get("alert.rev")
            ),
        )
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, wherever the optimiser may move the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _extension(text: Column) -> Column:
    """Key and value pairs as a map; the last of equal keys wins. The text is matched once."""

    def mapped(pairs: Column) -> Column:
        def last_ones(keys: Column) -> Column:
            entries = F.transform(pairs, lambda p, i: F.struct(F.get(keys, i).alias("k"), F.trim(F.replace(F.substring(p, F.length(F.get(keys, i)) + 2, F.length(p)), F.lit("\\ "), F.lit(" "))).alias("v")))
            return F.map_from_entries(F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys) + 1), e.k)))

        return bound(F.transform(pairs, lambda p: F.substring_index(p, "=", 1)), last_ones)

    return bound(F.regexp_extract_all(text, F.lit(_PAIR), 0), mapped)


def parse_cef(line: Column) -> Column:
    """A struct of a CEF line's prefix, seven header fields and extension map (last of equal keys wins); null if it is none."""
    names = ("cef_version", "device_vendor", "device_product", "device_version", "signature_id", "name", "severity")
    at = F.locate("CEF:", line)

    def parsed(parts: Column) -> Column:
        head = [F.trim(F.replace(F.get(parts, F.lit(i)), F.lit("\\|"), F.lit("|"))).alias(n) for i, n in enumerate(names)]
        extension = _extension(F.coalesce(F.get(parts, F.lit(7)), F.lit("")))
        return F.when(F.size(parts) >= 7, F.struct(F.trim(F.substring(line, F.lit(1), at - 1)).alias("syslog_prefix"), *head, extension.alias("extension")))

    return F.when(at > 0, bound(F.split(F.substring(line, at + 4, F.length(line)), _HEADER, 8), parsed))


def cef_events(df: DataFrame, *, line: str = "raw_line", seq: str = "seq", reference_year: int | None = None) -> DataFrame:
    """CEF firewall lines as detection findings; lines that do not parse are left out. Byte counts stay text."""
    rows = df.select(F.col(seq), parse_cef(F.col(line)).alias("c")).where("c IS NOT NULL")
    ext = lambda k: F.try_element_at(F.col("c.extension"), F.lit(k))
    at = syslog_time(F.col("c.syslog_prefix"), None if reference_year is None else F.lit(reference_year))
    time = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")
    return rows.select(
        *_event(
            seq=F.col(seq),
            class_uid=F.lit(2004),
            category_uid=F.lit(2),
            activity_id=F.lit(1),
            severity_id=cef_severity(F.col("c.severity")),
            time=time,
            event_us=F.unix_micros(at),
            src_endpoint=F.struct(ext("src").alias("ip"), ext("spt").alias("port")),
            dst_endpoint=F.struct(ext("dst").alias("ip"), ext("dpt").alias("port")),
            connection_info=F.struct(ext("proto").alias("protocol_raw"), F.lit(None).cast("double").alias("duration")),
            finding_info=F.struct(F.col("c.name").alias("title"), F.col("c.signature_id").alias("uid"), F.when(ext("cat").isNull(), F.array().cast("array<string>")).otherwise(F.array(ext("cat"))).alias("types")),
            metadata=_product(F.col("c.device_product"), F.col("c.device_vendor")),
            unmapped=_struct(
                "unmapped", source_dataset=F.lit("firewall_cef"), raw_text_fields=F.col("c.extension"), syslog_prefix=F.col("c.syslog_prefix"), cef_version=F.col("c.cef_version"), device_version=F.col("c.device_version")
            ),
        )
    )


def packet_flow_events(flows: DataFrame, *, keep_ports: bool = False) -> DataFrame:
    """Flows from packets as network activity, numbered in order; without ``keep_ports`` the target's port is left out."""
    port = F.col("dst_port").cast("string") if keep_ports else F.lit(None).cast("string")
    # numbers in the order of capture, key and flow, without gaps but between tasks
    seq = F.monotonically_increasing_id()
    return flows.orderBy("seq.path", "seq.key", "seq.flow_no", "src_ip", "src_port").select(
        *_event(
            seq=seq,
            class_uid=F.lit(4001),
            category_uid=F.lit(4),
            activity_id=F.lit(6),
            severity_id=F.lit(1),
            event_us=event_time(F.col("first_seen")),
            src_endpoint=F.struct(F.col("src_ip").alias("ip"), F.col("src_port").cast("string").alias("port")),
            dst_endpoint=F.struct(F.col("dst_ip").alias("ip"), port.alias("port")),
            connection_info=F.struct(F.col("protocol").alias("protocol_raw"), F.col("duration").alias("duration")),
            traffic=F.struct(*[F.col(f).cast("double").alias(f) for f in schema.TRAFFIC]),
            metadata=_product(F.lit("packet flow aggregator")),
            unmapped=_struct("unmapped", source_dataset=F.lit("pcap"), first_seen=F.col("first_seen")),
        )
    )
