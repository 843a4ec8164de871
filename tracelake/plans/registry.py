"""Kinds of evidence that a case can be run on; others can be registered at run time.

A handler tells how files of its kind are read, how their records become events, by which names and beginnings they are
known, and under which names its steps enter the chain of custody.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tracelake.operators import normalize
from tracelake.operators.flows import packet_flows
from tracelake.sources import files
from tracelake.sources.pcap import read_packets


@dataclass(frozen=True)
class Handler:
    """One kind of evidence.

    read: (spark, path, **options) to raw records with ``seq``. events: raw records to the event schema. extensions: endings of
    file names, without a dot. begins: whether a file is of this kind, from its first four bytes and first five lines. component: what
    made the raw records and the events, as the chain of custody names it. detail: what a result is called, from the raw records
    (the kind's name if not given). labeled: whether raw records carry labels.
    """

    kind: str
    read: Callable[..., DataFrame]
    events: Callable[[DataFrame], DataFrame]
    component: str
    extensions: tuple[str, ...] = ()
    begins: Callable[[bytes, list[str]], bool] = lambda head, lines: False
    detail: Callable[[DataFrame], str] | None = None
    labeled: Callable[[DataFrame], bool] = lambda raw: False


@dataclass
class Registry:
    """Handlers by kind, and the names of sources that users give. Later ones are asked first what a file is."""

    handlers: dict[str, Handler] = field(default_factory=dict)
    sources: dict[str, str | None] = field(default_factory=lambda: {"auto": None})

    def register(self, handler: Handler, *sources: str) -> None:
        """Adds a handler, in the place of one of its kind, under further names; ValueError for one that is another's."""
        for name in (handler.kind, *sources):
            if self.sources.get(name, handler.kind) != handler.kind:
                raise ValueError(f"{name!r} is the name of another source")
        self.handlers[handler.kind] = handler
        self.sources |= dict.fromkeys((handler.kind, *sources), handler.kind)

    def unregister(self, kind: str) -> None:
        self.handlers.pop(kind, None)
        self.sources = {name: k for name, k in self.sources.items() if k != kind}

    def kind_of(self, source: str) -> str | None:
        """The kind behind a name, None where the file has to tell; ValueError lists the names otherwise."""
        if source not in self.sources:
            raise ValueError(f"unknown source {source!r}; known: {', '.join(sorted(self.sources))}")
        return self.sources[source]

    def sniff(self, spark: SparkSession, path: str) -> str:
        """The kind of a file: by its ending, else by its beginning."""
        ending = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
        asked = list(reversed(self.handlers.values()))
        for handler in asked:
            if ending in handler.extensions:
                return handler.kind
        beginning = None
        for handler in asked:
            if handler.kind not in BUILT_IN:
                beginning = beginning or files.beginning(spark, path)
                if handler.begins(*beginning):
                    return handler.kind
        return files.sniff_type(spark, path)

    def handler(self, kind: str) -> Handler:
        if kind not in self.handlers:
            raise ValueError(f"unknown kind of evidence {kind!r}")
        return self.handlers[kind]


def _flows(raw: DataFrame) -> DataFrame:
    return normalize.flow_events(raw, files.sniff_dialect(raw.columns), require_label=_has_labels(raw))


def _has_labels(raw: DataFrame) -> bool:
    return "attack_cat" in raw.columns and "label" in raw.columns


def _flow_detail(raw: DataFrame) -> str:
    return "csv_labeled" if _has_labels(raw) else f"csv_unlabeled:{files.sniff_dialect(raw.columns)}"


def _packets(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_packets(spark, path, **options).withColumnRenamed("ordinal", "seq")


def _packet_events(raw: DataFrame) -> DataFrame:
    return normalize.packet_flow_events(packet_flows(raw.withColumnRenamed("seq", "ordinal")))


def _cef(spark: SparkSession, path: str, *, reference_year: int | None = None, **options) -> DataFrame:
    raw = files.read_text_lines(spark, path, **options)
    return raw if reference_year is None else raw.withMetadata("raw_line", {"reference_year": reference_year})


def _cef_events(raw: DataFrame) -> DataFrame:
    return normalize.cef_events(raw, reference_year=raw.schema["raw_line"].metadata.get("reference_year"))


BUILT_IN = ("csv", "jsonl", "cef_text", "pcap")


def default_registry() -> Registry:
    """Flow CSV, alerts, firewall lines and captures."""
    out = Registry()
    out.register(Handler("csv", files.read_flow_csv, _flows, "flow_csv_reader", ("csv",), detail=_flow_detail, labeled=_has_labels), "flow_csv")
    out.register(Handler("jsonl", files.read_jsonl, normalize.eve_events, "eve_alert_reader", ("json", "jsonl", "ndjson"), detail=lambda raw: "suricata_eve"), "suricata_eve")
    out.register(Handler("cef_text", _cef, _cef_events, "cef_line_reader", detail=lambda raw: "firewall_cef"), "firewall_cef")
    out.register(Handler("pcap", _packets, _packet_events, "capture_reader", ("pcap", "pcapng", "cap")))
    return out


#: The handlers that cases use where they are given no registry of their own.
REGISTRY = default_registry()
