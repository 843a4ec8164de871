"""Readers for each kind of evidence file, all with a ``seq`` column that keeps the order."""

from __future__ import annotations

import csv
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracelake.functions.scalars import snake_case
from tracelake.schema import DIALECTS
from tracelake.sources.streams import listed

#: Bytes that are looked at, at most, to tell what a file is.
MOST = 16 << 20


#: Control characters that windows-1252 uses for other characters, and these.
_CONTROLS = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_LETTERS = _CONTROLS.encode("latin-1").decode("cp1252")


def _numbered(df: DataFrame) -> DataFrame:
    """Adds ``seq``: rises with the position in the file, not without gaps."""
    return df.select(F.monotonically_increasing_id().alias("seq"), "*")


def read_flow_csv(spark: SparkSession, path: str, *, limit: int | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header as text columns in snake case."""
    windows = encoding.lower() in ("windows-1252", "cp1252")
    raw = spark.read.csv(path, header=True, encoding="ISO-8859-1" if windows else encoding, multiLine=False)
    if windows:  # Spark does not know this encoding; it is the other one, with letters for some control characters
        raw = raw.select(*[F.translate(F.col(f"`{c}`"), _CONTROLS, _LETTERS).alias(c.translate(str.maketrans(_CONTROLS, _LETTERS))) for c in raw.columns])
    named = _numbered(raw.toDF(*[snake_case(c.lstrip("﻿")) for c in raw.columns]))
    return named.orderBy("seq").limit(limit) if limit is not None else named


def read_clean_csv(spark: SparkSession, path: str, *, limit: int | None = None) -> DataFrame:
    """The same for labeled files: ValueError names the label columns that are missing."""
    df = read_flow_csv(spark, path, limit=limit)
    lacking = [c for c in ("attack_cat", "label") if c not in df.columns]
    if lacking:
        raise ValueError(f"{path} lacks the columns {', '.join(lacking)}")
    return df


def read_csv_any_encoding(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("windows-1252", "ISO-8859-1", "UTF-8")) -> DataFrame:
    """The first encoding that leaves no replacement mark in any text; the last one otherwise."""
    for encoding in encodings:
        df = read_flow_csv(spark, path, encoding=encoding)
        marks = df.agg(F.bool_or(F.greatest(*[F.contains(F.coalesce(f"`{c}`", F.lit("")), F.lit("�")) for c in df.columns[1:]], F.lit(False)))).first()[0]
        if not marks:
            return df
    return df


def read_headerless_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A CSV whose column names come from elsewhere; a file with its own header of that width is accepted too."""
    df = spark.read.csv(path, header=False)
    if len(df.columns) != len(names):
        df = spark.read.csv(path, header=True)
        if len(df.columns) != len(names):
            raise ValueError(f"{path} has {len(df.columns)} columns, {len(names)} names are given")
    return _numbered(df.toDF(*[snake_case(n) for n in names]))


# What the types in dictionaries of features are called.
DICTIONARY_TYPES = {"nominal": "string", "integer": "bigint", "float": "double", "binary": "int", "timestamp": "bigint"}


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary of features (a CSV with columns like No., Name and Type) as no, name and type."""
    rows = read_csv_any_encoding(spark, path)
    given = {c.strip(" ._"): c for c in rows.columns}
    lacking = [c for c in ("no", "name", "type") if c not in given]
    if lacking:
        raise ValueError(f"{path} lacks the columns {', '.join(lacking)}")
    return rows.select(F.col(f"`{given['no']}`").try_cast("int").alias("no"), F.trim(f"`{given['name']}`").alias("name"), F.trim(f"`{given['type']}`").alias("type"))


def bind_dictionary(spark: SparkSession, path: str, dictionary: DataFrame) -> DataFrame:
    """Files without a header, with the names and types that a dictionary (no, name, type) gives their columns in order.

    Names become snake case; values that are not of their column's type become null. A file that begins with the
    dictionary's own names is read without that line. ValueError names the columns that the dictionary has too few or too many, for
    types it does not know, and for names given twice.
    """
    entries = dictionary.orderBy("no").collect()
    names, kinds = [snake_case(e.name) for e in entries], [DICTIONARY_TYPES.get((e.type or "").strip().lower()) for e in entries]
    unknown = [f"{n} ({e.type})" for n, e, k in zip(names, entries, kinds) if k is None]
    if unknown:
        raise ValueError(f"the dictionary has unknown types: {', '.join(unknown)}")
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"the dictionary names {', '.join(twice)} twice")
    raw = spark.read.csv(path, header=False)
    if len(raw.columns) > len(names):
        sample = raw.first()
        surplus = [f"column {i + 1} ({sample[i]!r})" for i in range(len(names), len(raw.columns))]
        raise ValueError(f"{path} has more columns than the dictionary: {', '.join(surplus)}")
    if len(raw.columns) < len(names):
        raise ValueError(f"{path} has no columns for {', '.join(names[len(raw.columns) :])}")
    rows = _numbered(raw.toDF(*[f"c{i}" for i in range(len(names))]))
    header = F.lit(True)
    for i, e in enumerate(entries):
        header = header & (F.lower(F.trim(f"c{i}")) == e.name.strip().lower())
    typed = [F.col(f"c{i}").try_cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds))]
    return rows.where(~F.coalesce(header, F.lit(False))).select("seq", *typed)


def _safe(names: list[str]) -> list[str]:
    """Names of a header as Spark's reader gives them: empty ones by their place, equal ones with it."""
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def headers(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[tuple[list[str], list[str]]]:
    """The distinct headers among the files below a folder, and the files of each; tasks read the headers."""
    files, opened = listed(spark, folder, pattern=pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with opened(name, content) as source:
                    text = b""
                    while b"\n" not in text and len(text) < MOST and (piece := source.read(1 << 16)):
                        text += piece
                line = text.partition(b"\n")[0].decode("utf-8", "replace").removeprefix("\ufeff").rstrip("\r")
                found.append(json.dumps(_safe(next(csv.reader([line]), []))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "header"])

    told = files.mapInArrow(run, "path string, header string")
    rows = told.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header").collect()
    return [(json.loads(r.header), list(r.paths)) for r in rows]


def read_many_csv(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """All files below a folder by column name, with ``source_path``; each file keeps its own header's order.

    One job reads the headers; the plan has one scan for each distinct header, however many files there are.
    """
    found = headers(spark, folder, pattern)
    if not found:
        raise FileNotFoundError(f"no {pattern} below {folder}")
    out = None
    for names, paths in found:
        kinds = ", ".join(f"c{i} string" for i in range(len(names)))
        rows = spark.read.schema(kinds).csv([_escaped(p) for p in paths], header=True).select("*", F.col("_metadata.file_path").alias("source_path")) if names else None
        if rows is not None:
            rows = rows.toDF(*[snake_case(n) for n in names], "source_path")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no {pattern} below {folder} has a header")
    return _numbered(out)


def _escaped(path: str) -> str:
    """A path whose characters stand for themselves where Spark expects a pattern."""
    return "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(spark.read.text(path)).select("seq", F.regexp_replace("value", "^﻿", "").alias("line"))


def read_jsonl(spark: SparkSession, path: str, *, max_lines: int | None = None) -> DataFrame:
    """JSON lines as VARIANT ``raw``. Blank lines are skipped but count for ``max_lines``; a malformed line is an error that names it."""
    lines = _lines(spark, path)
    if max_lines is not None:
        lines = lines.orderBy("seq").limit(max_lines)
    filled = lines.where(F.trim("line") != "").withColumn("raw", F.try_parse_json("line"))
    # one aggregate looks for the first bad line, and only then are the lines before it counted
    bad = filled.where("raw IS NULL").agg(F.min(F.struct("seq", F.left(F.col("line"), F.lit(120)).alias("line")))).first()[0]
    if bad:
        number = lines.where(F.col("seq") <= bad.seq).count()
        raise ValueError(f"{path}: Línea {number} is not JSON: {bad.line}")
    return filled.select("seq", "raw")


def read_text_lines(spark: SparkSession, path: str, *, max_lines: int | None = None) -> DataFrame:
    """Non-blank lines as they are, in ``raw_line``."""
    lines = _lines(spark, path)
    if max_lines is not None:
        lines = lines.orderBy("seq").limit(max_lines)
    return lines.where(F.trim("line") != "").select("seq", F.col("line").alias("raw_line"))


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests of models below a folder, by version, whether each is a file or a folder of text as ``certify`` writes it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").where(F.col("path").rlike(r"\.manifest\.json(/part-[^/]*)?$"))
    paths = [r[0] for r in files.orderBy("path").collect()]
    if not paths:
        raise FileNotFoundError(f"no manifest of a model below {folder}")
    return spark.read.json(paths, multiLine=True).orderBy("version")


# What file names and first bytes say about the kind.
EXTENSIONS = {"pcap": "pcap", "pcapng": "pcap", "cap": "pcap", "csv": "csv", "json": "jsonl", "jsonl": "jsonl", "ndjson": "jsonl"}
MAGIC = (b"\xd4\xc3\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\x0a\x0d\x0d\x0a", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d")


def beginning(spark: SparkSession, path: str) -> tuple[bytes, list[str]]:
    """The first four bytes of the evidence and its first five lines, of 16 MB at most; read by one task."""
    files, opened = listed(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with opened(name, content) as source:
                    text = source.read(4)
                    while text.count(b"\n") < 5 and len(text) < MOST and (piece := source.read(1 << 16)):
                        text += piece
                yield pa.RecordBatch.from_arrays([pa.array([text], pa.binary())], names=["text"])

    first = files.orderBy("path").limit(1).mapInArrow(run, "text binary").first()
    text = bytes(first.text) if first else b""
    return text[:4], text.decode("utf-8", "replace").lstrip("\ufeff").splitlines()[:5]


def sniff_type(spark: SparkSession, path: str) -> str:
    """csv, jsonl, cef_text or pcap, by extension, the first lines or the first bytes; ValueError for anything else."""
    kind = EXTENSIONS.get(path.rsplit("/", 1)[-1].rpartition(".")[2].lower())
    if kind:
        return kind
    head, lines = beginning(spark, path)
    if head in MAGIC:
        return "pcap"
    for line in lines:
        if "CEF:" in line:
            return "cef_text"
        if line.strip().startswith("{"):
            try:
                json.loads(line)
                return "jsonl"
            except ValueError:
                pass
        if "," in line:
            return "csv"
        if line.strip():
            break
    raise ValueError(f"cannot tell what kind of evidence {path} is")


def sniff_dialect(columns: list[str]) -> str:
    """The dialect with most of its columns present, two at least; the first of equal ones."""
    have = {*columns}
    hits = {d: len(have & {*DIALECTS[d].values()}) for d in ("cicids2017", "unsw_nb15")}
    best = max(hits, key=hits.get)
    return best if hits[best] >= 2 else "generic_flow_csv"


def provenance(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """One row: path, SHA-256 of the file, time, row count and SHA-256 of the rows."""
    from tracelake.operators.custody import file_digest, table_digest

    digest, n = table_digest(df)
    return spark.range(1).select(F.lit(path).alias("path"), F.lit(file_digest(spark, path)).alias("file_sha256"), F.current_timestamp().alias("ingested_at"), F.lit(n).alias("row_count"), F.lit(digest).alias("events_sha256"))


READERS = {
    "cicids2017": read_clean_csv,
    "unsw_nb15": read_clean_csv,
    "kitsune": read_clean_csv,
    "flow_csv": read_flow_csv,
    "suricata_eve": read_jsonl,
    "firewall_cef": read_text_lines,
}


def register_reader(name: str, reader: Callable[..., DataFrame]) -> None:
    """Adds a reader (spark, path, **options), in the place of one of that name."""
    READERS[name] = reader


def read_source(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    """The reader registered under a name; ValueError lists the names otherwise."""
    if name not in READERS:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(sorted(READERS))}")
    return READERS[name](spark, path, **options)
