"""WARC archives: writing, normalising and reading back.

Crawlers often leave an archive as one gzip stream, which cannot be entered in the middle. The
normaliser inflates such a stream once, from its start to its end, rewrites every record as a gzip
member of its own and puts a sidecar index of offsets beside it. Archives lie in a folder that driver
and executors share, as files that pyarrow can open there (local and network disks, HDFS, S3, GCS).

Every task attempt writes files with names of its own, and only the rows of attempts that Spark
accepted name them: a task that runs again leaves at most files that nobody reads.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from tracelake.llm.components import apart
from tracelake.llm.tables import shared_dir, stored

CHUNK = 1 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = "archive string, offset long, length long, record_id string, record_type string, target string"
_INDEX_NAMES = [x.split()[0] for x in _INDEX.split(", ")]
_READ = "page_id long, target string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def _files(folder: str) -> tuple[pa.fs.FileSystem, str]:
    folder = re.sub(r"^file:/+", "file:///", folder) if folder.startswith("file:") else folder
    return pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)


def _header(value: object) -> str:
    """A value that cannot end its header line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, place: str) -> bytes:
    """A record; ``place``, its archive and number there, makes its id its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    lines = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>",
        "WARC-Date": date,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC-Profile": None if refers_to is None else REVISIT,
        "Page-ID": page_id,
        "Refers-To-Page-ID": refers_to,
        "Payload-Length": len(payload),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_header(v)}\r\n" for k, v in lines.items() if v is not None)
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 1000,
    archive_bytes: int = 512 << 20,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Writes a record per row into archives of one gzip stream each, of about ``archive_bytes`` before compression.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of at least
    ``least_bytes``, those with the largest id are responses and the others revisit it; smaller ones
    are all responses. Rows without an id revisit too, and are responses where no equal payload has an
    id. Returns ``archive`` string and ``records`` long.

    Payloads are dealt out once, by their digest; large groups of equal ones are split by the join.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    again = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    told = rows.join(apart(again), "digest", "left").withColumn("refers_to", F.when(F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)), F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _files(folder)
        files.create_dir(base, recursive=True)
        out, name, held, count = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    name, held, count = f"{uuid.uuid4().hex}.whole.warc.gz", 0, 0
                    raw = files.open_output_stream(f"{base}/{name}", compression=None)
                    out = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=6, mtime=0)
                record = _record(*row, date, f"{name} {count}")
                out.write(record)
                held, count = held + len(record), count + 1
                if held >= archive_bytes:
                    out.close()
                    raw.close()
                    done, out = [*done, (name, count)], None
        if out is not None:
            out.close()
            raw.close()
            done.append((name, count))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["archive", "records"])

    written = told.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "archive string, records long")
    return stored(written, "warc-archives")


def _header_of(source: gzip.GzipFile) -> tuple[bytes, dict[str, str]] | None:
    """The header of the next record of a stream as it stands, and its fields (of repeated ones the last); None at the end.

    A line that begins with a blank goes on with the field before.
    """
    line = source.readline()
    while line in (b"\r\n", b"\n"):
        line = source.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    raw, fields, name = [line], {}, ""
    while (line := source.readline()).strip():
        raw.append(line)
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and name:
            fields[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    if not line:
        raise ValueError("a WARC header ends early")
    return b"".join(raw) + line, fields


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites archives of ``folder`` record by record and returns their offset index.

    archives: ``archive``, names of gzip files (of one stream or several). Each is inflated once, in
    pieces of a megabyte. Beside each new archive lies its sidecar index, a line of JSON per record.
    Headers are copied byte by byte, with fields that repeat or go on in further lines.
    Returns per record: archive (the new one), offset, length, record_id, record_type and target. An
    archive that ends early, within a record or its gzip data, or holds anything else raises ValueError.
    """
    n = max(1, archives.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _files(folder)
        for batch in batches:
            for old in batch.column(0).to_pylist():
                entries = []
                new = f"{uuid.uuid4().hex}.warc.gz"
                with files.open_input_stream(f"{base}/{old}", compression=None) as raw, files.open_output_stream(f"{base}/{new}", compression=None) as out, gzip.GzipFile(fileobj=raw) as source:
                    try:
                        while (found := _header_of(source)) is not None:
                            head, fields = found
                            start, member = out.tell(), zlib.compressobj(6, wbits=31)
                            out.write(member.compress(head))
                            left = int(fields["content-length"])
                            while left:
                                piece = source.read(min(CHUNK, left))
                                if not piece:
                                    raise ValueError(f"{old} ends within a record")
                                left -= len(piece)
                                out.write(member.compress(piece))
                            out.write(member.compress(b"\r\n\r\n") + member.flush())
                            entries.append((new, start, out.tell() - start, fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri")))
                    except EOFError as early:
                        raise ValueError(f"{old} ends within its gzip data") from early
                with files.open_output_stream(f"{base}/{new}.index.jsonl", compression=None) as side:
                    for _, *entry in entries:
                        side.write(json.dumps(dict(zip(_INDEX_NAMES[1:], entry))).encode() + b"\n")
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in entries], pa.int64() if k in (1, 2) else pa.string()) for k in range(6)], names=_INDEX_NAMES)

    return stored(archives.select("archive").repartition(n).mapInArrow(run, _INDEX), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Reads records by their index entries alone, each from its own gzip member.

    Returns page_id, target, record_type, payload_bytes, payload_digest (bare lower-case hex SHA-1)
    and refers_to. A response's length and digest come from its payload, and ValueError is raised
    where its header names another digest; a revisit's come from its header.
    """
    n = max(1, index.select("archive").distinct().count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _files(folder)
        name, source = None, None
        for batch in batches:
            out = []
            for archive, at, length in zip(*[c.to_pylist() for c in batch.columns]):
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, files.open_input_file(f"{base}/{archive}")
                source.seek(at)
                head, _, block = zlib.decompress(source.read(length), wbits=31).partition(b"\r\n\r\n")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n"))}
                block = block[: int(fields["content-length"])]
                stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                if fields["warc-type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    if digest != stated:
                        raise ValueError(f"{archive}, {at}: the payload has not the stated digest")
                else:
                    size, digest = int(fields["payload-length"]), stated
                page, refers = fields.get("page-id"), fields.get("refers-to-page-id")
                out.append((page and int(page), fields.get("warc-target-uri"), fields["warc-type"], size, digest, refers and int(refers)))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in _READ.split(", ")])

    entries = index.select("archive", "offset", "length").repartition(n, "archive").sortWithinPartitions("archive", "offset")
    return entries.mapInArrow(run, _READ)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes rows as archives, normalises these and reads every record back (see the three functions).

    A null url has no target. Repeated rows give repeated records, an empty table none; other columns
    than id, url and html are not read.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_records(normalise_archives(write_archives(pages, folder, **options), folder), folder)
