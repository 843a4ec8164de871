"""Writing, normalising and reading archives."""

import gzip
import hashlib
import os

import pytest

from tracelake.llm import warc
from tracelake.llm.tables import shared_dir

SCHEMA = "page_id long, url string, html string, digest string"
BIG = "ü" * 600  # 1200 bytes


def brute(rows):
    out = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        equal = [p for p, _, h, _ in rows if (h or "").encode() == data and p is not None]
        first = max(equal, default=None) if len(data) >= 1000 else None
        refers = first if first is not None and page != first else None
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(1, "http://a/", BIG, "x"), (2, "http://b/\r\nWARC-Type: bad", BIG, "y"), (3, None, None, None), (4, "u", "", None), (5, "u", "small", None), (6, "u", "small", None), (7, "u", BIG + "\r\n\r\nWARC/1.1\r\n", None), (None, "n", BIG, None), (2, "again", BIG, None), (8, "long", "y" * 3_000_000, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df, archive_bytes=4000).collect()]
    assert sorted(found, key=str) == brute(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_members_can_be_read_alone_and_have_a_sidecar(spark):
    folder = f"{shared_dir(spark)}/warc-test"
    df = spark.createDataFrame([(k, f"http://x/{k}", f"page {k} " * 50, None) for k in range(20)], SCHEMA)
    archives = warc.write_archives(df, folder)
    assert sum(r.records for r in archives.collect()) == 20
    index = warc.normalise_archives(archives, folder).collect()
    base = folder.removeprefix("file:")
    for name in {r.archive for r in index}:
        entries = sorted((r.offset, r.length) for r in index if r.archive == name)
        data = open(f"{base}/{name}", "rb").read()
        assert entries[0][0] == 0 and sum(n for _, n in entries) == len(data)
        assert all(a + n == b for (a, n), (b, _) in zip(entries, entries[1:]))
        assert all(gzip.decompress(data[a : a + n]).startswith(b"WARC/1.1\r\n") for a, n in entries)
        assert len(open(f"{base}/{name}.index.jsonl").readlines()) == len(entries)


def test_broken_archives_are_errors(spark):
    folder = f"{shared_dir(spark)}/warc-broken"
    base = folder.removeprefix("file:")
    os.makedirs(base, exist_ok=True)
    with open(f"{base}/a.warc.gz", "wb") as out:
        out.write(gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 100\r\n\r\nshort"))
    with pytest.raises(Exception, match="ends within a record"):
        warc.normalise_archives(spark.createDataFrame([("a.warc.gz",)], "archive string"), folder).collect()


def test_headers_are_copied_and_cut_streams_refused(spark):
    folder = f"{shared_dir(spark)}/warc-headers"
    base = folder.removeprefix("file:")
    os.makedirs(base, exist_ok=True)
    record = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Concurrent-To: <urn:a>\r\nwarc-concurrent-to: <urn:b>\r\nX-Note: one\r\n\ttwo\r\nWARC-Record-ID: <urn:c>\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    whole = gzip.compress(record * 3)
    with open(f"{base}/h.warc.gz", "wb") as out:
        out.write(whole)
    with open(f"{base}/cut.warc.gz", "wb") as out:
        out.write(gzip.compress(os.urandom(0) + record * 200)[:-12])
    index = warc.normalise_archives(spark.createDataFrame([("h.warc.gz",)], "archive string"), folder).collect()
    assert len(index) == 3 and {r.record_id for r in index} == {"<urn:c>"}
    for r in index:
        with open(f"{base}/{r.archive}", "rb") as file:
            file.seek(r.offset)
            assert gzip.decompress(file.read(r.length)) == record
    with pytest.raises(Exception, match="ValueError.*ends"):
        warc.normalise_archives(spark.createDataFrame([("cut.warc.gz",)], "archive string"), folder).collect()


def test_very_many_equal_payloads_are_split_over_tasks(spark):
    """Most pages have one payload: without a broadcast the join still deals them out."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "12",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 4000, numPartitions=16).selectExpr("id AS page_id", "concat('u', id) AS url", "CASE WHEN id % 10 > 0 THEN repeat('same ', 400) ELSE sha2(cast(id AS string), 256) END AS html")
        folder = f"{shared_dir(spark)}/warc-skew-test"
        archives = warc.write_archives(df, folder).collect()
        assert sum(a.records for a in archives) == 4000 and max(a.records for a in archives) < 1000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_every_record_has_an_id_of_its_own(spark):
    folder = f"{shared_dir(spark)}/warc-ids-test"
    df = spark.createDataFrame([(1, "u", "same", None)] * 5, SCHEMA)
    index = warc.normalise_archives(warc.write_archives(df, folder), folder).collect()
    assert len({r.record_id for r in index}) == 5
