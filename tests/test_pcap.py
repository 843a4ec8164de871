"""Captures by byte ranges against a plain sequential reader: records that look like headers, broken files, pcapng, vlan tags."""

import random
import socket
import struct

import pytest
from pyspark.sql import functions as F

from tracelake.sources import pcap


def sequential(content):
    """Packets of a capture one after the other, as (ts, src, dst, sport, dport, protocol, length)."""
    out = []
    if content[:4] == b"\x0a\x0d\x0d\x0a":
        at, end, links, units = 0, "<", [], []
        while at + 12 <= len(content):
            if content[at : at + 4] == b"\x0a\x0d\x0d\x0a":
                end, links, units = "<" if content[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">", [], []
            kind, size = struct.unpack_from(end + "II", content, at)
            body = content[at + 8 : at + size - 4]
            if kind == 1:
                links.append(struct.unpack_from(end + "H", body)[0])
                code = struct.unpack_from(end + "HH", body, 8)[0] if len(body) > 8 else 0
                units.append((2.0 ** -(body[12] & 127) if body[12] & 128 else 10.0 ** -body[12]) if code == 9 else 1e-6)
            elif kind == 6:
                port, high, low, kept, length = struct.unpack_from(end + "IIIII", body)
                out.append((((high << 32) | low) * units[port], *decoded(body[20 : 20 + kept], links[port]), length))
            at += size
        return out
    end, unit = pcap._MAGIC[content[:4]]
    link = struct.unpack_from(end + "I", content, 20)[0]
    at = 24
    while at + 16 <= len(content):
        seconds, part, kept, length = struct.unpack_from(end + "IIII", content, at)
        out.append((seconds + part * unit, *decoded(content[at + 16 : at + 16 + kept], link), length))
        at += 16 + kept
    return out


def decoded(frame, link):
    none = (None,) * 5
    at = 0
    if link == 1:
        kind, at = frame[12:14], 14
        while kind in (b"\x81\x00", b"\x88\xa8"):
            kind, at = frame[at + 2 : at + 4], at + 4
        if kind != b"\x08\x00":
            return none
    elif link not in (101, 228):
        return none
    if len(frame) < at + 20 or frame[at] >> 4 != 4 or frame[at + 9] not in (6, 17):
        return none
    ports = at + (frame[at] & 15) * 4
    if len(frame) < ports + 4:
        return none
    return (socket.inet_ntoa(frame[at + 12 : at + 16]), socket.inet_ntoa(frame[at + 16 : at + 20]), *struct.unpack_from("!HH", frame, ports), "TCP" if frame[at + 9] == 6 else "UDP")


def frame(rng, link=1):
    words = rng.choice([5, 5, 5, 6, 15])
    proto = rng.choice([6, 6, 17, 1])
    ip = bytes([rng.choice([0x40, 0x40, 0x60]) | words, 0, 0, 40, 0, 0, 0, 0, 64, proto, 0, 0]) + rng.randbytes(8) + bytes(4 * (words - 5))
    tags = rng.choice([b"", b"", b"\x81\x00\x00\x05", b"\x88\xa8\0\1\x81\0\0\2"])
    kind = rng.choice([b"\x08\x00"] * 4 + [b"\x08\x06"])
    whole = (rng.randbytes(12) + tags + kind if link == 1 else b"") + ip + struct.pack("!HH", rng.randrange(65536), rng.randrange(65536)) + rng.randbytes(rng.randrange(400))
    return whole[: rng.choice([10**6, 10**6, 10**6, rng.randrange(1, 60)])]


def records(rng, n, end="<", link=1, parts=10**6):
    out = b""
    for i in range(n):
        data = frame(rng, link)
        out += struct.pack(end + "IIII", 1_700_000_000 + i, rng.randrange(parts), len(data), len(data) + rng.choice([0, 0, 100])) + data
    return out


def libpcap(rng, n, magic=b"\xd4\xc3\xb2\xa1", link=1):
    end, unit = pcap._MAGIC[magic]
    return magic + struct.pack(end + "HHiIII", 2, 4, 0, 0, 65535, link) + records(rng, n, end, link, round(1 / unit))


def block(kind, body, end="<"):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(end + "II", kind, len(body) + 12) + body + struct.pack(end + "I", len(body) + 12)


def pcapng(rng, n):
    out = b""
    for end, count in (("<", n // 2), (">", n - n // 2)):
        out += block(0x0A0D0D0A, struct.pack(end + "IHHq", 0x1A2B3C4D, 1, 0, -1), end)
        interfaces = [(1, b"")]
        out += block(1, struct.pack(end + "HHI", 1, 0, 65535), end)
        for i in range(count):
            if i in (count // 3, count // 2):
                link, unit = rng.choice([(1, 9), (101, 0x80 | 20)])
                interfaces.append((link, unit))
                out += block(1, struct.pack(end + "HHIHHB3xI", link, 0, 65535, 9, 1, unit, 0), end)
            if i % 7 == 0:
                out += block(5, rng.randbytes(rng.randrange(30)), end)
            port = rng.randrange(len(interfaces))
            data = frame(rng, interfaces[port][0])
            stamp = rng.randrange(1 << 50)
            out += block(6, struct.pack(end + "IIIII", port, stamp >> 32, stamp & 0xFFFFFFFF, len(data), len(data) + 5) + data, end)
    return out


def rows(df):
    return [tuple(r)[2:] for r in df.orderBy("path", "ordinal").collect()]


MAKERS = {
    "micro": lambda rng: libpcap(rng, 500),
    "big endian": lambda rng: libpcap(rng, 300, b"\xa1\xb2\xc3\xd4"),
    "nano": lambda rng: libpcap(rng, 300, b"\x4d\x3c\xb2\xa1", 101),
    "ng": lambda rng: pcapng(rng, 400),
    "cut record": lambda rng: libpcap(rng, 200)[:-7],
    "trailing bytes": lambda rng: libpcap(rng, 200) + b"\1" * 9,
    "header only": lambda rng: libpcap(rng, 0),
    # a frame that holds a whole capture: its records are as plausible as the real ones
    "nested": lambda rng: libpcap(rng, 5) + struct.pack("<IIII", 1_700_000_000, 5, 20_000, 20_000) + records(rng, 200)[:20_000].ljust(20_000, b"\0") + records(rng, 100),
    "empty packets": lambda rng: libpcap(rng, 3) + struct.pack("<IIII", 5, 5, 0, 60) * 400 + records(rng, 50),
    "noise": lambda rng: libpcap(rng, 20) + rng.randbytes(9000),
}


@pytest.mark.parametrize("name", MAKERS)
def test_ranges_give_what_a_sequential_reader_gives(spark, tmp_path, name):
    content = MAKERS[name](random.Random(name))
    (tmp_path / "x.pcap").write_bytes(content)
    want = sequential(content)
    for size in (1500, 7000, 1 << 26):
        found = pcap.read_packets(spark, str(tmp_path / "x.pcap"), range_bytes=size)
        assert rows(found) == want
        assert [r.ordinal for r in found.orderBy("ordinal").collect()] == [*range(len(want))]
    few = pcap.read_packets(spark, str(tmp_path / "x.pcap"), range_bytes=7000, max_packets=31)
    assert rows(few) == want[:31]


def test_one_capture_is_read_by_several_tasks(spark, tmp_path):
    content = libpcap(random.Random(1), 3000)
    (tmp_path / "x.pcap").write_bytes(content)
    found = pcap.read_packets(spark, str(tmp_path), range_bytes=50_000).withColumn("task", F.spark_partition_id())
    assert found.select("task").distinct().count() > 8 and found.count() == 3000
    assert pcap.index(spark, str(tmp_path), range_bytes=50_000).count() == -(-len(content) // 50_000)


def test_data_source(spark, tmp_path):
    pcap.register(spark)
    rng = random.Random(2)
    for i, content in enumerate((libpcap(rng, 700), libpcap(rng, 3), pcapng(rng, 60))):
        (tmp_path / f"{i}.pcap").write_bytes(content)
        found = spark.read.format("capture").option("rangeBytes", 9000).load(str(tmp_path / f"{i}.pcap")).orderBy("position").collect()
        assert [tuple(r)[2:] for r in found] == sequential(content)
    every = spark.read.format("capture").load(str(tmp_path))
    assert every.count() == 763 and every.select("path").distinct().count() == 3
    assert spark.read.format("capture").load(str(tmp_path / "[01].pcap")).count() == 703
    with pytest.raises(Exception, match="no capture"):
        spark.read.format("capture").load(str(tmp_path / "9*.pcap")).count()


def test_odd_files(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(b"no capture at all, but long enough for a header")
    with pytest.raises(Exception, match="not a packet capture"):
        pcap.read_packets(spark, str(tmp_path / "x.pcap")).count()
