"""Packet captures (libpcap with micro- or nanoseconds, and pcapng) as rows of packets, read by byte ranges.

A capture names its records by their lengths alone, so a range that begins amid one has to find the next: where a
chain of plausible headers starts. Such a find is a guess, and is checked: every range's first record must be the
one at which the range before it ends. A file where that fails is walked from its start by one task.
"""

from __future__ import annotations

import socket
import struct
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracelake.sources.streams import listed, open_file, open_output, paths_of
from tracelake.storage import stored

#: Bytes of a range.
RANGE = 64 << 20
#: Headers that must follow each other plausibly, and bytes in which the first of them is looked for at a time.
CHAIN, LOOK = 6, 1 << 20
#: No record is longer than this where a capture names no larger limit.
LONGEST = 262_144
#: Bytes of a frame that hold its headers, at most.
HEADERS = 1 << 12
#: Packets that leave a task in one Arrow batch.
ROWS = 50_000

PACKET = "path string, ordinal long, ts double, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, length int"
_INDEX = "path string, range int, first long, next long, packets long, context binary"

#: The place after the last record of a capture that is broken off.
_NEVER = 1 << 62
_SECTION = b"\x0a\x0d\x0d\x0a"
# Byte order and unit of time by magic number.
_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e-6), b"\xa1\xb2\xc3\xd4": (">", 1e-6), b"\x4d\x3c\xb2\xa1": ("<", 1e-9), b"\xa1\xb2\x3c\x4d": (">", 1e-9)}


def _words(data: np.ndarray, at: np.ndarray, end: str) -> np.ndarray:
    """Unsigned 32-bit integers at the places ``at``."""
    four = data[at[:, None] + np.arange(4)]
    return np.ascontiguousarray(four).view(end + "u4")[:, 0].astype(np.int64)


class _Pcap:
    """Records of libpcap: a header of 16 bytes (seconds, parts of a second, bytes kept, bytes sent), then the bytes kept."""

    start = 24

    def __init__(self, head: bytes):
        self.end, self.unit = _MAGIC[head[:4]]
        self.parts = round(1 / self.unit)
        _, _, _, _, snap, self.link = struct.unpack(self.end + "HHiIII", head[4:24])
        self.longest = max(LONGEST, min(snap, 1 << 26))
        self.step = 1

    def plausible(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        _, part, kept, length = (_words(data, at + o, self.end) for o in (0, 4, 8, 12))
        return (part < self.parts) & (kept > 0) & (kept <= self.longest) & (kept <= length) & (length < 1 << 24)

    def size(self, data: memoryview, at: int) -> int:
        return 16 + int.from_bytes(data[at + 8 : at + 12], "little" if self.end == "<" else "big")

    head = 16

    def is_packet(self, data: memoryview, at: int) -> bool:
        return True

    def names(self, data: memoryview, at: int) -> bool:
        return False

    def enter(self, context: bytes) -> None:
        pass

    def fields(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Time, where the frame begins, bytes kept, bytes sent and link of the packets at ``at``."""
        seconds, part, kept, length = (_words(data, at + o, self.end) for o in (0, 4, 8, 12))
        return seconds + part * self.unit, at + 16, kept, length, np.full(len(at), self.link)


class _PcapNg:
    """Blocks of pcapng: type and length, a body and the length again. Sections name the byte order, interfaces link and unit of time."""

    start = 0
    head = 12
    longest = 1 << 26

    def __init__(self, head: bytes):
        self.end = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
        self.step = 4
        self.links: list[int] = []
        self.units: list[float] = []

    def _order(self) -> str:
        return "little" if self.end == "<" else "big"

    def plausible(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        size = _words(data, at + 4, self.end)
        fits = (size >= 12) & (size % 4 == 0) & (size <= self.longest)
        inside = fits & (at + size <= len(data))
        again = _words(data, np.where(inside, at + size - 4, 0), self.end)
        return inside & (again == size)

    def size(self, data: memoryview, at: int) -> int:
        size = int.from_bytes(data[at + 4 : at + 8], self._order())
        return size if size >= 12 else 0

    def is_packet(self, data: memoryview, at: int) -> bool:
        return int.from_bytes(data[at : at + 4], self._order()) == 6

    def names(self, data: memoryview, at: int) -> bool:
        """Whether a block is a section, whose byte order holds from here on, or an interface."""
        if bytes(data[at : at + 4]) == _SECTION:
            self.end = "<" if bytes(data[at + 8 : at + 12]) == b"\x4d\x3c\x2b\x1a" else ">"
            return True
        return int.from_bytes(data[at : at + 4], self._order()) == 1

    def enter(self, context: bytes) -> None:
        """Takes up the sections and interfaces that come before a packet."""
        self.links, self.units, at = [], [], 0
        while at + 12 <= len(context):
            section = context[at : at + 4] == _SECTION
            if section:
                self.end, self.links, self.units = "<" if context[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">", [], []
            size = int.from_bytes(context[at + 4 : at + 8], self._order())
            if not section:
                body = context[at + 8 : at + size - 4]
                self.links.append(struct.unpack_from(self.end + "H", body)[0])
                self.units.append(self._unit(body))
            at += size

    def _unit(self, body: bytes) -> float:
        unit, o = 1e-6, 8
        while o + 4 <= len(body):
            code, n = struct.unpack_from(self.end + "HH", body, o)
            if code == 0:
                break
            if code == 9:
                unit = 2.0 ** -(body[o + 4] & 127) if body[o + 4] & 128 else 10.0 ** -body[o + 4]
            o += 4 + (n + 3) // 4 * 4
        return unit

    def fields(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        port, high, low, kept, length = (_words(data, at + 8 + o, self.end) for o in (0, 4, 8, 12, 16))
        room = _words(data, at + 4, self.end) - 32
        ticks = (high.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)
        return ticks * np.array(self.units)[port], at + 28, np.minimum(kept, room), length, np.array(self.links)[port]


def _layout(source: BinaryIO) -> _Pcap | _PcapNg:
    source.seek(0)
    head = source.read(24)
    if head[:4] == _SECTION:
        return _PcapNg(head)
    if head[:4] not in _MAGIC:
        raise ValueError("not a packet capture")
    return _Pcap(head)


class _Bytes:
    """The bytes of a file from a place on, as many as were asked for so far."""

    def __init__(self, source: BinaryIO, start: int, n: int):
        self.source, self.start = source, start
        source.seek(start)
        self.data = source.read(n)

    def upto(self, end: int) -> memoryview:
        """At least the bytes before ``end``, if the file has them."""
        if end > self.start + len(self.data):
            self.source.seek(self.start + len(self.data))
            self.data += self.source.read(max(end - self.start - len(self.data), 1 << 16))
        return memoryview(self.data)


def _found(layout: _Pcap | _PcapNg, held: _Bytes, start: int, end: int) -> int | None:
    """The first place in a range from which a chain of plausible headers runs; None where there is none."""
    at = -(-start // layout.step) * layout.step
    while at < end:
        # a few records beyond what is looked at, so that chains do not end for want of bytes
        seen = np.frombuffer(held.upto(min(at, end) + LOOK + 2 * LONGEST), np.uint8)
        last = min(end, at + LOOK, held.start + len(seen) - layout.head)
        places = np.arange(at - held.start, max(last - held.start, 0), layout.step)
        view = memoryview(seen)
        for place in places[layout.plausible(seen, places)].tolist() if len(places) else []:
            here, links = place, 1
            while links < CHAIN:
                here += layout.size(view, here)
                if here + layout.head > len(seen):
                    break
                if not layout.plausible(seen, np.array([here]))[0]:
                    links = 0
                    break
                links += 1
            if links:
                return held.start + place
        if last < min(end, at + LOOK):
            return None
        at += LOOK
    return None


def _walked(layout: _Pcap | _PcapNg, held: _Bytes, first: int, end: int) -> tuple[list[int], int, list[tuple[int, bytes]]]:
    """Places of the packets from ``first`` on that begin before ``end``, where the next record begins, and the sections and interfaces among them with their places."""
    packets, blocks, at = [], [], first
    view = held.upto(first + layout.head)
    while at < end:
        here = at - held.start
        if here + layout.head > len(view):
            view = held.upto(at + layout.head)
            if here + layout.head > len(view):
                break
        if layout.names(view, here):
            size = layout.size(view, here)
            view = held.upto(at + size)
            blocks.append((at, bytes(view[here : here + size])))
        elif layout.is_packet(view, here):
            packets.append(at)
        size = layout.size(view, here)
        if not size:
            return packets, _NEVER, blocks
        at += size
    return packets, at, blocks


def _runs(layout: _Pcap | _PcapNg, before: bytes, blocks: list[tuple[int, bytes]], packets: list[int]) -> Iterator[list[int]]:
    """Packets in runs between which sections or interfaces come; the layout knows those before a run when it is handed out."""
    low = 0
    for place, block in [*blocks, (_NEVER, b"")]:
        high = bisect_left(packets, place, low)
        if high > low:
            layout.enter(before)
            yield packets[low:high]
        before, low = before + block, high


def _addresses(words: np.ndarray, known: np.ndarray) -> pa.Array:
    names, codes = np.unique(words[known], return_inverse=True)
    texts = pa.array([socket.inet_ntoa(struct.pack("!I", int(w))) for w in names], pa.string())
    where = np.zeros(len(words), np.int32)
    where[known] = codes
    return texts.take(pa.array(where, mask=~known)) if len(names) else pa.nulls(len(words), pa.string())


def _decoded(data: np.ndarray, at: np.ndarray, kept: np.ndarray, link: np.ndarray) -> list[pa.Array]:
    """Addresses, ports and protocol of TCP and UDP packets over IPv4, null for all others, a column at a time."""
    stop = np.minimum(at + kept, len(data))

    def byte(place: np.ndarray) -> np.ndarray:
        return data[np.minimum(place, max(len(data) - 1, 0))].astype(np.int64) if len(data) else np.zeros(len(place), np.int64)

    def pair(place: np.ndarray) -> np.ndarray:
        return np.where(place + 2 <= stop, byte(place) << 8 | byte(place + 1), -1)

    ethernet = link == 1
    kind, ip = pair(at + 12), at + 14
    while (tagged := ethernet & np.isin(kind, (0x8100, 0x88A8))).any():
        kind, ip = np.where(tagged, pair(ip + 2), kind), np.where(tagged, ip + 4, ip)
    raw = np.isin(link, (101, 228))
    ip = np.where(ethernet, ip, at)
    known = ((ethernet & (kind == 0x0800)) | raw) & (ip + 20 <= stop)
    known &= byte(ip) >> 4 == 4
    protocol = byte(ip + 9)
    ports = ip + (byte(ip) & 15) * 4
    known &= ((protocol == 6) | (protocol == 17)) & (ports + 4 <= stop)
    source, target = (pair(ip + o) << 16 | pair(ip + o + 2) for o in (12, 16))
    names = pa.array(["TCP", "UDP"]).take(pa.array((protocol == 17).astype(np.int8), mask=~known))
    return [_addresses(source, known), _addresses(target, known), *[pa.array(pair(ports + o).astype(np.int32), mask=~known) for o in (0, 2)], names]


def _batches(layout: _Pcap | _PcapNg, held: _Bytes, before: bytes, end: int, first: int, name: str, start: int | None) -> Iterator[pa.RecordBatch]:
    """The packets of a range in batches; their ``ordinal`` counts from ``start``, or they have their ``position`` where that is None."""
    places, _, blocks = _walked(layout, held, first, end)
    for run in _runs(layout, before, blocks, places):
        for low in range(0, len(run), ROWS):
            part = np.array(run[low : low + ROWS])
            data = np.frombuffer(held.upto(run[low : low + ROWS][-1] + HEADERS), np.uint8)
            ts, at, kept, length, link = layout.fields(data, part - held.start)
            numbers = part if start is None else np.arange(start, start + len(part))
            start = None if start is None else start + len(part)
            columns = [pa.array([name] * len(part)), pa.array(numbers, pa.int64()), pa.array(ts, pa.float64()), *_decoded(data, at, kept, link), pa.array(length.astype(np.uint32).view(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "position" if start is None else "ordinal", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length"])


def _range_of(source: BinaryIO, start: int, end: int, first: int | None, before: bytes = b"") -> tuple[int | None, int | None, int, bytes]:
    """First record of a range, the one that follows its last, packets, and sections and interfaces. ``first``, ``before``: where they are known."""
    layout = _layout(source)
    layout.enter(before)
    held = _Bytes(source, start, end - start + (1 << 16))
    if first is None:
        first = layout.start if start == 0 else _found(layout, held, start, end)
    if first is None and isinstance(layout, _PcapNg):  # perhaps a section in the other byte order
        layout.end = ">" if layout.end == "<" else "<"
        first = _found(layout, held, start, end)
    if first is None or first >= end:
        return None, None, 0, b""
    packets, after, blocks = _walked(layout, held, first, end)
    return first, after, len(packets), b"".join(b for _, b in blocks)


def index(spark: SparkSession, path: str, *, range_bytes: int = RANGE) -> DataFrame:
    """Where each range's records begin and what is known when they do: a written table of path, range, first, next, packets, context, start.

    ``start`` is the number of the range's first packet in its capture. Ranges in which no record begins have neither first nor next.
    """
    files, opened = listed(spark, path)
    # what no task can open by its path is one range, in a row of its own
    size = F.when(F.col("content").isNull(), F.lit(range_bytes)).otherwise(F.greatest("length", F.lit(1))).cast("long")
    ranges = files.withColumn("size", size).withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / F.col("size")))))
    ranges = ranges.select("path", F.col("range").cast("int").alias("range"), "length", "size", "content")
    n = ranges.count()

    def told(path: str, k: int, source: BinaryIO, length: int, size: int, first: int | None, before: bytes = b"") -> tuple:
        return path, k, *_range_of(source, k * size, min((k + 1) * size, length), first, before)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _INDEX.split(", ")])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for r in rows.to_pylist():
                with opened(r["path"], r["content"]) as source:
                    yield batch([told(r["path"], r["range"], source, r["length"], r["size"], None)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for r in rows.to_pylist():
                with opened(r["path"], r["content"]) as source:
                    after, before = _layout(source).start, b""
                    for k in range(max(-(-r["length"] // r["size"]), 1)):
                        here = after if k * r["size"] <= after < (k + 1) * r["size"] else None
                        found = told(r["path"], k, source, r["length"], r["size"], here, before) if here is not None else (r["path"], k, None, None, 0, b"")
                        after, before = found[3] if found[3] is not None else after, before + found[5]
                        yield batch([found])

    guessed = stored(ranges.repartitionByRange(max(n, 1), "path", "range").mapInArrow(look, _INDEX), "capture-ranges")
    order = Window.partitionBy("path").orderBy("range")
    before = F.last("next", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    sizes = ranges.select("path", "range", "size")
    checked = guessed.join(sizes, ["path", "range"]).withColumn("due", before)
    due = F.when((F.col("due") >= F.col("range") * F.col("size")) & (F.col("due") < (F.col("range") + 1) * F.col("size")), F.col("due"))
    # what is left where a file ends is no record
    wrong = checked.where((F.col("range") > 0) & ~due.eqNullSafe(F.col("first"))).join(ranges.select("path", "range", "length"), ["path", "range"]).where(F.coalesce(due + 12 <= F.col("length"), F.lit(True)))
    broken = stored(wrong.select("path").distinct(), "captures-to-walk")
    if not broken.isEmpty():
        again = ranges.where("range = 0").join(broken.hint("merge"), "path", "left_semi").repartition("path").mapInArrow(walk, _INDEX)
        guessed = stored(guessed.join(broken.hint("merge"), "path", "left_anti").unionByName(again), "capture-ranges")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    # sections and interfaces are a few short blocks of a capture
    known = F.array_join(F.transform(F.collect_list(F.nullif(F.hex("context"), F.lit(""))).over(so_far), lambda x: x), "")
    return guessed.withColumns({"start": F.coalesce(F.sum("packets").over(so_far), F.lit(0)), "before": F.unhex(known)}).join(sizes, ["path", "range"])


def read_packets(spark: SparkSession, path: str, *, max_packets: int | None = None, range_bytes: int = RANGE) -> DataFrame:
    """All packets of one or many captures, in order of ``ordinal`` within each; those that are not TCP or UDP over IPv4 have no addresses.

    A capture is read by ranges of ``range_bytes``, each a task's: first for where their records begin and how many packets they
    hold, then for the packets. ``max_packets`` counts per capture; ranges beyond it are not read again.
    """
    files, opened = listed(spark, path)
    ranges = index(spark, path, range_bytes=range_bytes).where("first IS NOT NULL AND packets > 0")
    if max_packets is not None:
        ranges = ranges.where(F.col("start") < max_packets)
    rows = ranges.select("path", "range", "first", "next", "start", "before", "size")
    if files.where("content IS NOT NULL").isEmpty():
        rows = rows.withColumn("content", F.lit(None).cast("binary"))
    else:
        rows = rows.join(files.select("path", "content"), "path")
    rows = stored(rows, "capture-index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["path"], r["content"]) as source:
                    layout, end = _layout(source), (r["range"] + 1) * r["size"]
                    layout.enter(r["before"])
                    held = _Bytes(source, r["first"], end - r["first"] + (1 << 16))
                    yield from _batches(layout, held, r["before"], end, r["first"], r["path"], r["start"])

    found = rows.repartitionByRange(max(rows.count(), 1), "path", "range").mapInArrow(run, PACKET)
    return found.where(F.col("ordinal") < max_packets) if max_packets is not None else found


def write_captures(packets: DataFrame, folder: str) -> list[str]:
    """Writes TCP and UDP packets over IPv4 as libpcap files ``<capture>.pcap``, headers alone, in order of ``ordinal``; returns their names.

    packets: capture (a name), ordinal, us (microseconds), src_ip, src_port, dst_ip, dst_port, protocol, length. A
    capture is a file, and so a task; a task that is run again writes the same file again.
    """
    wanted = packets.select("capture", "ordinal", "us", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "length")

    def record(r: dict) -> bytes:
        protocol = 6 if r["protocol"] == "TCP" else 17
        ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 40, 0, 0, 64, protocol, 0, socket.inet_aton(r["src_ip"]), socket.inet_aton(r["dst_ip"]))
        frame = bytes(12) + b"\x08\x00" + ip + struct.pack("!HH", r["src_port"], r["dst_port"])
        return struct.pack("<IIII", r["us"] // 1_000_000, r["us"] % 1_000_000, len(frame), max(r["length"], len(frame))) + frame

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["capture"] != name:
                    if file:
                        file.close()
                    name, file = r["capture"], open_output(f"{folder}/{r['capture']}.pcap")
                    file.write(b"\xd4\xc3\xb2\xa1" + struct.pack("<HHiIII", 2, 4, 0, 0, 65535, 1))
                    yield pa.RecordBatch.from_arrays([pa.array([name])], names=["capture"])
                file.write(record(r))
        if file:
            file.close()

    dealt = wanted.repartition("capture").sortWithinPartitions("capture", "ordinal")
    return sorted(r.capture for r in dealt.mapInArrow(run, "capture string").collect())


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


class CaptureSource(DataSource):
    """``spark.read.format("capture").load(path)``: packets of libpcap and pcapng captures with their place in the file.

    Options: ``rangeBytes``, the bytes a task reads of a libpcap capture; pcapng, whose interfaces a range cannot know, is a
    task a file. A range whose records do not follow each other plausibly is an error; ``read_packets`` checks
    ranges against each other instead, numbers the packets and reads any capture.
    """

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return PACKET.replace("ordinal", "position")

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _CaptureReader({k.lower(): v for k, v in self.options.items()})


class _CaptureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.bytes = options["path"], int(options.get("rangebytes", RANGE))

    def partitions(self) -> list[_Range]:
        found = []
        for path, length in paths_of(self.path):
            with open_file(path) as source:
                size = length if source.read(4) == _SECTION else self.bytes
            found += [_Range(path, low, min(low + size, length)) for low in range(0, length, max(size, 1))]
        if not found:
            raise FileNotFoundError(f"no capture in {self.path}")
        return found

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        with open_file(partition.path) as source:
            layout = _layout(source)
            held = _Bytes(source, partition.start, partition.end - partition.start + (1 << 16))
            first = layout.start if partition.start == 0 else _found(layout, held, partition.start, partition.end)
            if first is None or first >= partition.end:
                return
            places, _, _ = _walked(layout, held, first, partition.end)
            last = places[-1] if places else first
            data = np.frombuffer(held.upto(last + layout.head), np.uint8)
            if places and isinstance(layout, _Pcap) and partition.start and not layout.plausible(data, np.array(places) - held.start).all():
                raise ValueError(f"records of {partition.path} between {partition.start} and {partition.end} are not told apart; use read_packets")
            yield from _batches(layout, held, b"", partition.end, first, partition.path, None)


def register(spark: SparkSession) -> None:
    """Makes ``capture`` known to the session's readers."""
    spark.dataSource.register(CaptureSource)
