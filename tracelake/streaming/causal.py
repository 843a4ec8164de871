"""The causal window on a stream: per source, events that wait for the watermark and counters over one window.

An event is counted once, when the watermark passes it, and taken off once, when the window leaves it: hosts and ports
carry how many events of the window name them, so an event's aggregates are read, not computed anew. A source's
window is a queue of chunks, of which only the first and the last are touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "source string, event_id long, ts timestamp, agg_distinct_dst_ports long, agg_distinct_dst_hosts long, agg_events_in_window long, agg_events_per_second double"
#: Events of a chunk of a source's window.
CHUNK = 512


class _Counts:
    """How many events of the window name each host (port): read where they are named, written back together."""

    def __init__(self, state, distinct: int):  # noqa: ANN001
        self.state, self.distinct, self.held, self.stored = state, distinct, {}, {}

    def add(self, name: str | None, n: int) -> None:
        if name is None:
            return
        if name not in self.held:
            self.stored[name] = self.held[name] = self.state.getValue((name,))[0] if self.state.containsKey((name,)) else 0
        before, now = self.held[name], self.held[name] + n
        self.held[name] = now
        self.distinct += (now > 0) - (before > 0)

    def write(self) -> None:
        for name, n in self.held.items():
            if n:
                if n != self.stored[name]:
                    self.state.updateValue((name,), (n,))
            elif self.stored[name]:
                self.state.removeKey((name,))


class CausalWindow(StatefulProcessor):
    """State of a source: events not yet passed by the watermark, by time; the window as numbered chunks; counts by host and port; totals."""

    def __init__(self, seconds: float):
        self.width = int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long", "ids array<long>, hosts array<string>, ports array<string>")
        self.chunks = handle.getMapState("chunks", "n long", "us array<long>, hosts array<string>, ports array<string>")
        self.hosts = handle.getMapState("hosts", "name string", "n long")
        self.ports = handle.getMapState("ports", "name string", "n long")
        self.totals = handle.getValueState("totals", "first long, at int, last long, events long, hosts long, ports long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        closed = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000
        fresh: dict[int, list[tuple]] = {}
        for batch in rows:
            us = batch["ts"].to_numpy("datetime64[us]").astype("int64")
            for i, t, h, p in zip(batch["event_id"].tolist(), us.tolist(), batch["host"].tolist(), batch["port"].tolist()):
                if t >= closed:
                    fresh.setdefault(t, []).append((int(i), None if pd.isna(h) else h, None if pd.isna(p) else p))
        for t, new in fresh.items():
            ids, hosts, ports = self.waiting.getValue((t,)) if self.waiting.containsKey((t,)) else ([], [], [])
            self.waiting.updateValue((t,), ([*ids, *[x[0] for x in new]], [*hosts, *[x[1] for x in new]], [*ports, *[x[2] for x in new]]))
        yield from self._passed(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from self._passed(key, max(timerValues.getCurrentWatermarkInMs(), 0) * 1000)

    def close(self) -> None:
        pass

    def _passed(self, key: tuple, closed: int) -> Iterator[pd.DataFrame]:
        """Counts what the watermark has passed, in order, and what each of it sees."""
        waiting = [k[0] for k in self.waiting.keys()]
        due = sorted(t for t in waiting if t < closed)
        first, at, last, events, hosts, ports = self.totals.get() if self.totals.exists() else (0, 0, -1, 0, 0, 0)
        by_host, by_port = _Counts(self.hosts, hosts), _Counts(self.ports, ports)
        chunks: dict[int, tuple[list, list, list]] = {}

        def chunk(n: int) -> tuple[list, list, list]:
            if n not in chunks:
                chunks[n] = tuple([*x] for x in self.chunks.getValue((n,))) if self.chunks.containsKey((n,)) else ([], [], [])
            return chunks[n]

        def expire(before: int) -> None:
            """Takes off the events before a time."""
            nonlocal first, at, events
            while events:
                us, its_hosts, its_ports = chunk(first)
                while at < len(us) and us[at] < before:
                    by_host.add(its_hosts[at], -1)
                    by_port.add(its_ports[at], -1)
                    at, events = at + 1, events - 1
                if at < len(us):
                    return
                gone.append(first)
                chunks.pop(first)
                first, at = first + 1, 0

        gone: list[int] = []
        grown: set[int] = set()
        out: list[tuple] = []
        for t in due:
            expire(t - self.width)
            ids, its_hosts, its_ports = self.waiting.getValue((t,))
            for h, p in zip(its_hosts, its_ports):
                if last < first or len(chunk(last)[0]) >= CHUNK:
                    last = max(last + 1, first)
                grown.add(last)
                for column, value in zip(chunk(last), (t, h, p)):
                    column.append(value)
                by_host.add(h, 1)
                by_port.add(p, 1)
                events += 1
            oldest = chunk(first)[0][at]
            rate = round(events / max((t - oldest) / 1e6, 1.0), 6)
            out += [(key[0], i, pd.Timestamp(t, unit="us"), by_port.distinct, by_host.distinct, events, rate) for i in ids]
            self.waiting.removeKey((t,))
        # what no event to come can see
        expire(closed - self.width)
        for n in gone:
            if self.chunks.containsKey((n,)):
                self.chunks.removeKey((n,))
        by_host.write()
        by_port.write()
        if events:
            for n in grown & chunks.keys():
                self.chunks.updateValue((n,), chunks[n])
            self.totals.update((first, at, last, events, by_host.distinct, by_port.distinct))
        elif self.totals.exists():
            self.totals.clear()
            self.chunks.clear()
        # one timer: when the next event is passed, or else when the oldest leaves the window
        left = [t for t in waiting if t >= closed]
        wake = min(left) // 1000 + 1 if left else (chunk(first)[0][at] + self.width) // 1000 + 2 if events else None
        if wake is not None and wake not in set(self.handle.listTimers()):
            self.handle.registerTimer(wake)
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")])


def causal_window_stream(events: DataFrame, *, seconds: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """W1 for a stream of (source, event_id, ts, host, port): a row per event once the watermark has passed it.

    Ties and late events within ``late`` count as in a batch, later ones are dropped, as are rows without source or time. State is a
    source's events of one window before the watermark and of ``late`` after it. Needs the session's state store to be RocksDB
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    marked = events.where("source IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return marked.groupBy("source").transformWithStateInPandas(CausalWindow(seconds), OUTPUT, "append", "eventTime")
