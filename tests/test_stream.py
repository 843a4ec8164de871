"""The causal window on a stream against the batch: late and tied events, sources that go quiet, chunks, bounded state."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators.causal import AGGREGATES, causal_window
from tracelake.streaming import causal

SCHEMA = "source string, event_id long, ts timestamp, host string, port string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def stream(spark, tmp_path, parts, name, **options):
    """Runs a stream over parts (lists of rows with seconds as times), one a trigger."""
    for n, part in enumerate(parts):
        df = spark.createDataFrame([(s, i, float(t), h, p) for s, i, t, h, p in part], "source string, event_id long, t double, host string, port string")
        df.select("source", "event_id", F.timestamp_seconds("t").alias("ts"), "host", "port").coalesce(1).write.parquet(str(tmp_path / f"in/{n:03}"))
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = causal.causal_window_stream(read, **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    query.stop()
    return {r.event_id: tuple(r[a] for a in AGGREGATES) for r in spark.table(name).collect()}, state


def batch(spark, rows, seconds):
    df = spark.createDataFrame([(s, i, int(t * 1_000_000), h, p) for s, i, t, h, p in rows], "source string, event_id long, us long, host string, port string")
    return {r.event_id: tuple(r[a] for a in AGGREGATES) for r in causal_window(df, F.col("source"), F.col("us"), F.col("host"), F.col("port"), seconds=seconds).collect()}


def test_a_stream_gives_the_batch_result(rocks, tmp_path, monkeypatch):
    monkeypatch.setattr(causal, "CHUNK", 4)
    rng = random.Random(3)
    parts, event = [], 0
    for step in range(6):
        part = []
        for _ in range(40):
            # up to 50 seconds late, often at one time, hosts and ports that are missing
            t = 1000 + step * 60 + rng.choice([0, 20, 20.5, 59]) - rng.choice([0, 0, 10, 49])
            part.append((rng.choice("aab"), event, t, rng.choice(["x", "y", None]), rng.choice(["1", "2", "3", None])))
            event += 1
        parts.append(part)
    flush = [[("z", 10_000, 5000, "h", "1")], [("z", 10_001, 9000, "h", "1")]]
    found, state = stream(rocks, tmp_path, parts + flush, "w1", seconds=45, late="2 minutes")
    want = batch(rocks, [r for p in parts + flush for r in p], 45)
    want.pop(10_001)
    assert found == want
    # nothing is left of the sources that went quiet
    assert state[-1] <= 6 < max(state)


def test_late_events_and_missing_sources_are_left_out(rocks, tmp_path):
    parts = [[("a", 0, 1000, "h", "1")], [("a", 1, 2000, "h", "1"), (None, 7, 2000, "h", "1")], [("a", 2, 100, "h", "1")], [("a", 3, 3000, "h", "1")], [("a", 4, 9000, "h", "1")]]
    found, _ = stream(rocks, tmp_path, parts, "w1_late", seconds=60, late="10 seconds")
    assert found == {i: (1, 1, 1, 1.0) for i in (0, 1, 3)}
