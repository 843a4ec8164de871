"""Custody: a hash chain over the steps of a case, and digests of whole tables."""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracelake.operators import merkle
from tracelake.operators.merkle import row_hash
from tracelake.sources.streams import listed

#: Bytes of a file that are read at a time.
PIECE = 1 << 20
#: Seconds that a writer waits for the marks of others.
PATIENCE = 30.0
GENESIS = "0" * 64
CHAIN = "case_id string, idx int, ts string, operation string, component string, input_hash string, output_hash string, prev_hash string, record_hash string, notes string"
_HASHED = ("case_id", "idx", "ts", "operation", "component", "input_hash", "output_hash", "prev_hash", "notes")


@dataclass(frozen=True)
class Link:
    case_id: str
    idx: int
    ts: str
    operation: str
    component: str
    input_hash: str | None
    output_hash: str | None
    prev_hash: str
    notes: str | None = None

    @property
    def record_hash(self) -> str:
        """SHA-256 of the nine fields as JSON with sorted keys, as Spark's variants print it."""
        fields = {k: v for k, v in asdict(self).items() if v is not None}
        return hashlib.sha256(json.dumps(fields, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def record_hash() -> Column:
    """The same hash from the chain's columns."""
    return F.sha2(F.to_json(F.parse_json(F.to_json(F.struct(*_HASHED)))), 256)


class CustodyConflict(Exception):
    """Another writer has taken the link's number."""


class CustodyChain:
    """An append-only table of links; a case has a handful of them.

    (case, number) is a key. A store need not create a file for one writer alone, only show what was written: whoever wants a link
    first leaves a mark, withdraws if a claim is there, otherwise leaves a claim and takes the mark away; when no other
    mark is left, everybody who could still claim has, and the least of the claims has the link.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)

    def _all(self) -> DataFrame:
        return self.spark.read.schema(CHAIN).option("recursiveFileLookup", True).parquet(self.path)

    def _claimed(self, case_id: str, idx: int) -> bool:
        """Whether this writer has a link; Spark's readers pass over names that begin with an underscore."""
        hadoop, me = self.spark._jvm.org.apache.hadoop.fs, uuid.uuid4().hex
        folder = hadoop.Path(f"{self.path}/_claims/{hashlib.sha256(case_id.encode()).hexdigest()}-{idx}")
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

        def leave(kind: str) -> None:
            store.create(hadoop.Path(folder, f"{me}.{kind}"), True).close()

        def take(kind: str) -> None:
            store.delete(hadoop.Path(folder, f"{me}.{kind}"), False)

        def those(kind: str) -> list[str]:
            return sorted(name.removesuffix(f".{kind}") for name in (f.getPath().getName() for f in store.listStatus(folder)) if name.endswith(f".{kind}"))

        leave("mark")
        if those("claim"):
            take("mark")
            return False
        leave("claim")
        take("mark")
        until = time.monotonic() + PATIENCE
        while those("mark"):
            if time.monotonic() > until:  # a writer may have died amid this: nobody gets the link by guessing
                take("claim")
                return False
            time.sleep(0.02)
        return those("claim")[:1] == [me]

    def append(self, case_id: str, operation: str, component: str, input_hash: str | None, output_hash: str | None, notes: str | None = None) -> Link:
        """Adds a link after the case's last one; CustodyConflict where another writer is adding it."""
        last = last_links(self._all().where(F.col("case_id") == case_id)).first()
        link = Link(case_id, last.idx + 1 if last else 1, datetime.now(timezone.utc).isoformat(), operation, component, input_hash, output_hash, last.record_hash if last else GENESIS, notes)
        if not self._claimed(case_id, link.idx):
            raise CustodyConflict(f"link {link.idx} of case {case_id} was taken by another writer")
        row = {**asdict(link), "record_hash": link.record_hash}
        self.spark.createDataFrame([tuple(row[f.split()[0]] for f in CHAIN.split(", "))], CHAIN).coalesce(1).write.parquet(f"{self.path}/{uuid.uuid4().hex}")
        return link

    def chain(self, case_id: str) -> DataFrame:
        return self._all().where(F.col("case_id") == case_id).orderBy("idx")

    def verify(self, case_id: str, expected: int | None = None) -> dict:
        """Whether all links of a case hold; ``expected`` also catches links cut off at the end."""
        found = verify_chain(self._all().where(F.col("case_id") == case_id)).first()
        issues = [*found.issues] if found else []
        total = found.total if found else 0
        if expected is not None and total != expected:
            issues.append(f"{total} links, {expected} expected")
        return {"case_id": case_id, "valid": not issues, "total_records": total, "issues": issues}

    def report(self, case_id: str) -> dict:
        return {**self.verify(case_id), "records": [r.asDict() for r in self.chain(case_id).collect()]}


def last_links(chain: DataFrame) -> DataFrame:
    """The last index and its hash, per case."""
    return chain.groupBy("case_id").agg(F.max_by("record_hash", "idx").alias("record_hash"), F.max("idx").alias("idx"))


def broken_links(chain: DataFrame, case: str = "case_id", idx: str = "idx", prev: str = "prev_hash", own: str = "record_hash") -> DataFrame:
    """Adds ``link_ok``: whether the previous hash is that of the link before (the first: zeros)."""
    before = F.lag(own, 1, GENESIS).over(Window.partitionBy(case).orderBy(idx))
    return chain.withColumn("link_ok", F.coalesce(F.col(prev) == before, F.lit(False)))


def verify_chain(chain: DataFrame) -> DataFrame:
    """Per case: the number of links and what is wrong with them, in order."""
    checked = broken_links(chain).withColumn("hash_ok", F.col("record_hash") == record_hash())
    problems = F.concat(
        F.when(~F.col("hash_ok"), F.array(F.format_string("Eslabón #%d: the record was changed", "idx"))).otherwise(F.array().cast("array<string>")),
        F.when(~F.col("link_ok"), F.array(F.format_string("Eslabón #%d: the link before it was changed or is missing", "idx"))).otherwise(F.array().cast("array<string>")),
    )
    rows = checked.groupBy("case_id").agg(F.count(F.lit(1)).cast("int").alias("total"), F.sort_array(F.collect_list(F.struct("idx", problems.alias("p")))).alias("all"))
    return rows.select("case_id", "total", F.flatten(F.transform("all", lambda x: x.p)).alias("issues"))


def table_digest(df: DataFrame, seq: str = "seq", *, block: int = merkle.BLOCK) -> tuple[str, int]:
    """SHA-256 over a table in order of ``seq`` (of ``path`` before it, where rows have one) and its row count.

    It is the hash of the root of a Merkle tree of two levels or more over blocks of 4096 rows by count, so
    captures with the same numbers do not meet in one block.
    """
    order = [c for c in ("path",) if c in df.columns and c != seq] + [seq]
    found = merkle.tree(df, order, block=block, least=2)
    return hashlib.sha256(found.root.encode() if found.n else b"").hexdigest(), found.n


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes, computed where Spark reads it.

    Of a folder or a glob with several files: over the sorted paths (from the folder that all are in) and
    digests of all of them. Tasks read files in pieces.
    """
    files, opened = listed(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                digest = hashlib.sha256()
                with opened(name, content) as source:
                    while piece := source.read(PIECE):
                        digest.update(piece)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest.hexdigest()])], names=["path", "h"])

    found = sorted((r.path, r.h) for r in files.mapInArrow(run, "path string, h string").collect())
    if not found:
        raise FileNotFoundError(f"no file of evidence in {path}")
    if len(found) == 1:
        return found[0][1]
    above = os.path.commonpath([os.path.dirname(p) for p, _ in found])
    return hashlib.sha256(json.dumps([(os.path.relpath(p, above), h) for p, h in found]).encode()).hexdigest()
