"""A case from evidence to findings, with a link of custody for every step."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracelake.operators.custody import CustodyChain, file_digest, table_digest
from tracelake.operators.matrix import aggregate_events, feature_matrix
from tracelake.operators.model import FrozenClassifier
from tracelake.operators.report import finding_category
from tracelake.plans.registry import REGISTRY, Registry


@dataclass(frozen=True)
class Evidence:
    """Normalised events, what kind they are and whether they came with labels."""

    raw: DataFrame
    events: DataFrame
    kind: str
    labeled: bool
    component: str


def normalize_any(spark: SparkSession, path: str, hint: str | None = None, *, registry: Registry = REGISTRY, **options) -> Evidence:
    """Reads any evidence: the kind is ``hint`` (that of a registered handler) or told from the file."""
    handler = registry.handler(hint or registry.sniff(spark, path))
    raw = handler.read(spark, path, **options)
    return Evidence(raw, handler.events(raw), handler.detail(raw) if handler.detail else handler.kind, handler.labeled(raw), handler.component)


@dataclass(frozen=True)
class CaseReport:
    case_id: str
    source: str
    findings: DataFrame | None
    verification: dict


def run_case(
    spark: SparkSession,
    case_id: str,
    source: str,
    path: str,
    classifier: FrozenClassifier,
    chain: CustodyChain,
    *,
    seconds: float = 60.0,
    registry: Registry = REGISTRY,
    on_step: Callable[[str, dict], None] = lambda step, info: None,
) -> CaseReport:
    """Ingests, normalises, aggregates, scores and explains; every step's table is written, and hashed as written.

    The tables lie beside the chain, in ``<chain>-steps``; each step reads what the one before wrote, and the
    findings are read from the last of them: what is returned is what the chain vouches for, whatever
    becomes of the evidence.

    on_step hears of ingest, ocsf_normalize, aggregate, feature_extract, classify and verify, or of
    done where the evidence has no event. ValueError for an unknown source.
    """
    evidence = normalize_any(spark, path, registry.kind_of(source), registry=registry)
    raw = evidence.raw.withColumn("raw", F.to_json("raw")) if "raw" in evidence.raw.columns else evidence.raw
    folder = f"{chain.path.rstrip('/')}-steps/{uuid.uuid4().hex}"

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    held, n = table_digest(written(raw, "ingest"))
    chain.append(case_id, "ingest", f"ingest:{evidence.kind}:{evidence.component}", file_digest(spark, path), held, f"{n} records as {evidence.kind}")
    on_step("ingest", {"label": "Ingest", "detail": f"{n} records"})

    rows = written(evidence.events, "ocsf_normalize")
    before, (held, n) = held, table_digest(rows)
    chain.append(case_id, "ocsf_normalize", f"normalize:{evidence.kind}:{evidence.component}", before, held, f"{n} events")
    on_step("ocsf_normalize", {"label": "Normalise", "detail": f"{n} events"})
    if not n:
        report = CaseReport(case_id, source, None, chain.verify(case_id))
        on_step("done", {"label": "Done", "detail": "no events"})
        return report

    steps = [
        ("aggregate", lambda x: aggregate_events(x, seconds=seconds)),
        ("feature_extract", lambda x: feature_matrix(x, classifier.features)),
        ("classify", lambda x: classifier.explain(classifier.predict(x))),
    ]
    for name, step in steps:
        rows = written(step(rows), name)
        before, (held, n) = held, table_digest(rows)
        chain.append(case_id, name, f"step:{name}", before, held, f"{n} rows")
        on_step(name, {"label": name, "detail": f"{n} rows"})
    findings = rows.select(
        "seq",
        F.col("src_endpoint.ip").alias("src_ip"),
        F.col("dst_endpoint.ip").alias("dst_ip"),
        finding_category(F.col("prediction.attack_cat"), F.col("prediction.label")).alias("category"),
        F.col("prediction.label").alias("label"),
        F.col("prediction.probability").alias("probability"),
        F.col("prediction.class_probabilities").alias("class_probabilities"),
        "top_features",
    )
    verification = chain.verify(case_id)
    on_step("verify", {"label": "Verify", "detail": str(verification["valid"])})
    return CaseReport(case_id, source, findings, verification)
