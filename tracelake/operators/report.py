"""Aggregates of findings for reports, and their text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracelake.schema import NORMAL


def finding_category(attack_cat: Column, label: Column) -> Column:
    """The predicted category; for models without names, what the label says."""
    named = F.when(label == 0, "Tráfico normal").when(label == 1, "Actividad potencialmente maliciosa").otherwise("Desconocido")
    return F.coalesce(F.nullif(attack_cat, F.lit("")), named)


def filter_categories(findings: DataFrame, categories: list[str] | None, category: str = "category") -> DataFrame:
    """Findings of the categories; all of them if none are named."""
    return findings.where(F.col(category).isin(*categories)) if categories else findings


def malicious(findings: DataFrame, category: str = "category") -> DataFrame:
    return findings.where(~F.col(category).isin(*NORMAL))


def category_addresses(findings: DataFrame, *, category: str = "category", src: str = "src_ip", dst: str = "dst_ip") -> DataFrame:
    """Every address of every category, once: category, side (src or dst), ip, and how many findings name it. Empty ones are none."""
    side = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.nullif(F.col(c), F.lit("")).alias("ip")) for n, c in (("src", src), ("dst", dst))]))
    rows = findings.select(F.col(category).alias("category"), side.alias("a")).select("category", "a.*").where("ip IS NOT NULL")
    return rows.groupBy("category", "side", "ip").agg(F.count(F.lit(1)).alias("n"))


def feature_rank(findings: DataFrame, n: int = 5, *, category: str = "category", features: str = "top_features", seq: str = "seq") -> DataFrame:
    """The n features with the largest sum of absolute contributions in each category, ties by first appearance."""
    rows = findings.select(F.col(category).alias("category"), F.col(seq).alias("seq"), F.posexplode(features).alias("at", "f"))
    sums = rows.groupBy("category", F.col("f.feature").alias("feature")).agg(F.sum(F.abs("f.shap_value")).alias("total"), F.min(F.struct("seq", "at")).alias("first"))
    order = Window.partitionBy("category").orderBy(F.desc("total"), "first", "feature")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("category", "feature", "total", "rank")


def ranked(probabilities: Column) -> Column:
    """A map's entries by value, largest first."""
    return F.array_sort(F.map_entries(probabilities), lambda a, b: F.when(a.value > b.value, -1).when(a.value < b.value, 1).otherwise(F.when(a.key < b.key, -1).otherwise(1)))


def category_overview(findings: DataFrame, n: int | None = 5, *, category: str = "category", src: str = "src_ip", dst: str = "dst_ip", probability: str = "probability", seq: str = "seq") -> DataFrame:
    """Per category: count, how many addresses of either kind, the first n of each in order (None: all), mean probability, first appearance.

    Addresses are made distinct by a shuffle of their own, so with ``n`` no row or task holds all of a category's; without,
    a category's row holds each of its addresses once.
    """
    rows = findings.select(F.col(category).alias("category"), F.nullif(F.col(src), F.lit("")).alias("src"), F.nullif(F.col(dst), F.lit("")).alias("dst"), F.col(probability).alias("probability"), F.col(seq).alias("seq"))
    out = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("probability").alias("mean_probability"), F.min("seq").alias("first_seq"))
    order = Window.partitionBy("category").orderBy("ip")
    for side in ("src", "dst"):
        some = rows.where(F.col(side).isNotNull()).groupBy("category", F.col(side).alias("ip")).agg(F.lit(1))
        counts = some.groupBy("category").agg(F.count(F.lit(1)).alias(f"n_{side}_ips"))
        some = some if n is None else some.withColumn("at", F.row_number().over(order)).where(F.col("at") <= n)
        first = some.groupBy("category").agg(F.array_sort(F.collect_list("ip")).alias(f"{side}_ips"))
        for more, empty in ((counts, F.lit(0).cast("long")), (first, F.array().cast("array<string>"))):
            name = more.columns[-1]
            found = more.withColumnRenamed("category", "__c")
            out = out.join(found, out["category"].eqNullSafe(found["__c"]), "left").drop("__c").withColumn(name, F.coalesce(name, empty))
    return out


def case_blocks(findings: DataFrame, *, category: str = "category", seq: str = "seq") -> DataFrame:
    """A block per malicious category in order of appearance: its overview, what it means, and the advice that goes with it."""
    meaning, advice = F.lit(MEANINGS[""]), F.lit(None).cast("string")
    for name, text in MEANINGS.items():
        meaning = F.when(F.col("category") == name, text).otherwise(meaning) if name else meaning
    advice = F.when(F.col("category").isin(*SCANS), ADVICE)
    return category_overview(malicious(findings, category), category=category, seq=seq).withColumns({"meaning": meaning, "advice": advice}).orderBy("first_seq")


#: What a reader who is no specialist should know of a category; the last is for any other.
MEANINGS = {
    "PortScan": "A source tried many ports of one host or a few, which tells it what services answer there.",
    "Reconnaissance": "A source gathered what it could learn of hosts and services, as is usual before an attack.",
    "DoS": "A source sent so much traffic that a service could no longer answer others.",
    "DDoS": "Many sources together sent so much traffic that a service could no longer answer others.",
    "BruteForce": "A source tried many passwords or keys in order to find one that is accepted.",
    "": "Traffic that the model tells from ordinary traffic and that a specialist should look at.",
}
SCANS = ("PortScan", "Reconnaissance")
ADVICE = "Review exposed services and segment the scanned networks."


def annex(findings: DataFrame) -> DataFrame:
    """``seq`` and ``line``: a paragraph of Markdown for every malicious finding, with probabilities and contributions where it has them."""

    def text(c: str, place: str = "-") -> Column:
        return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(place))

    parts = [F.format_string("### Event %d: %s", "seq", "category"), F.format_string("- %s to %s, probability %.4f", text("src_ip"), text("dst_ip"), F.coalesce("probability", F.lit(0.0)))]
    if "class_probabilities" in findings.columns:
        shown = F.transform(ranked(F.col("class_probabilities")), lambda e: F.format_string("%s %.4f", e.key, e.value))
        parts.append(F.concat(F.lit("- probabilities: "), F.array_join(shown, ", ")))
    if "top_features" in findings.columns:
        shown = F.transform("top_features", lambda f: F.format_string("%s %.4f", f.feature, f.shap_value))
        parts.append(F.concat(F.lit("- contributions: "), F.array_join(shown, ", ")))
    return malicious(findings).select("seq", F.concat_ws("\n", *parts, F.lit("")).alias("line"))


def write_json(findings: DataFrame, path: str) -> None:
    """The findings as JSON lines, written by the tasks that hold them."""
    findings.write.mode("overwrite").json(path)


def write_case(spark: SparkSession, case_id: str, findings: DataFrame | None, custody: dict, path: str) -> None:
    """A durable case: ``case`` (one JSON line with the verification and all links of custody), ``findings`` (JSON
    lines), ``summary`` and ``annex`` (Markdown; the annex has every malicious finding, in order).

    custody: what ``CustodyChain.report`` returns. Only the summary's rows, one for each category, come to the driver.
    """
    head = {"case_id": case_id, "verification": {k: v for k, v in custody.items() if k != "records"}, "custody": custody["records"]}
    head["findings"] = 0 if findings is None else findings.count()
    spark.createDataFrame([(json.dumps(head, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/case")
    if findings is not None:
        write_json(findings, f"{path}/findings")
        annex(findings).orderBy("seq").select("line").write.mode("overwrite").text(f"{path}/annex")
        spark.createDataFrame([(markdown(case_id, findings, custody),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")


def markdown(case_id: str, findings: DataFrame, verification: dict) -> str:
    """A report: the verdict on the chain, a table per category, and a block for each malicious category.

    Only a row per category comes to the driver; single findings are in the ``annex``.
    """
    summary = category_overview(findings).orderBy("first_seq").collect()
    ranks: dict[str, list[str]] = {}
    if "top_features" in findings.columns:
        for r in feature_rank(findings).orderBy("category", "rank").collect():
            ranks.setdefault(r.category, []).append(f"{r.feature} ({r.total:.3f})")

    def ips(some: list[str], n: int) -> str:
        return ", ".join(some) + ("..." if n > len(some) else "")

    lines = [
        f"# Case {case_id}",
        "",
        f"Chain of custody: {'valid' if verification['valid'] else 'BROKEN'}, {verification['total_records']} links.",
        *[f"- {x}" for x in verification["issues"]],
        "",
        "| Category | Events | Sources | Targets | Mean probability | Main features |",
        "|---|---|---|---|---|---|",
        *[f"| {r.category} | {r.n} | {ips(r.src_ips, r.n_src_ips)} | {ips(r.dst_ips, r.n_dst_ips)} | {r.mean_probability or 0:.4f} | {', '.join(ranks.get(r.category, []))} |" for r in summary],
        "",
    ]
    for r in case_blocks(findings).collect():
        lines += [f"## {r.category}", "", r.meaning, f"{r.n} events from {r.n_src_ips} sources to {r.n_dst_ips} targets.", ""]
    if any(r.category in SCANS for r in summary):
        lines += ["## Recommendation", "", ADVICE, ""]
    return "\n".join(lines)
