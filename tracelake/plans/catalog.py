"""Queries that apply the operators to the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracelake.functions.scalars import cef_severity, day_first_seconds, event_time, eve_severity, finite, in_order, snake_case, syslog_time
from tracelake.operators import causal, clean, custody, flows, matrix, merkle, normalize, profile, report, sample, scan
from tracelake.operators.normalize import parse_cef, taxonomy
from tracelake.operators.quantiles import quantiles
from tracelake.plans import jobs
from tracelake.sources import files, pcap
from tracelake.storage import shared_dir, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DAY = 86_400


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with time in microseconds and the port that their properties hold."""
    rows = _t(spark, sf_dir, "events")
    return rows.withColumns({"us": F.unix_micros(F.col("ts").cast("timestamp")), "k": F.get_json_object("props", "$.k").cast("long")})


_EVENTS = "e AS (SELECT *, epoch_us(ts) AS us, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


def _window_sql(table: str, key: str, source: str, us: str, host: str, port: str, width: int, known: str = "TRUE") -> str:
    return f"""
SELECT {key},
  CASE WHEN {known} THEN count(DISTINCT {port}) OVER w ELSE 0 END AS agg_distinct_dst_ports,
  CASE WHEN {known} THEN count(DISTINCT {host}) OVER w ELSE 0 END AS agg_distinct_dst_hosts,
  CASE WHEN {known} THEN count(*) OVER w ELSE 0 END AS agg_events_in_window,
  CASE WHEN {known} THEN round(count(*) OVER w / greatest(({us} - min({us}) OVER w) / 1e6, 1.0), 6) ELSE 0.0 END AS agg_events_per_second
FROM {table} WINDOW w AS (PARTITION BY {source} ORDER BY {us} RANGE BETWEEN {width} PRECEDING AND CURRENT ROW)"""


def _window(df: DataFrame, key: list[str], source: Column, us: Column, host: str, port: str, seconds: float, **options) -> DataFrame:
    return causal.causal_window(df, source, us, F.col(host), F.col(port), seconds=seconds, **options).select(*key, *causal.AGGREGATES)


_W1 = f"WITH {_EVENTS} " + _window_sql("e", "event_id", "user_id", "us", "event_type", "k", DAY * 1_000_000)


@query(_W1)
def w1_causal_window(spark, sf_dir):
    return _window(_events(spark, sf_dir), ["event_id"], F.col("user_id"), F.col("us"), "event_type", "k", DAY)


@query(f"WITH {_EVENTS}, h AS (SELECT event_id, event_type, k, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS source, CASE WHEN event_id % 3 = 0 THEN us % {DAY * 1_000_000} ELSE us END AS us FROM e) " + _window_sql("h", "event_id", "source", "us", "event_type", "k", DAY * 1_000_000))
def w1_skew_bucketed(spark, sf_dir):
    """A third of all events from one source within one day, in ranges of 6000."""
    hot = F.col("event_id") % 3 == 0
    return _window(_events(spark, sf_dir), ["event_id"], F.when(hot, -1).otherwise(F.col("user_id")), F.when(hot, F.col("us") % (DAY * 1_000_000)).otherwise(F.col("us")), "event_type", "k", DAY, most=6000)


@query(
    f"WITH {_EVENTS}, m AS (SELECT event_id, event_type, k, CASE WHEN event_id % 7 <> 0 THEN user_id END AS source, CASE WHEN event_id % 11 <> 0 THEN us END AS us FROM e) "
    + _window_sql("m", "event_id", "source", "us", "event_type", "k", DAY * 1_000_000, "source IS NOT NULL AND us IS NOT NULL")
)
def w1_masked_nulls(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return _window(rows, ["event_id"], F.when(F.col("event_id") % 7 != 0, F.col("user_id")), F.when(F.col("event_id") % 11 != 0, F.col("us")), "event_type", "k", DAY)


_LINE_KEY = ["l_orderkey", "l_linenumber"]


@query("WITH e AS (SELECT *, epoch_us(l_shipdate) AS us FROM lineitem) " + _window_sql("e", "l_orderkey, l_linenumber", "l_suppkey", "us", "l_returnflag", "l_partkey", 30 * DAY * 1_000_000))
def w1_short_window(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").withColumn("us", F.unix_micros(F.col("l_shipdate").cast("timestamp")))
    return _window(rows, _LINE_KEY, F.col("l_suppkey"), F.col("us"), "l_returnflag", "l_partkey", 30 * DAY)


@query(
    f"""WITH {_EVENTS}, d AS (SELECT user_id, event_id, us // {DAY * 1_000_000} * {DAY * 1_000_000} AS us, event_type, k FROM e)
SELECT a.event_id, count(DISTINCT b.k) AS agg_distinct_dst_ports, count(DISTINCT b.event_type) AS agg_distinct_dst_hosts,
  count(*) AS agg_events_in_window, round(count(*) / greatest((any_value(a.us) - min(b.us)) / 1e6, 1.0), 6) AS agg_events_per_second
FROM d a JOIN d b ON a.user_id = b.user_id AND b.us >= a.us - {5 * DAY * 1_000_000} AND (b.us < a.us OR (b.us = a.us AND b.event_id <= a.event_id))
GROUP BY a.event_id"""
)
def w2_tie_ordered(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("us", F.floor(F.col("us") / (DAY * 1_000_000)) * (DAY * 1_000_000))
    return causal.tie_ordered_window(rows, "user_id", "us", "event_id", "event_type", "k", seconds=5 * DAY).select("event_id", *causal.AGGREGATES)


_FLOOD = f"WITH {_EVENTS}, h AS (SELECT event_id, event_type, k, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS source, us // 86400000000 * 86400000000 AS us FROM e)"


@query(
    f"""{_FLOOD}
SELECT event_id, count(DISTINCT k) OVER w AS agg_distinct_dst_ports, count(DISTINCT event_type) OVER w AS agg_distinct_dst_hosts, count(*) OVER w AS agg_events_in_window
FROM h WINDOW w AS (PARTITION BY source, us ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def w2_flooded_ties(spark, sf_dir):
    """A third of all events from one source, in times of whole days, a second's window: ties alone count, in order, in ranges of 200."""
    hot = F.col("event_id") % 3 == 0
    rows = _events(spark, sf_dir).withColumns({"source": F.when(hot, -1).otherwise(F.col("user_id")), "us": F.floor(F.col("us") / (DAY * 1_000_000)) * (DAY * 1_000_000)})
    return causal.tie_ordered_window(rows, "source", "us", "event_id", "event_type", "k", seconds=1, most=200).select("event_id", *causal.AGGREGATES[:3])


@query(
    f"""WITH {_EVENTS}, h AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS source, us FROM e),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY source ORDER BY event_id) > 60000000 THEN 1 ELSE 0 END AS new FROM h)
SELECT event_id, source, CAST(sum(new) OVER (PARTITION BY source ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS flow_no FROM g"""
)
def w3_hot_sessions(spark, sf_dir):
    """Sessions of a source with a third of all events, in ranges of 2000, beside those of all others."""
    rows = _events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 == 0, -1).otherwise(F.col("user_id")).alias("source"), "us")
    return flows.gap_sessions(rows, ["source"], "us", "event_id", gap_seconds=60, most=2000).select("event_id", "source", "flow_no")


@query(
    f"""WITH {_EVENTS}
SELECT a.event_id, count(DISTINCT b.k) AS agg_distinct_dst_ports, count(DISTINCT b.event_type) AS agg_distinct_dst_hosts, count(*) AS agg_events_in_window
FROM e a JOIN e b ON a.user_id = b.user_id AND b.us BETWEEN a.us - {DAY * 1_000_000} AND a.us GROUP BY a.event_id"""
)
def j1_range_self_join(spark, sf_dir):
    return causal.range_self_join(_events(spark, sf_dir), "event_id", "user_id", "us", "event_type", "k", seconds=DAY)


@query(
    f"""WITH {_EVENTS}, h AS (SELECT event_id, event_type, k, us, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS source FROM e)
SELECT event_id, count(DISTINCT k) OVER w AS agg_distinct_dst_ports, count(DISTINCT event_type) OVER w AS agg_distinct_dst_hosts, count(*) OVER w AS agg_events_in_window
FROM h WINDOW w AS (PARTITION BY source ORDER BY us RANGE BETWEEN {DAY * 1_000_000} PRECEDING AND CURRENT ROW)"""
)
def j1_flooded_self_join(spark, sf_dir):
    """The range join where a third of all events have one source: that source's days are scanned, not joined."""
    rows = _events(spark, sf_dir).withColumn("source", F.when(F.col("event_id") % 3 == 0, -1).otherwise(F.col("user_id")))
    return causal.range_self_join(rows, "event_id", "source", "us", "event_type", "k", seconds=DAY, most=100)


@query(
    f"""WITH {_EVENTS}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > {21_600 * 1_000_000} THEN 1 ELSE 0 END AS new FROM e),
f AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS flow_no FROM g),
s AS (SELECT *, first_value(event_type) OVER (PARTITION BY user_id, flow_no ORDER BY us, event_id) AS initiator FROM f)
SELECT user_id, flow_no, count(*) FILTER (event_type = initiator) AS packets_out, count(*) FILTER (event_type <> initiator) AS packets_in,
  CAST(sum(CASE WHEN event_type = initiator THEN k ELSE 0 END) AS BIGINT) AS bytes_out, CAST(sum(CASE WHEN event_type <> initiator THEN k ELSE 0 END) AS BIGINT) AS bytes_in,
  round((max(us) - min(us)) / 1e6, 6) AS duration
FROM s GROUP BY user_id, flow_no"""
)
def a1_gap_flows(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("at", F.struct("us", "event_id"))
    found = flows.gap_sessions(rows, ["user_id"], "us", "at", gap_seconds=21_600)
    first = found.groupBy("user_id", "flow_no").agg(F.min_by("event_type", "at").alias("initiator"))
    out = F.col("event_type") == F.col("initiator")
    return found.join(first, ["user_id", "flow_no"]).groupBy("user_id", "flow_no").agg(
        F.count_if(out).alias("packets_out"),
        F.count_if(~out).alias("packets_in"),
        F.sum(F.when(out, F.col("k")).otherwise(0)).alias("bytes_out"),
        F.sum(F.when(out, F.lit(0)).otherwise(F.col("k"))).alias("bytes_in"),
        F.round((F.max("us") - F.min("us")) / 1_000_000, 6).alias("duration"),
    )


@query(
    """SELECT CASE WHEN (CAST(l_suppkey AS VARCHAR), l_linenumber) <= (CAST(l_partkey AS VARCHAR), l_linenumber) THEN CAST(l_suppkey AS VARCHAR) ELSE CAST(l_partkey AS VARCHAR) END AS low_ip,
  CASE WHEN (CAST(l_suppkey AS VARCHAR), l_linenumber) <= (CAST(l_partkey AS VARCHAR), l_linenumber) THEN CAST(l_partkey AS VARCHAR) ELSE CAST(l_suppkey AS VARCHAR) END AS high_ip,
  count(*) AS n FROM lineitem GROUP BY ALL"""
)
def a1_canonical_key(spark, sf_dir):
    keyed = flows.canonical_key(_t(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber", "l_partkey", "l_linenumber")
    return keyed.groupBy(F.col("low.ip").alias("low_ip"), F.col("high.ip").alias("high_ip")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT trim(event_type) AS category, count(*) AS n FROM events GROUP BY 1")
def a2_class_counts(spark, sf_dir):
    return profile.class_counts(_t(spark, sf_dir, "events"), F.col("event_type"))


@query("SELECT trim(event_type) AS category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 3) AS share FROM events GROUP BY 1")
def a3_distribution(spark, sf_dir):
    return profile.distribution(_t(spark, sf_dir, "events"), F.col("event_type"))


@query("SELECT trim(event_type) AS category, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, category LIMIT 3")
def o5_top_k(spark, sf_dir):
    return profile.top_k(_t(spark, sf_dir, "events"), F.col("event_type"), 3)


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("seq"), F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("src_ip"), (F.col("user_id") % 17).cast("string").alias("dst_ip"), (F.col("event_id") % 100 / 100).alias("probability"))


@query(
    """WITH f AS (SELECT *, CAST(user_id AS VARCHAR) AS src, CAST(user_id % 17 AS VARCHAR) AS dst FROM events),
a AS (SELECT event_type AS category, array_to_string(list_sort(list(DISTINCT src)), ',') AS src_ips, array_to_string(list_sort(list(DISTINCT dst)), ',') AS dst_ips FROM f GROUP BY 1)
SELECT event_type AS category, count(*) AS n, count(DISTINCT src) AS n_src_ips, count(DISTINCT dst) AS n_dst_ips, any_value(src_ips) AS src_ips, any_value(dst_ips) AS dst_ips,
  round(avg(event_id % 100 / 100), 6) AS mean_probability, min(event_id) AS first_seq FROM f JOIN a ON category = event_type GROUP BY 1"""
)
def a4_a5_category_summary(spark, sf_dir):
    found = report.category_overview(_findings(spark, sf_dir), None)
    return found.withColumns({"src_ips": F.array_join("src_ips", ","), "dst_ips": F.array_join("dst_ips", ","), "mean_probability": F.round("mean_probability", 6)})


@query(
    """SELECT event_type AS category, side, ip, count(*) AS n
FROM (SELECT event_type, unnest(['src', 'dst']) AS side, unnest([CAST(user_id AS VARCHAR), CAST(user_id % 17 AS VARCHAR)]) AS ip FROM events) GROUP BY ALL"""
)
def a5_category_addresses(spark, sf_dir):
    return report.category_addresses(_findings(spark, sf_dir))


@query("SELECT event_id AS seq, event_type AS category, CAST(user_id AS VARCHAR) AS src_ip, CAST(user_id % 17 AS VARCHAR) AS dst_ip, event_id % 100 / 100 AS probability FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def p20_filter(spark, sf_dir):
    return report.filter_categories(_findings(spark, sf_dir), ["click", "view", "purchase"])


@query(
    """WITH f AS (SELECT l_returnflag AS category, unnest(['quantity', 'price', 'discount', 'tax']) AS feature, unnest([l_quantity, l_extendedprice / 1000, -l_discount * 100, l_tax * 10]) AS v FROM lineitem),
s AS (SELECT category, feature, sum(abs(v)) AS t FROM f GROUP BY 1, 2)
SELECT category, feature, round(t, 3) AS total, CAST(row_number() OVER (PARTITION BY category ORDER BY t DESC) AS INTEGER) AS rank FROM s QUALIFY rank <= 3"""
)
def a6_feature_rank(spark, sf_dir):
    values = {"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice") / 1000, "discount": -F.col("l_discount") * 100, "tax": F.col("l_tax") * 10}
    features = F.array(*[F.struct(F.lit(n).alias("feature"), v.alias("shap_value")) for n, v in values.items()])
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("category"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), features.alias("top_features"))
    return report.feature_rank(rows, 3).withColumn("total", F.round("total", 3))


_LABELED = "l AS (SELECT doc_id, toxic AS label, CASE WHEN quality = 1 THEN 'Normal' ELSE 'DoS' END AS category FROM labels)"


def _labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"), F.when(F.col("quality") == 1, "Normal").otherwise("DoS").alias("category"))


@query(
    f"""WITH {_LABELED} SELECT count(*) FILTER (category NOT IN ('Normal', 'Tráfico normal')) AS malicious, count(*) FILTER (label = 1) AS label_is_one,
  count(*) FILTER (label <> 0 AND category <> 'Normal') AS label_and_category, count(*) AS n FROM l"""
)
def a7_malicious_split(spark, sf_dir):
    return profile.malicious_split(_labeled(spark, sf_dir), F.col("label"), F.col("category"))


@query(f"WITH {_LABELED} SELECT count(*) FILTER (label = 0 AND lower(category) <> 'normal') AS zero_not_normal, count(*) FILTER (label = 1 AND lower(category) = 'normal') AS one_normal, count(*) AS n FROM l")
def a14_label_consistency(spark, sf_dir):
    return profile.label_consistency(_labeled(spark, sf_dir), F.col("label"), F.col("category"))


@query("SELECT l_returnflag, median(l_quantity) AS median_l_quantity, median(l_discount) AS median_l_discount FROM lineitem GROUP BY 1")
def a10_group_median(spark, sf_dir):
    return profile.group_medians(_t(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"])


@query("SELECT median(o_totalprice) AS median_price FROM orders")
def a8_median(spark, sf_dir):
    found = quantiles(_t(spark, sf_dir, "orders"), {"median_price": (F.col("o_totalprice"), 0.5)})
    return spark.createDataFrame([(found["median_price"],)], "median_price double")


@query("SELECT round(quantile_cont(l_extendedprice, 0.001), 6) AS low, round(quantile_cont(l_extendedprice, 0.999), 6) AS high FROM lineitem")
def a9_quantiles(spark, sf_dir):
    found = quantiles(_t(spark, sf_dir, "lineitem"), {"low": (F.col("l_extendedprice"), 0.001), "high": (F.col("l_extendedprice"), 0.999)})
    return spark.createDataFrame([(found["low"], found["high"])], "low double, high double").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_DISTINCT = ("l_linenumber", "l_returnflag", "l_linestatus", "l_tax")


@query("SELECT " + ", ".join(f"count(DISTINCT {c}) + max(CAST({c} IS NULL AS INTEGER)) AS {c}" for c in _DISTINCT) + " FROM lineitem")
def a11_distinct_profile(spark, sf_dir):
    return clean.distinct_counts(_t(spark, sf_dir, "lineitem"), list(_DISTINCT))


@query("SELECT bool_or(contains(html, '<table')) AS has_table, bool_or(contains(html, 'Infinity')) AS has_infinity FROM pages")
def a12_contains_any(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("html")
    found = [bool(clean.columns_containing(pages, mark)) for mark in ("<table", "Infinity")]
    return spark.createDataFrame([tuple(found)], "has_table boolean, has_infinity boolean")


@query(
    """WITH r AS (SELECT quality AS t, CAST(n_chars > 600 AS INTEGER) AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT unnest([0, 1]) AS c),
m AS (SELECT c, count(*) FILTER (t = c) AS truth, count(*) FILTER (p = c) AS predicted, count(*) FILTER (t = c AND p = c) AS hit FROM r, c GROUP BY c)
SELECT round(sum(hit) / sum(truth), 6) AS accuracy, round(avg(2 * hit / (truth + predicted)), 6) AS f1_macro, round(sum(2 * hit / (truth + predicted) * truth) / sum(truth), 6) AS f1_weighted,
  round(avg(hit / predicted), 6) AS precision_macro, round(avg(hit / truth), 6) AS recall_macro FROM m"""
)
def a15_metrics(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents"), "doc_id")
    return profile.classification_metrics(rows, F.col("quality"), (F.col("n_chars") > 600).cast("int"))


@query(
    """WITH h AS (SELECT o_custkey, o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS own FROM orders),
c AS (SELECT *, CASE WHEN o_orderkey % 97 = 0 THEN 'x' ELSE coalesce(lag(own) OVER w, repeat('0', 64)) END AS prev FROM h WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_orderkey, prev = coalesce(lag(own) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), repeat('0', 64)) AS link_ok FROM c"""
)
def w4_chain_verify(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("own"))
    before = F.lag("own", 1, custody.GENESIS).over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    chain = rows.withColumn("prev", F.when(F.col("o_orderkey") % 97 == 0, "x").otherwise(before))
    return custody.broken_links(chain, "o_custkey", "o_orderkey", "prev", "own").select("o_orderkey", "link_ok")


@query("SELECT CAST(o_custkey AS VARCHAR) AS case_id, sha256(CAST(max(o_orderkey) AS VARCHAR)) AS record_hash, max(o_orderkey) AS idx FROM orders GROUP BY o_custkey")
def w5_last_link(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("case_id"), F.col("o_orderkey").alias("idx"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("record_hash"))
    return custody.last_links(rows)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def o3_top1(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1)


_ORDER = "md5('42:' || CAST(event_id AS VARCHAR)), event_id"


@query(f"SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {_ORDER}) <= 50")
def w7_class_cap(spark, sf_dir):
    return sample.class_cap(_t(spark, sf_dir, "events"), "event_type", "event_id", 50).select("event_id", "event_type")


@query(
    f"""WITH r AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'Normal' ELSE event_type END AS category FROM events),
q AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY category ORDER BY {_ORDER}) <= CASE WHEN category = 'Normal' THEN 120 ELSE 40 END)
SELECT event_id, category FROM q ORDER BY {_ORDER} LIMIT 200"""
)
def m1_stratified_quota(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "Normal").otherwise(F.col("event_type")).alias("category"))
    return sample.stratified_quota(rows, "category", "event_id", sample.Quotas(train_total=200, train_normal=120, train_attack=40))


@query(f"SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_ORDER}) <= round(count(*) OVER (PARTITION BY event_type) * 0.2) AS is_test FROM events")
def m6_stratified_split(spark, sf_dir):
    return sample.stratified_split(_t(spark, sf_dir, "events"), "event_type", "event_id").select("event_id", "event_type", "is_test")


_NOISY = ["Benign", " normal ", "FTP-Patator", "Port Scan", "DDOS", "DoS Hulk", "web attack – xss", "bot", ""]


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*[F.lit(x) for x in _NOISY]), (F.col("event_id") % len(_NOISY) + 1).cast("int")).alias("raw"))


_NOISY_SQL = f"n AS (SELECT event_id, {_NOISY}[event_id % {len(_NOISY)} + 1] AS raw FROM events)"


@query(
    f"""WITH {_NOISY_SQL}, c AS (SELECT event_id, CASE lower(trim(raw)) WHEN 'benign' THEN 'Normal' WHEN 'normal' THEN 'Normal' WHEN '' THEN 'Normal' WHEN 'ftp-patator' THEN 'BruteForce'
  WHEN 'port scan' THEN 'PortScan' WHEN 'ddos' THEN 'DDoS' WHEN 'dos hulk' THEN 'DoS' WHEN 'web attack – xss' THEN 'Web Attack – Xss' ELSE 'Bot' END AS category FROM n)
SELECT event_id, category, CAST(category <> 'Normal' AS INTEGER) AS label FROM c"""
)
def n3_n4_label_normalize(spark, sf_dir):
    found = _noisy(spark, sf_dir).select("event_id", clean.label_cicids(F.col("raw")).alias("category"))
    return found.withColumn("label", clean.label_bit(F.col("category")))


@query(f"WITH {_NOISY_SQL} SELECT event_id, CASE WHEN trim(raw) IN ('Benign', '', 'normal') THEN 'Normal' WHEN trim(raw) = 'Port Scan' THEN 'PortScan' ELSE trim(raw) END AS category FROM n")
def n1_label_normalize(spark, sf_dir):
    return _noisy(spark, sf_dir).select("event_id", clean.label_unsw(F.col("raw")).alias("category"))


_CLASSES = ["Normal", "Worms", "DoS", "Heartbleed", "Fuzzers"]


@query(f"SELECT event_id, CASE WHEN c IN ('Worms', 'Heartbleed') THEN 'Generic' ELSE c END AS category FROM (SELECT event_id, {_CLASSES}[event_id % 5 + 1] AS c FROM events)")
def p26_collapse(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(x) for x in _CLASSES]), (F.col("event_id") % 5 + 1).cast("int"))
    return _t(spark, sf_dir, "events").select("event_id", clean.scenario_category(name).alias("category"))


@query(f"SELECT event_id, {_CLASSES}[event_id % 5 + 1] AS category FROM events")
def p3_taxonomy(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(f" {x} ") for x in _CLASSES]), (F.col("event_id") % 5 + 1).cast("int"))
    return _t(spark, sf_dir, "events").select("event_id", taxonomy(name).alias("category"))


@query(
    """SELECT p_partkey, CASE p_size % 5 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 3 ELSE 1 END AS eve,
  CASE WHEN p_size % 12 <= 0 THEN 1 WHEN p_size % 12 <= 3 THEN 2 WHEN p_size % 12 <= 5 THEN 3 WHEN p_size % 12 <= 7 THEN 4 WHEN p_size % 12 <= 8 THEN 5 ELSE 6 END AS cef FROM part"""
)
def p7_p9_severity(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", eve_severity(F.col("p_size") % 5).alias("eve"), cef_severity((F.col("p_size") % 12).cast("string")).alias("cef"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS src, event_type AS cat, 'a ' || event_type || ' of ' || CAST(user_id AS VARCHAR) AS msg, CAST(date_trunc('second', ts) AS TIMESTAMP) AS at FROM events")
def p8_p10_cef_round_trip(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    user = F.col("user_id").cast("string")
    line = F.concat(F.lit("<134>"), F.date_format(ts, "MMM dd yyyy HH:mm:ss"), F.lit(" host CEF:0|vendor|a\\|b|1|7|name|5|src="), user, F.lit(" src="), user, F.lit(" cat="), "event_type", F.lit(" msg=a "), "event_type", F.lit(" of "), user)
    parsed = _t(spark, sf_dir, "events").select("event_id", parse_cef(line).alias("c"))
    ext = lambda k: F.try_element_at(F.col("c.extension"), F.lit(k)).alias(k)
    return parsed.select("event_id", ext("src"), ext("cat"), ext("msg"), syslog_time(F.col("c.syslog_prefix")).cast("timestamp_ntz").alias("at"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def p5_json_extract(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN 0.0 ELSE l_quantity END AS quantity, CASE WHEN l_orderkey % 5 = 0 THEN 0.0 ELSE l_tax END AS tax, 0.0::DOUBLE AS absent FROM lineitem")
def p14_p15_feature_matrix(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem")
    quantity = F.when(F.col("l_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    tax = F.when(F.col("l_orderkey") % 5 != 0, F.col("l_tax"))
    held = F.map_filter(F.create_map(F.lit("quantity"), quantity, F.lit("tax"), tax), lambda _, v: v.isNotNull())
    rows = rows.select("l_orderkey", "l_linenumber", F.transform_values(held, lambda _, v: finite(v)).alias("f"))
    return rows.select("l_orderkey", "l_linenumber", *[F.coalesce(F.try_element_at("f", F.lit(n)), F.lit(0.0)).alias(n) for n in ("quantity", "tax", "absent")])


@query("SELECT event_id FROM events WHERE event_id % 7 <> 0 AND ts IS NOT NULL")
def p21_dropna(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("source", F.when(F.col("event_id") % 7 != 0, F.col("user_id")))
    return rows.na.drop(subset=["source", "ts"]).select("event_id")


@query("WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS b FROM customer) SELECT c_custkey, coalesce(b, (SELECT median(b) FROM c)) AS balance FROM c")
def n6_impute(spark, sf_dir):
    held = F.when(F.col("c_custkey") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("c_acctbal"))
    return clean.impute_median(_t(spark, sf_dir, "customer").select("c_custkey", held.alias("balance")), ["balance"])


@query(
    """SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 0.001) FROM lineitem)), (SELECT quantile_cont(l_extendedprice, 0.999) FROM lineitem)), 6) AS price FROM lineitem"""
)
def n7_winsorize(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return clean.winsorize(rows, ["price"]).withColumn("price", F.round("price", 6))


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def u1_union_by_name(spark, sf_dir):
    one = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return one.unionByName(_t(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id")), allowMissingColumns=True)


@query("SELECT DISTINCT p_brand || '/' || p_size AS label FROM part EXCEPT SELECT 'Brand#1' || l_linenumber || '/' || CAST(l_quantity AS BIGINT) FROM lineitem")
def u4_label_difference(spark, sf_dir):
    have = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("Brand#1"), F.col("l_linenumber").cast("string"), F.lit("/"), F.col("l_quantity").cast("long").cast("string")).alias("label"))
    return _t(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("label")).distinct().join(have, "label", "left_anti")


@query(
    """SELECT n_regionkey, sha256(string_agg(h, '' ORDER BY n_nationkey)) AS digest, count(*) AS n
FROM (SELECT n_regionkey, n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}') AS h FROM nation) GROUP BY 1"""
)
def c3_digest(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", custody.row_hash(F.col("n_nationkey"), F.col("n_name")).alias("h"))
    folded = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "h"))), lambda r: r.h), "")
    return rows.groupBy("n_regionkey").agg(F.sha2(folded, 256).alias("digest"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT upper(digest) AS digest, n FROM (SELECT sha256(sha256(sha256(string_agg(h, '' ORDER BY n_nationkey)))) AS digest, count(*) AS n
FROM (SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}') AS h FROM nation))"""
)
def c3_table_digest(spark, sf_dir):
    """The digest of a whole table: its rows are one block, folded twice, and the root hashed."""
    digest, n = custody.table_digest(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return spark.createDataFrame([(digest.upper(), n)], "digest string, n long")


_FOLD = "SELECT {level} AS level, number // 16 AS number, sha256(string_agg(h, '' ORDER BY number)) AS h, CAST(sum(n) AS BIGINT) AS n FROM l{below} GROUP BY number // 16"


@query(
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, sha256('{{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey || ',"l_returnflag":"' || l_returnflag || '"}}') AS h FROM lineitem),
l0 AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, h) - 1 AS number, h, 1 AS n FROM r),
l1 AS ({_FOLD.format(level=1, below=0)}), l2 AS ({_FOLD.format(level=2, below=1)}), l3 AS ({_FOLD.format(level=3, below=2)})
SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3"""
)
def c3_merkle_levels(spark, sf_dir):
    """All nodes of the first three levels above the rows of a tree over line items, in blocks of 16."""
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    found = merkle.tree(rows, ["l_orderkey", "l_linenumber"], block=16)
    one, two = found.levels[1], found.levels[2]
    three = merkle.folded(two, 16)
    nodes = [x.select(F.lit(level).alias("level"), "number", "h", "n") for level, x in enumerate((one, two, three), 1)]
    return nodes[0].unionByName(nodes[1]).unionByName(nodes[2])


_FLOW_CSV = ["protocol", "flow_duration", "total_fwd_packets", "total_backward_packets", "total_length_of_fwd_packets", "total_length_of_bwd_packets"]


def _flow_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rows of a flow CSV: text columns, some of them empty."""
    rows = _t(spark, sf_dir, "lineitem")
    values = ["l_linenumber", "l_quantity", "l_suppkey", "l_partkey", "l_extendedprice", "l_orderkey"]
    text = [F.when(F.col("l_orderkey") % (7 + i) != 0, F.col(v).cast("decimal(18,2)").cast("string")).alias(n) for i, (n, v) in enumerate(zip(_FLOW_CSV, values))]
    category = F.when(F.col("l_returnflag") == "N", "Normal").when(F.col("l_returnflag") == "R", " DoS ").otherwise("PortScan")
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return rows.select(seq.alias("seq"), category.alias("attack_cat"), F.when(category == "Normal", "0").otherwise("1").alias("label"), *text, F.col("l_tax").cast("decimal(5,2)").cast("string").alias("tax"), F.col("l_linestatus").alias("status"))


_FLOW_SQL = """f AS (SELECT l_orderkey * 10 + l_linenumber AS seq, CASE l_returnflag WHEN 'N' THEN 'Normal' WHEN 'R' THEN 'DoS' ELSE 'PortScan' END AS category,
  CASE WHEN l_orderkey % 7 <> 0 THEN CAST(CAST(l_linenumber AS DECIMAL(18,2)) AS VARCHAR) END AS protocol_raw, CASE WHEN l_orderkey % 8 <> 0 THEN round(l_quantity, 2) END AS duration,
  CASE WHEN l_orderkey % 9 <> 0 THEN CAST(l_suppkey AS DOUBLE) END AS packets_out, CASE WHEN l_orderkey % 10 <> 0 THEN CAST(l_partkey AS DOUBLE) END AS packets_in,
  CASE WHEN l_orderkey % 11 <> 0 THEN round(l_extendedprice, 2) END AS bytes_out, CASE WHEN l_orderkey % 12 <> 0 THEN CAST(l_orderkey AS DOUBLE) END AS bytes_in,
  round(l_tax, 2) AS tax, l_linestatus AS status FROM lineitem)"""


@query(f"WITH {_FLOW_SQL} SELECT seq, CASE WHEN category = 'Normal' THEN 1 ELSE 3 END AS severity_id, category, CAST(category <> 'Normal' AS INTEGER) AS label, protocol_raw, duration, packets_out, packets_in, bytes_out, bytes_in, tax, status FROM f")
def p1_flow_events(spark, sf_dir):
    events = normalize.flow_events(_flow_csv(spark, sf_dir), "cicids2017")
    return events.select(
        "seq", "severity_id", F.col("unmapped.attack_cat").alias("category"), "unmapped.label", "connection_info.protocol_raw", "connection_info.duration", "traffic.*",
        F.try_element_at("unmapped.raw_flow_features", F.lit("tax")).alias("tax"), F.try_element_at("unmapped.raw_text_fields", F.lit("status")).alias("status"),
    )


@query(
    """WITH d AS (SELECT p_partkey AS no, lower('Col_' || p_partkey || '_' || p_brand) AS name FROM part WHERE p_partkey BETWEEN 1 AND 3)
SELECT name, count(v) AS n, round(sum(v), 2) AS total FROM d JOIN (SELECT unnest([1, 2, 3]) AS no, unnest([CAST(l_orderkey % 1000 AS DOUBLE), CASE WHEN l_orderkey % 7 <> 0 THEN round(l_extendedprice, 2) END, NULL]) AS v FROM lineitem) USING (no) GROUP BY name"""
)
def s16_j4_dictionary(spark, sf_dir):
    """Line items as a file without a header, bound to names and types that a dictionary made from parts gives; the third column holds no numbers."""
    folder = f"{shared_dir(spark)}/headerless-{uuid.uuid4().hex}"
    values = F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).otherwise("-")
    _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).cast("string").alias("a"), values.alias("b"), F.lit("none").alias("c")).write.csv(folder)
    kind = F.when(F.col("p_partkey") == 1, "Integer").when(F.col("p_partkey") == 2, "Float").otherwise("binary")
    dictionary = _t(spark, sf_dir, "part").where("p_partkey BETWEEN 1 AND 3").select(F.col("p_partkey").alias("no"), F.concat(F.lit("Col "), F.col("p_partkey").cast("string"), F.lit(" "), "p_brand").alias("name"), kind.alias("type"))
    bound = files.bind_dictionary(spark, folder, dictionary)
    held = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("v")) for c in bound.columns[1:]]))
    return bound.select(held.alias("e")).groupBy("e.name").agg(F.count("e.v").alias("n"), F.round(F.sum("e.v"), 2).alias("total"))


_MATRIX = ("bytes_in", "bytes_out", "duration", "packets_in", "packets_out", "protocol_raw", "tax", "absent")


@query(f"WITH {_FLOW_SQL} SELECT seq, " + ", ".join(f"coalesce(CAST({n} AS DOUBLE), 0.0) AS {n}" for n in _MATRIX[:-1]) + ", 0.0::DOUBLE AS absent FROM f")
def p14_p15_operator_matrix(spark, sf_dir):
    events = normalize.flow_events(_flow_csv(spark, sf_dir), "cicids2017")
    return matrix.feature_matrix(events, list(_MATRIX)).select("seq", *_MATRIX)


@query(
    f"WITH {_FLOW_SQL}, n AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature FROM f WHERE {n} IS NOT NULL" for n in _MATRIX[:-1])
    + ") SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS at FROM (SELECT DISTINCT feature FROM n)"
)
def o2_feature_names(spark, sf_dir):
    names = matrix.feature_names(normalize.flow_events(_flow_csv(spark, sf_dir), "cicids2017"))
    return spark.createDataFrame(list(zip(names, range(len(names)))), "feature string, at long")


@query(f"WITH {_FLOW_SQL} SELECT seq, CAST(category <> 'Normal' AS INTEGER) AS label FROM f")
def p16_label_of(spark, sf_dir):
    return normalize.flow_events(_flow_csv(spark, sf_dir), "cicids2017").select("seq", matrix.label_of().alias("label"))


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON records of a detection system; purchases are flows, which are no alerts."""
    rows = _t(spark, sf_dir, "events")
    alert = F.struct(F.col("event_type").alias("signature"), F.col("event_id").alias("signature_id"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("cat "), "event_type")).otherwise("").alias("category"), (F.col("event_id") % 5).alias("severity"), F.lit("blocked").alias("action"), (F.col("event_id") % 3).alias("gid"), (F.col("event_id") % 7).alias("rev"))
    flow = F.struct((F.col("event_id") % 9).alias("pkts_toserver"), (F.col("event_id") % 1000).alias("bytes_toserver"))
    record = F.struct(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0000'").alias("timestamp"), F.when(F.col("event_type") == "purchase", "flow").otherwise("alert").alias("event_type"),
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("src_ip"), (F.col("event_id") % 65536).alias("src_port"), F.lit("10.1.1.1").alias("dest_ip"), F.lit(443).alias("dest_port"), F.lit("TCP").alias("proto"), (F.col("event_id") * 1000).alias("flow_id"), alert.alias("alert"), flow.alias("flow"),
    )
    return rows.select(F.col("event_id").alias("seq"), F.try_parse_json(F.to_json(record)).alias("raw"))


@query(
    """SELECT event_id AS seq, CASE event_id % 5 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 3 ELSE 1 END AS severity_id, epoch_us(ts) AS event_us, '10.0.0.' || user_id AS src_ip, CAST(event_id % 65536 AS VARCHAR) AS src_port,
  '443' AS dst_port, event_type AS title, CAST(event_id AS VARCHAR) AS uid, CASE WHEN event_id % 4 <> 0 THEN 'cat ' || event_type ELSE '' END AS types, CAST(event_id % 9 AS DOUBLE) AS packets_out, CAST(NULL AS DOUBLE) AS packets_in,
  CAST(event_id * 1000 AS VARCHAR) AS flow_id, 'blocked' AS action, CAST(event_id % 3 AS VARCHAR) AS gid, CAST(event_id % 7 AS VARCHAR) AS rev,
  '{"alert":{"action":"blocked","category":"' || CASE WHEN event_id % 4 <> 0 THEN 'cat ' || event_type ELSE '' END || '","gid":' || event_id % 3 || ',"rev":' || event_id % 7 || ',"severity":' || event_id % 5 || ',"signature":"' || event_type || '","signature_id":' || event_id
  || '},"dest_ip":"10.1.1.1","dest_port":443,"event_type":"alert","flow":{"bytes_toserver":' || event_id % 1000 || ',"pkts_toserver":' || event_id % 9 || '},"flow_id":' || event_id * 1000 || ',"proto":"TCP","src_ip":"10.0.0.' || user_id || '","src_port":' || event_id % 65536
  || ',"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+0000"}' AS raw_event
FROM events WHERE event_type <> 'purchase'"""
)
def p5_p6_eve_events(spark, sf_dir):
    events = normalize.eve_events(_alerts(spark, sf_dir))
    return events.select("seq", "severity_id", "event_us", F.col("src_endpoint.ip").alias("src_ip"), F.col("src_endpoint.port").alias("src_port"), F.col("dst_endpoint.port").alias("dst_port"), "finding_info.title", "finding_info.uid", F.array_join("finding_info.types", ",").alias("types"), "traffic.packets_out", "traffic.packets_in", *[f"unmapped.{c}" for c in ("flow_id", "action", "gid", "rev", "raw_event")])


@query(
    """SELECT event_id AS seq, CASE event_id % 11 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 3 WHEN 6 THEN 4 WHEN 7 THEN 4 WHEN 8 THEN 5 ELSE 6 END AS severity_id,
  CAST(user_id AS VARCHAR) AS src_ip, CAST(event_id % 100 AS VARCHAR) AS src_port, event_type AS types, epoch_us(date_trunc('second', ts)) AS event_us, '0' AS cef_version, '1' AS device_version, '<134>' || strftime(ts, '%b %d %Y %H:%M:%S') || ' fw' AS syslog_prefix FROM events WHERE event_id % 6 <> 0"""
)
def p11_p12_cef_events(spark, sf_dir):
    """Lines that do not parse are left out."""
    ts = F.col("ts").cast("timestamp")
    line = F.concat(F.lit("<134>"), F.date_format(ts, "MMM dd yyyy HH:mm:ss"), F.lit(" fw CEF:0|v|p|1|7|name|"), (F.col("event_id") % 11).cast("string"), F.lit("|src="), F.col("user_id").cast("string"), F.lit(" spt="), (F.col("event_id") % 100).cast("string"), F.lit(" cat="), "event_type")
    rows = _t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 6 != 0, line).otherwise("no such line").alias("raw_line"))
    events = normalize.cef_events(rows)
    return events.select("seq", "severity_id", F.col("src_endpoint.ip").alias("src_ip"), F.col("src_endpoint.port").alias("src_port"), F.array_join("finding_info.types", ",").alias("types"), "event_us", "unmapped.cef_version", "unmapped.device_version", "unmapped.syslog_prefix")


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets of two captures: a user's talk with one of five hosts, in both directions."""
    rows = _events(spark, sf_dir)
    out = F.col("event_id") % 3 != 0
    user, host = F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")), F.concat(F.lit("9.9.9."), (F.col("user_id") % 5).cast("string"))
    port, service = (F.col("user_id") + 1000).cast("int"), F.lit(53)
    return rows.select(
        F.when(F.col("event_id") % 2 == 0, "a.pcap").otherwise("b.pcap").alias("path"), F.col("event_id").alias("ordinal"), (F.col("us") / 1_000_000).alias("ts"),
        F.when(out, user).otherwise(host).alias("src_ip"), F.when(out, host).otherwise(user).alias("dst_ip"), F.when(out, port).otherwise(service).alias("src_port"), F.when(out, service).otherwise(port).alias("dst_port"),
        F.when(F.col("event_type") == "click", "UDP").otherwise("TCP").alias("protocol"), (F.col("event_id") % 1400 + 60).cast("int").alias("length"),
    )


@query(
    f"""WITH {_EVENTS}, p AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'a.pcap' ELSE 'b.pcap' END AS path, event_id, us, user_id, event_id % 3 <> 0 AS away, CASE WHEN event_type = 'click' THEN 'UDP' ELSE 'TCP' END AS protocol, event_id % 1400 + 60 AS length FROM e),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w > {21_600 * 1_000_000} THEN 1 ELSE 0 END AS late FROM p WINDOW w AS (PARTITION BY path, user_id, protocol ORDER BY event_id)),
f AS (SELECT *, CAST(sum(late) OVER (PARTITION BY path, user_id, protocol ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS flow_no FROM g),
s AS (SELECT *, first_value(away) OVER (PARTITION BY path, user_id, protocol, flow_no ORDER BY event_id) AS leads FROM f)
SELECT path, CASE WHEN any_value(leads) THEN '10.0.0.' || user_id ELSE '9.9.9.' || (user_id % 5) END AS src_ip, protocol, flow_no, count(*) FILTER (away = leads) AS packets_out, count(*) FILTER (away <> leads) AS packets_in,
  CAST(coalesce(sum(length) FILTER (away = leads), 0) AS BIGINT) AS bytes_out, CAST(coalesce(sum(length) FILTER (away <> leads), 0) AS BIGINT) AS bytes_in, round((arg_max(us, event_id) - arg_min(us, event_id)) / 1e6, 6) AS duration
FROM s GROUP BY path, user_id, protocol, flow_no"""
)
def a1_packet_flows(spark, sf_dir):
    found = flows.packet_flows(_packets(spark, sf_dir), flow_timeout=21_600)
    return found.select("seq.path", "src_ip", "protocol", "seq.flow_no", "packets_out", "packets_in", "bytes_out", "bytes_in", "duration")


@query(
    f"""WITH {_EVENTS} SELECT 'c' || event_id % 4 AS capture, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1 AS ordinal, us, '10.0.' || user_id // 256 % 256 || '.' || user_id % 256 AS src_ip, '9.9.9.' || user_id % 5 AS dst_ip,
  CAST(user_id % 60000 + 1000 AS INTEGER) AS src_port, 53 AS dst_port, CASE WHEN event_type = 'click' THEN 'UDP' ELSE 'TCP' END AS protocol, CAST(event_id % 1400 + 60 AS INTEGER) AS length FROM e"""
)
def s5_s6_capture_ranges(spark, sf_dir):
    """Events written as the packets of four captures, which are read by ranges of 64 KB."""
    rows = _events(spark, sf_dir)
    host = F.concat(F.lit("10.0."), (F.floor(F.col("user_id") / 256) % 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"))
    packets = rows.select(
        F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string")).alias("capture"), F.col("event_id").alias("ordinal"), "us", host.alias("src_ip"), F.concat(F.lit("9.9.9."), (F.col("user_id") % 5).cast("string")).alias("dst_ip"),
        (F.col("user_id") % 60000 + 1000).cast("int").alias("src_port"), F.lit(53).alias("dst_port"), F.when(F.col("event_type") == "click", "UDP").otherwise("TCP").alias("protocol"), (F.col("event_id") % 1400 + 60).cast("int").alias("length"),
    )
    folder = f"{shared_dir(spark)}/captures-{uuid.uuid4().hex}"
    pcap.write_captures(packets, folder)
    found = pcap.read_packets(spark, folder, range_bytes=1 << 16)
    return found.select(F.regexp_extract("path", r"(c\d)\.pcap$", 1).alias("capture"), "ordinal", F.round(F.col("ts") * 1_000_000).cast("long").alias("us"), "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length")


@query(
    f"""WITH {_EVENTS}, p AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'a.pcap' ELSE 'b.pcap' END AS path, event_id, us, user_id, event_id % 3 <> 0 AS away, CASE WHEN event_type = 'click' THEN 'UDP' ELSE 'TCP' END AS protocol FROM e),
s AS (SELECT path, user_id, protocol, min(event_id) AS first, arg_min(away, event_id) AS leads, arg_min(us, event_id) AS us, count(*) AS n, count(*) FILTER (away) AS n_away FROM p GROUP BY ALL)
SELECT row_number() OVER (ORDER BY path, first) - 1 AS at, CASE WHEN leads THEN '10.0.0.' || user_id ELSE '9.9.9.' || (user_id % 5) END AS src_ip, CASE WHEN leads THEN CAST(user_id + 1000 AS VARCHAR) ELSE '53' END AS src_port,
  CASE WHEN leads THEN '9.9.9.' || (user_id % 5) ELSE '10.0.0.' || user_id END AS dst_ip, CAST(NULL AS VARCHAR) AS dst_port, protocol, us AS event_us, CAST(CASE WHEN leads THEN n_away ELSE n - n_away END AS DOUBLE) AS packets_out, 4001 AS class_uid FROM s"""
)
def p13_packet_flow_events(spark, sf_dir):
    """With a timeout beyond all silences every key of a capture is one flow; events are numbered in order of capture and first packet."""
    events = normalize.packet_flow_events(flows.packet_flows(_packets(spark, sf_dir), flow_timeout=1e9))
    told = events.select("seq", "src_endpoint.ip", "src_endpoint.port", F.col("dst_endpoint.ip").alias("dst_ip"), F.col("dst_endpoint.port").alias("dst_port"), F.col("connection_info.protocol_raw").alias("protocol"), "event_us", "traffic.packets_out", "class_uid")
    placed = scan.numbered(scan.ranges(told, [], ["seq"]), ["seq"], "at")
    return placed.select("at", F.col("ip").alias("src_ip"), F.col("port").alias("src_port"), "dst_ip", "dst_port", "protocol", "event_us", "packets_out", "class_uid")


@query("SELECT event_id, epoch_us(ts) AS iso, epoch_us(date_trunc('second', ts)) AS epoch, epoch_us(date_trunc('minute', ts)) // 1000000 AS day_first FROM events")
def p17_f7_times(spark, sf_dir):
    """One time in three spellings: ISO, epoch seconds, day first."""
    ts = F.col("ts").cast("timestamp")
    iso, day = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.date_format(ts, "d/M/yyyy H:mm")
    return _t(spark, sf_dir, "events").select("event_id", event_time(F.lit(""), iso).alias("iso"), event_time(F.unix_seconds(ts).cast("string")).alias("epoch"), day_first_seconds(day).alias("day_first"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'Tráfico normal' WHEN 2 THEN 'Actividad potencialmente maliciosa' ELSE 'Desconocido' END AS category FROM events")
def p19_finding_category(spark, sf_dir):
    kind = F.col("event_id") % 4
    named = F.when(kind == 0, F.col("event_type")).when(kind == 1, "")
    return _t(spark, sf_dir, "events").select("event_id", report.finding_category(named, F.when(kind == 1, 0).when(kind == 2, 1).otherwise(F.when(kind == 0, 7))).alias("category"))


_CAPTURED = ["unknown", "port scan", " worm", "Backdoor", "Bruteforce", "reconnaissance", "BENIGN", "Mirai"]


@query(
    f"""SELECT event_id, CASE trim({_CAPTURED}[event_id % {len(_CAPTURED)} + 1]) WHEN 'unknown' THEN 'Generic' WHEN 'port scan' THEN 'PortScan' WHEN 'worm' THEN 'Worms' WHEN 'Bruteforce' THEN 'BruteForce'
  WHEN 'reconnaissance' THEN 'Reconnaissance' WHEN 'BENIGN' THEN 'Normal' ELSE trim({_CAPTURED}[event_id % {len(_CAPTURED)} + 1]) END AS category,
  CASE trim({_CAPTURED}[event_id % {len(_CAPTURED)} + 1]) WHEN 'worm' THEN 'Worms' WHEN 'Backdoor' THEN 'Backdoors' WHEN 'reconnaissance' THEN 'Reconnaissance' WHEN 'BENIGN' THEN 'Normal' ELSE trim({_CAPTURED}[event_id % {len(_CAPTURED)} + 1]) END AS other FROM events"""
)
def n2_label_normalize(spark, sf_dir):
    """Spellings that this data set and the other one read differently."""
    raw = F.element_at(F.array(*[F.lit(x) for x in _CAPTURED]), (F.col("event_id") % len(_CAPTURED) + 1).cast("int"))
    return _t(spark, sf_dir, "events").select("event_id", clean.label_kitsune(raw).alias("category"), clean.label_unsw(raw).alias("other"))


@query("SELECT doc_id, CASE WHEN toxic = 0 THEN 'Normal' ELSE 'Generic' END AS category FROM labels")
def n11_fallback_category(spark, sf_dir):
    return _t(spark, sf_dir, "labels").select("doc_id", clean.fallback_category(F.col("toxic")).alias("category"))


@query(
    """WITH c AS (SELECT *, CASE WHEN c_custkey % 9 = 0 THEN 'Infinity' ELSE '1.5' END AS rate, 0 AS zero, c_custkey % 2 AS half FROM customer)
SELECT 'attack_class' AS name, TRUE AS kept, TRUE AS is_label, count(DISTINCT c_mktsegment) AS n FROM c UNION ALL SELECT 'rate', NOT bool_or(contains(rate, 'Infinity')), FALSE, count(DISTINCT rate) FROM c
UNION ALL SELECT 'zero', count(DISTINCT zero) > 1, FALSE, count(DISTINCT zero) FROM c UNION ALL SELECT 'half', count(DISTINCT half) > 1, FALSE, count(DISTINCT half) FROM c UNION ALL SELECT 'none', FALSE, FALSE, 0"""
)
def n8_n9_n10_columns(spark, sf_dir):
    """Per column whether it is kept (not if it holds Infinity or one value) and is the label, and its distinct values."""
    key = F.col("c_custkey")
    rows = _t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("Attack Class"), F.when(key % 9 == 0, "Infinity").otherwise("1.5").alias("rate"), F.lit(0).alias("zero"), (key % 2).alias("half"), F.lit(None).cast("double").alias("none"))
    kept = clean.drop_constant(clean.drop_containing(rows)).columns
    label = clean.find_label_column(kept)
    counts = rows.agg(*[F.count_distinct(f"`{c}`").alias(c) for c in rows.columns])
    told = [F.struct(F.lit(snake_case(c)).alias("name"), F.lit(c in kept).alias("kept"), F.lit(snake_case(c) == label).alias("is_label"), F.col(f"`{c}`").alias("n")) for c in rows.columns]
    return counts.select(F.explode(F.array(*told)).alias("e")).select("e.*")


@query(
    """SELECT o_orderkey, CASE WHEN CAST('0x' || md5('42:o_totalprice:' || o_orderkey)[1:8] AS UBIGINT) / 4294967296 >= 0.2 THEN o_totalprice END AS o_totalprice,
  CASE WHEN CAST('0x' || md5('42:o_custkey:' || o_orderkey)[1:8] AS UBIGINT) / 4294967296 >= 0.2 THEN o_custkey END AS o_custkey FROM orders"""
)
def n12_inject_missing(spark, sf_dir):
    """A fifth of the values of two columns goes, row by row as the hash of column and key says."""
    return clean.inject_missing(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), ["o_totalprice", "o_custkey"], 0.2, "o_orderkey")


@query("SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS at FROM supplier")
def o1_sorted(spark, sf_dir):
    """A stable sort: equal values keep the order of their keys. Places count on within and between the ranges of the sort."""
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    order = ["s_acctbal", "s_suppkey"]
    return scan.numbered(scan.ranges(rows, [], order), order, "at").select("s_suppkey", "s_acctbal", "at")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > l_discount THEN 'tax' WHEN l_tax < l_discount THEN 'discount' ELSE 'discount' END AS top FROM lineitem")
def o7_ranked_probabilities(spark, sf_dir):
    held = F.create_map(F.lit("tax"), F.col("l_tax"), F.lit("discount"), F.col("l_discount"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.get(report.ranked(held), F.lit(0))["key"].alias("top"))


@query("SELECT count(*) FILTER ((CAST(l_suppkey AS VARCHAR), l_linenumber) <= (CAST(l_partkey AS VARCHAR), 3)) AS n FROM lineitem")
def f17_in_order(spark, sf_dir):
    one = F.struct(F.col("l_suppkey").cast("string").alias("ip"), F.col("l_linenumber").cast("int").alias("port"))
    other = F.struct(F.col("l_partkey").cast("string").alias("ip"), F.lit(3).alias("port"))
    return _t(spark, sf_dir, "lineitem").agg(F.count_if(in_order(one, other)).alias("n"))


@query(
    """WITH s AS (SELECT event_type AS category, CAST(user_id AS VARCHAR) AS ip FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ip) AS place, count(*) OVER (PARTITION BY category) AS n_src_ips FROM s)
SELECT category, any_value(n_src_ips) AS n_src_ips, string_agg(ip, ',' ORDER BY ip) AS src_ips, (SELECT count(*) FROM events e WHERE e.event_type = category) AS n, (SELECT min(event_id) FROM events e WHERE e.event_type = category) AS first_seq FROM r WHERE place <= 5 GROUP BY category"""
)
def a5_k7_case_blocks(spark, sf_dir):
    found = report.case_blocks(_findings(spark, sf_dir))
    return found.select("category", "n_src_ips", F.array_join("src_ips", ",").alias("src_ips"), "n", "first_seq")


_SCENARIO_SQL = f"""e AS (SELECT event_id, event_type, user_id, epoch_us(date_trunc('minute', ts)) AS us FROM events),
a AS (SELECT a.event_id, any_value(a.event_type) AS category, count(DISTINCT b.event_id % 13) AS ports, count(DISTINCT b.event_type) AS hosts, count(*) AS n, round(count(*) / greatest((any_value(a.us) - min(b.us)) / 1e6, 1.0), 6) AS rate
  FROM e a JOIN e b ON a.user_id = b.user_id AND b.us >= a.us - {DAY * 1_000_000} AND (b.us < a.us OR (b.us = a.us AND b.event_id <= a.event_id)) GROUP BY a.event_id)"""


@query(
    f"""WITH {_SCENARIO_SQL} SELECT event_id, CASE WHEN category = 'view' THEN 'Normal' ELSE 'DoS' END AS attack_cat, CASE WHEN category = 'view' THEN 0 ELSE 1 END AS label, 0.5::DOUBLE AS duration, CAST(event_id % 3 AS DOUBLE) AS packets_in, 0.0::DOUBLE AS packets_out,
  hosts AS agg_distinct_dst_hosts, ports AS agg_distinct_dst_ports, n AS agg_events_in_window, rate AS agg_events_per_second FROM a"""
)
def p23_p25_scenario_features(spark, sf_dir):
    """Events as rows of a flow data set with day-first times; a packet count that is no number counts as 0."""
    view = F.col("event_type") == "view"
    raw = _t(spark, sf_dir, "events").select(
        "event_id", F.when(view, "Normal").otherwise("DoS").alias("attack_cat"), F.when(view, 0).otherwise(1).alias("label"), F.col("user_id").cast("string").alias("source_ip"), F.col("event_type").alias("destination_ip"),
        (F.col("event_id") % 13).cast("string").alias("destination_port"), F.date_format(F.col("ts").cast("timestamp"), "d/M/yyyy H:mm").alias("timestamp"), F.lit("0.5").alias("flow_duration"), F.lit("n/a").alias("total_fwd_packets"), (F.col("event_id") % 3).cast("string").alias("total_backward_packets"),
    )
    return jobs.scenario_features(raw, jobs.SCENARIO_SOURCES["cicids"], "event_id", day_first=True, seconds=DAY)


@query()
def m6_m9_train_and_score(spark, sf_dir):
    """Trains a forest on all components of four fifths of the labelled vectors and scores every vector: label, probability and explained features.

    Components that are missing or not finite count as zero.
    """
    from tracelake.operators import model

    vectors = _t(spark, sf_dir, "embeddings")
    names = [f"x{i}" for i in range(vectors.agg(F.max(F.size("embedding"))).first()[0])]
    components = [F.coalesce(finite(F.get("embedding", F.lit(i)).cast("double")), F.lit(0.0)).alias(n) for i, n in enumerate(names)]
    rows = vectors.select("vec_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"), *components)
    trained = model.train(rows.where("category IS NOT NULL"), names, "category", "vec_id", trees=10, depth=4)
    folder = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    model.certify(spark, trained, folder, "v1")
    found = model.FrozenClassifier(spark, folder, "v1")
    scored = found.explain(found.predict(rows), 3)
    return scored.select("vec_id", "prediction.attack_cat", F.round("prediction.probability", 4).alias("probability"), F.size("top_features").alias("n_features"))


#: What a language's spelling looks like: counts of these in a text, per 100 characters.
_MARKS = ("th", "ch", "qu", "en", "os", "é", "ñ", "ß", "ung", "ing")


@query()
def m6_m10_boosted_languages(spark, sf_dir):
    """Boosted trees over ten spelling features tell the languages of all documents; those that have one are learned from, all are scored and explained."""
    from tracelake.operators import model

    text = F.lower(F.coalesce("text", F.lit("")))
    features = [f"x{i}" for i in range(len(_MARKS))]
    counts = [(F.regexp_count(text, F.lit(m)) * 100 / F.greatest(F.length(text), F.lit(1))).alias(n) for n, m in zip(features, _MARKS)]
    # bins, classes, training and scores read the features, not the texts again
    rows = stored(_t(spark, sf_dir, "documents").select("doc_id", "lang", *counts), "spelling")
    trained = model.train_boosted(rows.where("lang IS NOT NULL"), features, "lang", "doc_id", rounds=8, depth=3, bins=32)
    folder = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    model.certify(spark, trained, folder, "v1")
    found = model.FrozenClassifier(spark, folder, "v1")
    scored = found.explain(found.predict(rows), 3)
    return scored.select("doc_id", "prediction.attack_cat", F.round("prediction.probability", 4).alias("probability"), F.size("top_features").alias("n_features"))


@query()
def m3_copula_sample(spark, sf_dir):
    """As many synthetic line items as there are parts, from the copula of four columns."""
    from tracelake.operators import synth

    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    copula = synth.fit(_t(spark, sf_dir, "lineitem"), columns)
    return synth.sample(spark, copula, _t(spark, sf_dir, "part").count())
