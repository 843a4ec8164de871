"""The queries of the operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracelake.llm import ann, bpe, conversations, fill_in_middle, language_id, line_dedup, near_dedup, packing, quality_classifier, quality_rules, toxicity, url_filters, warc
from tracelake.llm.tables import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS payload_digest FROM pages
), sized AS (
  SELECT *, octet_length(payload) AS payload_bytes, max(page_id) OVER (PARTITION BY payload) AS newest FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM newest AND newest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM sized
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP2_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents
), split AS (
  SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), windows AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM split)
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, range(8) AS t(k) GROUP BY r
), figures AS (
  SELECT doc_id, body, len(words) AS n_words,
    length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words,
    len(regexp_extract_all(body, '\p{L}')) AS letters,
    len(regexp_extract_all(body, '\p{Lu}')) AS capitals,
    len(regexp_extract_all(body, '!!')) AS shouts
  FROM split LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM figures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR (n_dup_lines > 2 AND n_dup_lines * 10 > n_lines * 3) OR capitals * 2 > letters
    OR letters * 2 < word_chars OR shouts * 5 > n_words) AS kept
FROM judged
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, and which non-empty ones repeat a line that stays elsewhere (numbers from 0)."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text").cast("string")
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    counts = docs.select("doc_id", F.xxhash64(text).alias("mark"), F.coalesce(lines, F.lit(1)).cast("long").alias("n_lines"))
    removed = line_dedup.removed_lines(docs)
    none = F.array().cast("array<int>")
    found = counts.join(removed.hint("merge"), ["doc_id", "mark"], "left")
    return found.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", none).alias("removed_lines"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), VOCABULARY, decode=True)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP5_SQL = """
WITH vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


OP6_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM split
), sizes AS (
  SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM sizes
  UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node
), components AS (
  SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN components USING (doc_id)
"""


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, room=4096, end_id=1)


def fold(modulus: int) -> Column:
    """crc32 of the doc_id's text, modulo: tells held-out documents from those to learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(-1))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(fold(5) > 0)
    scored = quality_classifier.classify(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where((fold(3) >= 0) & (fold(3) != 1))
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(fold(5) > 0))
    return language_id.predict(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.repair(damaged, dropped="dropped")


OP11_SQL = r"""
WITH RECURSIVE r AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS mark
  FROM conversations
), codes AS (
  SELECT mark, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(mark, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda x, y:
    list_reduce(list_prepend(xor(x, y), [CAST(0 AS BIGINT) for k in range(8)]), lambda z, w: CASE WHEN z % 2 = 1 THEN xor(z // 2, 3988292384) ELSE z // 2 END)), 4294967295) % 20 AS kind
  FROM (SELECT DISTINCT mark FROM r)
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [1, 2] WHEN 0 THEN [] ELSE [1] END) AS copy
  FROM r JOIN codes USING (mark)
), placed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), '') AS k, left(role, 1) AS ini, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), g AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault
  FROM placed
), counts AS (
  SELECT k, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || '/' || ini NOT IN ('s/u', 'u/a', 'a/u')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
  FROM g GROUP BY k
), v AS (
  SELECT k, max(i) + 1 AS i, {'c': CAST(0 AS BIGINT), 'a': ''} AS v0, {'c': CAST(4 AS BIGINT), 'a': 'II'} AS v1, {'c': CAST(2 AS BIGINT), 'a': 'I'} AS v2, {'c': CAST(0 AS BIGINT), 'a': ''} AS v3 FROM g GROUP BY k
  UNION ALL
  SELECT k, i, list_min([w0, {'c': x2.c + 2, 'a': 'I' || x2.a}]), list_min([w1, {'c': x2.c + 2, 'a': 'I' || x2.a}]), x2, x3
  FROM (
    SELECT *, list_min([w2, {'c': w3.c + 2, 'a': 'I' || w3.a}]) AS x2, list_min([w3, {'c': w2.c + 2, 'a': 'I' || w2.a}]) AS x3
    FROM (
      SELECT k, i,
        list_min([{'c': v0.c + 3, 'a': 'D' || v0.a}, CASE WHEN NOT gone THEN CASE ini WHEN 's' THEN {'c': v1.c + x, 'a': 'K' || v1.a} WHEN 'u' THEN {'c': v2.c + x, 'a': 'K' || v2.a} END END, CASE WHEN NOT gone THEN {'c': v2.c + x + 2, 'a': 'R' || v2.a} END]) AS w0,
        list_min([{'c': v1.c + 3, 'a': 'D' || v1.a}, CASE WHEN NOT gone AND ini = 'u' THEN {'c': v2.c + x, 'a': 'K' || v2.a} END, CASE WHEN NOT gone THEN {'c': v2.c + x + 2, 'a': 'R' || v2.a} END]) AS w1,
        list_min([{'c': v2.c + 3, 'a': 'D' || v2.a}, CASE WHEN NOT gone AND ini = 'a' THEN {'c': v3.c + x, 'a': 'K' || v3.a} END, CASE WHEN NOT gone THEN {'c': v3.c + x + 2, 'a': 'R' || v3.a} END]) AS w2,
        list_min([{'c': v3.c + 3, 'a': 'D' || v3.a}, CASE WHEN NOT gone AND ini = 'u' THEN {'c': v2.c + x, 'a': 'K' || v2.a} END, CASE WHEN NOT gone THEN {'c': v2.c + x + 2, 'a': 'R' || v2.a} END]) AS w3
      FROM (SELECT v.k, g.i, v0, v1, v2, v3, ini, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS x FROM v JOIN g ON g.k = v.k AND g.i = v.i - 1)
    )
  )
), best AS (
  SELECT k, v0.c AS cost, v0.a AS audit FROM v WHERE i = 1
), t AS (
  SELECT k, audit, 0 AS step, CAST(1 AS BIGINT) AS i, 0 AS s, CAST(NULL AS VARCHAR) AS line FROM best
  UNION ALL
  SELECT t.k, audit, step + 1, CASE WHEN letter = 'I' THEN t.i ELSE t.i + 1 END,
    CASE letter WHEN 'D' THEN s WHEN 'K' THEN CASE ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE s WHEN 2 THEN 3 ELSE 2 END END,
    CASE letter WHEN 'D' THEN NULL WHEN 'K' THEN role || ':' || text ELSE CASE s WHEN 2 THEN 'assistant:' ELSE 'user:' END || CASE letter WHEN 'R' THEN text ELSE '' END END
  FROM (SELECT *, audit[step + 1] AS letter FROM t WHERE step < length(audit)) t LEFT JOIN g ON g.k = t.k AND g.i = t.i
), told AS (
  SELECT k, string_agg(line, chr(10) ORDER BY step) AS repaired FROM t GROUP BY k
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS k FROM conversations) c
  LEFT JOIN counts USING (k) LEFT JOIN best USING (k) LEFT JOIN told USING (k)
"""


#: Host and start of path, as the contract gives them.
SITES = (
    url_filters.Rule("org/", "allow", True),
    url_filters.Rule("example.org/es/", "block", True),
    url_filters.Rule("example.org/en/1", "block", True),
    url_filters.Rule("com/fr/", "allow", True),
    url_filters.Rule("com/de/", "block", True),
)


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filters.rules_table(spark, (*SITES, *url_filters.DEFAULT_RULES))
    return url_filters.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "pattern", "verdict")


def _sites_sql() -> str:
    """One row per site rule: its pattern, action, host and start of path."""
    return ", ".join(f"('{r.pattern}', '{r.action}', '{r.pattern.partition('/')[0]}', '/{r.pattern.partition('/')[2]}')" for r in SITES)


def _patterns_sql() -> str:
    """One row per other rule: its pattern, action and a regular expression."""
    rows = []
    for rule in url_filters.DEFAULT_RULES:
        inner = rule.pattern.removeprefix("||").removesuffix("*").replace(".", "[.]").replace("^*^", "([^A-Za-z0-9].*)?[^A-Za-z0-9]")
        start = "^([^/]*[.])?" if rule.pattern.startswith("||") else ""
        regex = inner.replace("^", "(^|[^A-Za-z0-9])", 1).removesuffix("^") + "([^A-Za-z0-9]|$)" if inner.startswith("^") else inner
        rows.append(f"('{rule.pattern}', '{rule.action}', '{start}{regex}')")
    return ", ".join(rows)


OP12_SQL = f"""
WITH sites(pattern, action, host, start) AS (VALUES {_sites_sql()}),
patterns(pattern, action, regex) AS (VALUES {_patterns_sql()}),
rests AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
), by_site AS (
  SELECT r, max((length(s.pattern), s.action, s.pattern)) AS best FROM parts p JOIN sites s
  ON (p.host = s.host OR ends_with(p.host, '.' || s.host)) AND starts_with(p.path, s.start) GROUP BY r
), by_pattern AS (
  SELECT r, max((length(s.pattern), s.action, s.pattern)) AS best FROM parts p JOIN patterns s
  ON regexp_matches(p.host || p.path, s.regex, 's') GROUP BY r
)
SELECT page_id, host, path, s.best[3] AS rule, CASE WHEN s.best IS NULL THEN b.best[3] END AS pattern, coalesce(s.best[2], b.best[2], 'allow') AS verdict
FROM parts LEFT JOIN by_site s USING (r) LEFT JOIN by_pattern b USING (r)
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    formed = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    return formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), cut AS (
  SELECT *, regexp_extract_all(body, '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS units,
    CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4
  FROM texts
), placed AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
    CASE WHEN body = '' OR regexp_matches(body, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM parts
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_normaliser": op1_warc_normaliser,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_url_filters": op12_url_filters,
    "op13_fill_in_middle": op13_fill_in_middle,
}

SQL: dict[str, str] = {
    "op1_warc_normaliser": OP1_SQL,
    "op2_quality_rules": OP2_SQL,
    "op5_nearest_neighbours": OP5_SQL,
    "op6_minhash_near_dedup": OP6_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_url_filters": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
