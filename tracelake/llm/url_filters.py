"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame functions alone.

A URL can only match a pattern whose literal tokens it contains. Every rule is therefore listed under one of its
tokens, the one that the fewest URLs contain; the tokens of a URL fetch the rules listed under them, and only
those run their regular expressions. Where the rules are, by their size, small enough they are sent to all tasks,
otherwise tokens and rules meet in a join that can be split.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracelake.llm.components import apart

#: Bytes of rules that are broadcast at most.
SMALL = 8 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A pattern for host and path, and what becomes of a URL that it fits: ``allow`` or ``block``.

    ``site`` rules name a host and the start of a path (``example.org/es/``); they fit that host and its subdomains
    and go before all others. Other patterns fit anywhere in host and path: ``*`` is any run of characters, ``^`` an edge of
    a token (a run of ASCII letters and digits), ``||`` at the start an edge of a host's label. Of the site rules that
    fit the longest decides, otherwise of the other rules that fit the longest; of equally long ones a blocking one.
    """

    pattern: str
    action: str = "block"
    site: bool = False


#: Words that mark advertising, gambling, adult and counterfeit sites, and places where such words are reference.
DEFAULT_RULES = (
    *(Rule(f"^{word}^") for word in ("casino", "bets", "betting", "poker", "pills", "viagra", "porn", "xxx", "escort", "warez", "torrent", "payday")),
    Rule("||ads.*"), Rule("||tracker.*"), Rule("^cheap^*^replica^"),
    Rule("||wikipedia.org/*", "allow"), Rule("||archive.org/details/*", "allow"),
)


def rules_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame([astuple(r) for r in rules], "pattern string, action string, site boolean")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to a slash, question mark or hash, with A-Z lower-cased, and then up to a question mark or hash."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def tokens(address: Column) -> Column:
    """The distinct runs of ASCII letters and digits, lower-cased, and an empty one for rules without a token."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.translate(address, _UPPER, _LOWER), "[^a-z0-9]+")))


def compiled(rules: DataFrame) -> DataFrame:
    """Adds ``regex`` and ``literals``, the tokens that every URL contains that the rule fits.

    Rows with a null in pattern or action, or an empty pattern, are left out; a null ``site`` is false. Repeated rules count once.
    """
    known = rules.where("pattern != '' AND action IN ('allow', 'block')").select("pattern", "action", F.coalesce("site", F.lit(False)).alias("site")).distinct()
    anchored = F.startswith("pattern", F.lit("||"))
    inner = F.when(anchored & ~F.col("site"), F.substring("pattern", 3, 1 << 30)).otherwise(F.col("pattern"))
    whole = F.col("site") & ~F.contains("pattern", F.lit("/"))
    label = F.lit(r"^(?:[^/]*\.)?")
    quoted = F.regexp_replace(inner, r"([\\.\[\]{}()+?$|*^])", r"\\$1")
    free = F.replace(F.replace(quoted, F.lit(r"\*"), F.lit(r"[\s\S]*")), F.lit(r"\^"), F.lit(r"(?:^|$|(?<=[^A-Za-z0-9])|(?=[^A-Za-z0-9]))"))
    regex = F.when(whole, F.concat(label, quoted, F.lit(r"(?![^/])"))).when(F.col("site"), F.concat(label, quoted)).otherwise(F.concat(F.when(anchored, label).otherwise(""), free))
    # a run beside a star, or at an end of a pattern that may go on there, need not be a token of the URL
    star = F.lit("*")
    bounded = F.concat(F.when(F.col("site") | anchored, "").otherwise(star), F.when(F.col("site"), F.replace(inner, star, F.lit("."))).otherwise(inner), F.when(whole, "").otherwise(star))
    literals = F.regexp_extract_all(bounded, F.lit(r"(?<![A-Za-z0-9*])([A-Za-z0-9]+)(?![A-Za-z0-9*])"), F.lit(1))
    return known.select("pattern", "action", "site", regex.alias("regex"), F.array_distinct(F.transform(literals, lambda t: F.translate(t, _UPPER, _LOWER))).alias("literals"))


def _small(df: DataFrame) -> bool:
    """Whether a table's rows, as they would be broadcast, stay under SMALL bytes, from a sum over all of them."""
    size = sum((F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c in df.columns), F.lit(64))
    return (df.agg(F.sum(size)).first()[0] or 0) <= SMALL


def _met(left: DataFrame, right: DataFrame, small: bool) -> DataFrame:
    """Rows of both sides with equal tokens. The right side is broadcast where it is small; else a token can be split over tasks."""
    return left.join(F.broadcast(right) if small else apart(right).hint("merge"), "token")


def index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """``rules`` (compiled) with ``token``: that of their literals which the fewest of the distinct ``urls`` contain.

    Ties go to the longest, then to the least token; a rule without a literal is listed under the empty token.
    """
    used = rules.select(F.explode("literals").alias("token")).distinct()
    seen = _met(urls.select(F.explode("tokens").alias("token")), used, _small(used))
    counts = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    listed = rules.select("pattern", "action", "site", "regex", F.explode_outer("literals").alias("token"))
    told = listed.join(apart(counts), "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = F.min_by("token", F.struct("n", -F.length("token"), "token"))
    return told.groupBy("pattern", "action", "site", "regex").agg(F.coalesce(rarest, F.lit("")).alias("token"))


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The verdict on every row's URL.

    rules: pattern, action, site. Returns per input row: ``id_col``, ``host``, ``path``, ``rule`` (the site rule that decides, else
    null), ``pattern`` (the other rule that decides, else null) and ``verdict`` (``default`` where no rule fits). Null URLs and
    ones without ``://`` have an empty host and path, which only rules without a token could fit. Every distinct address is judged
    once; repeated rows give repeated rows, a null id stays null, other columns are neither read nor returned. An empty
    table of rules lets ``default`` decide for all.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("key"), host.alias("host"), path.alias("path")).withColumn("address", F.concat("host", "path"))
    ready = compiled(rules)
    addresses = rows.select("address").distinct().withColumn("tokens", tokens(F.col("address")))
    listed = index(ready, addresses)
    candidates = _met(addresses.select("address", F.explode("tokens").alias("token")), listed, _small(ready))
    fits = candidates.where(F.regexp_like("address", F.col("regex")))

    def longest(site: Column) -> Column:
        return F.max(F.when(site, F.struct(F.length("pattern").alias("length"), "action", "pattern")))

    found = fits.groupBy("address").agg(longest(F.col("site")).alias("by_site"), longest(~F.col("site")).alias("by_pattern"))
    judged = rows.join(apart(found).hint("merge"), "address", "left")
    pattern = F.when(F.col("by_site").isNull(), F.col("by_pattern.pattern"))
    verdict = F.coalesce("by_site.action", "by_pattern.action", F.lit(default))
    return judged.select(F.col("key").alias(id_col), "host", "path", F.col("by_site.pattern").alias("rule"), pattern.alias("pattern"), verdict.alias("verdict"))
