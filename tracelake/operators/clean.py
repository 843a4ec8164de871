"""Cleaning of labels and numeric columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracelake import schema
from tracelake.functions.scalars import clip, snake_case, title
from tracelake.operators.quantiles import quantiles

# Spellings of labels, by the category that they mean. Those of _COMMON are of all three data sets.
_COMMON = {
    "Normal": ("Benign", "BENIGN", "normal", "benign", "", "None", "nan", "NaN"),
    "PortScan": ("Port Scan", "Portscan", "portscan", "PortScan"),
    "DDoS": ("Ddos", "ddos", "DDoS"),
    "DoS": ("Dos", "dos", "DoS"),
    "MitM": ("MITM", "mitm", "MitM"),
    "Generic": ("Attack", "attack", "Unknown"),
}
_UNSW = {
    "Reconnaissance": ("Reconnaissance", "reconnaissance"),
    "BruteForce": ("bruteforce", "BruteForce", "brute force", "Brute Force"),
    "Worms": ("Worms", "worms", "Worm", "worm"),
    "Backdoors": ("Backdoor", "backdoor", "Backdoors", "backdoors"),
}
_KITSUNE = {
    "Generic": ("unknown",),
    "PortScan": ("port scan",),
    "Reconnaissance": ("Reconnaissance", "reconnaissance"),
    "BruteForce": ("Bruteforce", "bruteforce", "Brute Force", "brute force"),
    "Worms": ("worms", "Worms", "worm", "Worm"),
}
_CICIDS = {"Normal": ("0", "False", "false")}


def _spelled(name: Column, *tables: dict[str, tuple[str, ...]]) -> Column:
    """The category that a spelling means, else null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for table in tables:
        for category, spellings in table.items():
            out = out.when(name.isin(*spellings), category)
    return out


def label_unsw(c: Column) -> Column:
    """Known spellings become categories, empty and null ones Normal; others stay, trimmed."""
    return _exact(c, _UNSW)


def label_kitsune(c: Column) -> Column:
    """As ``label_unsw``, with the spellings of the other data set."""
    return _exact(c, _KITSUNE)


def _exact(c: Column, table: dict[str, tuple[str, ...]]) -> Column:
    name = F.trim(F.coalesce(c, F.lit("")))
    name = F.coalesce(_spelled(name, _COMMON, table), name)
    return F.when(F.lower(name) == "normal", "Normal").otherwise(name)


def label_cicids(c: Column) -> Column:
    """Known spellings, then patterns in order (normal, brute force, port scan, DDoS, DoS); others in title case."""
    name = F.trim(F.coalesce(c, F.lit("")))
    name = F.coalesce(_spelled(name, _COMMON, _CICIDS), name)
    low = F.lower(name)
    return (
        F.when((low == "") | low.isin("0", "false", "no") | low.rlike("benign|normal"), "Normal")
        .when(low.rlike("patator|brute"), "BruteForce")
        .when(low.rlike("port ?scan"), "PortScan")
        .when(low.contains("ddos"), "DDoS")
        .when(low.rlike("^dos| dos( |$)|dos[-_]"), "DoS")
        .otherwise(title(name))
    )


def hyphens(c: Column) -> Column:
    """Web attack names with the taxonomy's dash, whichever of hyphen, dash or replacement mark they came with."""
    name = F.regexp_replace(c, r"(?i)^web attack\s*[-–\x{FFFD}]+\s*", "Web Attack – ")
    return F.when(F.lower(name) == "web attack – xss", "Web Attack – Xss").when(F.lower(name) == "web attack – sql injection", "Web Attack – Sql Injection").otherwise(name)


def label_from_path(path: Column) -> Column:
    """A category by marks in a file's name, else the name in title case."""
    name = F.element_at(F.split(path, "/"), -1)
    low = F.lower(name)
    stem = title(F.translate(F.regexp_replace(name, r"\.[^.]*$", ""), "_-", "  "))
    return (
        F.when(low.rlike("benign|normal|baseline|idle|clean"), "Normal")
        .when(low.rlike("mirai|botnet"), "DDoS")
        .when(low.contains("scan"), "Reconnaissance")
        .when(low.contains("fuzz"), "Fuzzers")
        .when(low.rlike("dos|flood|reneg"), "DoS")
        .when(low.rlike("mitm|arp|spoof"), "MitM")
        .otherwise(F.when(stem == "", "Generic").otherwise(stem))
    )


def label_bit(category: Column) -> Column:
    """1 for anything but Normal."""
    return (F.lower(category) != "normal").cast("int")


def fallback_category(label: Column) -> Column:
    return F.when(label == 0, "Normal").otherwise("Generic")


def scenario_category(category: Column) -> Column:
    """The smaller taxonomy: anything else is Generic."""
    return F.when(category.isin(*schema.SCENARIO_CATEGORIES), category).otherwise("Generic")


def find_label_column(columns: list[str]) -> str | None:
    """``label``, else the first column whose name has class, attack or target in it."""
    names = [snake_case(c) for c in columns]
    return "label" if "label" in names else next((c for c in names if any(x in c for x in ("class", "attack", "target"))), None)


def no_infinity(c: Column) -> Column:
    return F.when(F.abs(c) == float("inf"), None).otherwise(F.nanvl(c, F.lit(None).cast("double")))


def _numeric(df: DataFrame, columns: list[str] | None) -> list[str]:
    return columns if columns is not None else [c for c, t in df.dtypes if t in ("double", "float")]


def impute_median(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing and infinite values as the column's exact median, 0.0 if it has none. Two aggregates for all columns."""
    columns = _numeric(df, columns)
    medians = quantiles(df, {c: (no_infinity(F.col(f"`{c}`")), 0.5) for c in columns})
    return df.withColumns({c: F.coalesce(no_infinity(F.col(f"`{c}`")), F.lit(0.0 if medians[c] is None else medians[c])) for c in columns})


def winsorize(df: DataFrame, columns: list[str] | None = None, *, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Values moved to the column's quantiles. Two aggregates for all columns, one pass to apply them."""
    columns = _numeric(df, columns)
    bounds = quantiles(df, {f"{side}{c}": (F.col(f"`{c}`"), q) for c in columns for side, q in (("l", low), ("h", high))})
    return df.withColumns({c: clip(F.col(f"`{c}`"), F.lit(bounds[f"l{c}"]), F.lit(bounds[f"h{c}"])) for c in columns if bounds[f"l{c}"] is not None})


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one value, null counted as a value: their least and largest are equal."""
    aggregates = []
    for i, (c, kind) in enumerate(df.dtypes):
        value, nulls = F.col(f"`{c}`"), F.count_if(F.col(f"`{c}`").isNull())
        if "map<" in kind or "variant" in kind:  # these have no order
            value = F.to_json(F.struct(value))
        same = F.coalesce(F.min(value) == F.max(value), F.lit(True))
        aggregates.append((same & ((nulls == 0) | (nulls == F.count(F.lit(1))))).alias(f"c{i}"))
    found = df.agg(*aggregates).first()
    return [c for i, c in enumerate(df.columns) if found[i]]


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many values each column has, null counted as one. Columns are counted one after the other, without a copy of the rows for each."""
    counts = [df.select(F.col(f"`{c}`").alias("v")).groupBy("v").agg(F.lit(1)).agg(F.lit(c).alias("c"), F.count(F.lit(1)).alias("n")) for c in columns]
    return reduce(DataFrame.unionByName, counts).agg(*[F.max(F.when(F.col("c") == c, F.col("n"))).alias(c) for c in columns])


def drop_constant(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))


def columns_containing(df: DataFrame, mark: str) -> list[str]:
    """Text columns where any value contains a mark, such as Infinity or U+FFFD."""
    texts = [c for c, t in df.dtypes if t == "string"]
    found = df.agg(*[F.bool_or(F.contains(F.col(f"`{c}`"), F.lit(mark))).alias(f"c{i}") for i, c in enumerate(texts)]).first() if texts else []
    return [c for i, c in enumerate(texts) if found[i]]


def drop_containing(df: DataFrame, mark: str = "Infinity") -> DataFrame:
    return df.drop(*columns_containing(df, mark))


def inject_missing(df: DataFrame, columns: list[str], fraction: float, key: str, *, seed: int = 42) -> DataFrame:
    """Nulls in a share of the values, picked by a hash of column and key: the same rows in every run, others in every column."""

    def share(c: str) -> Column:
        """The first 32 bits of an MD5, as a number below 1."""
        return F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:{c}:"), F.col(key).cast("string"))), F.lit(8)), 16, 10).cast("double") / (1 << 32)

    return df.withColumns({c: F.when(F.coalesce(share(c), F.lit(1.0)) >= fraction, F.col(c)) for c in columns})
