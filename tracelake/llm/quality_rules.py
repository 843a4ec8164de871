"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Base figures are computed for every text. The rules beyond the base rule form one CASE expression,
which ends at the first rule that rejects; a bounded sample shows what each rule costs and rejects,
and the rules are put in order of rejection per cost. The order changes the time, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tracelake.llm.tables import stored

SPACE = "[ \t-\r]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A named condition on ``body`` (the text) and the base figures; a text for which it holds is rejected."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    letters = F.regexp_count("body", F.lit(r"\p{L}"))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > F.col("n_words")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
        Rule("repeated_lines", (F.col("n_dup_lines") > 2) & (F.col("n_dup_lines") * 10 > F.col("n_lines") * 3)),
        Rule("capitals", F.regexp_count("body", F.lit(r"\p{Lu}")) * 2 > letters),
        Rule("few_letters", letters * 2 < F.col("word_chars")),
        Rule("shouting", F.regexp_count("body", F.lit(r"!!")) * 5 > F.col("n_words")),
    ]


def base_figures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key``, ``body`` and the figures of each whole text; a null text counts as an empty one.

    Figures (long): n_words, word_chars (code points in words), n_symbols, n_lines (with a word),
    n_dup_lines (of those, equal to an earlier one) and n_repeat_words: words in windows of eight
    words that occur twice or more in the text. Windows are compared by 64-bit hashes.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("key"), body.alias("body"))
    trimmed = F.btrim("body", F.lit(BLANKS))
    rows = rows.withColumns(
        {
            "words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)),
            "lines": F.filter(F.split("body", F.lit("\n")), lambda line: line.rlike("[^ \t-\r]")),
        }
    )
    return rows.select(
        "key",
        "body",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("body", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        bound(F.col("words"), _repeat_words).cast("long").alias("n_repeat_words"),
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, wherever the optimiser may move the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(bound(windows, _covered))


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more. Most texts repeat no window: only the others are sorted."""

    def starts(ordered: Column) -> Column:
        again = F.filter(ordered, lambda w, k: (w.h == F.get(ordered, k - 1).h) | (w.h == F.get(ordered, k + 1).h))
        return bound(F.sort_array(F.transform(again, lambda w: w.i)), words)

    def words(at: Column) -> Column:
        fresh = F.transform(at, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW))))
        return F.aggregate(fresh, F.lit(0), lambda a, b: a + b)

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(bound(ordered, starts))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def order_rules(docs: DataFrame, rules: list[Rule], *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1000, repeats: int = 8) -> list[Rule]:
    """The rules by rejection per cost, largest first, as measured on about ``sample_rows`` rows drawn at random.

    Every rule is evaluated ``repeats`` times on each row of the sample in one job, so that its own time shows
    beside that of a job; a job that evaluates nothing is timed in the same way and taken off. The better of
    two runs counts. Texts that the base rule rejects are not measured: the cascade never sees them.
    """
    total = docs.count()
    drawn = docs.sample(min(1.0, sample_rows / max(total, 1)), seed=42)
    sample = stored(base_figures(drawn, id_col=id_col, text_col=text_col).where(~base_failed()), "rules-sample")
    n = max(sample.count(), 1)
    again = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def seconds(condition: Column) -> tuple[float, int]:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            hits = again.agg(F.count_if(condition & (F.col("again") > 0))).first()[0]
            took.append(time.perf_counter() - began)
        return min(took), hits

    idle = seconds(F.col("n_words") < 0)[0]
    measured = [(rule, *seconds(rule.rejects)) for rule in rules]
    return [rule for rule, cost, hits in sorted(measured, key=lambda m: -(m[2] / (repeats * n)) / max(m[1] - idle, 1e-4))]


def apply_rules(
    docs: DataFrame,
    rules: list[Rule] | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = 1000,
) -> DataFrame:
    """Figures and verdicts of every whole text.

    Returns per input row: ``id_col``, the figures of ``base_figures``, ``base_failed``, ``rejected_by``
    string (the first rule in the cascade's order that rejects; null if none did or the base rule
    failed; the order can differ between runs) and ``kept`` boolean. Null and empty texts have zero
    figures and fail the base rule. Repeated rows give repeated rows, a null id stays null; other
    columns are neither read nor returned. There is no shuffle.
    """
    figures = base_figures(docs, id_col=id_col, text_col=text_col)
    cascade = F.when(F.col("base_failed"), F.lit("base"))
    for rule in order_rules(docs, default_rules() if rules is None else rules, id_col=id_col, text_col=text_col, sample_rows=sample_rows):
        cascade = cascade.when(rule.rejects, F.lit(rule.name))
    judged = figures.withColumn("base_failed", base_failed()).withColumn("verdict", cascade)
    return judged.select(
        F.col("key").alias(id_col),
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(~F.col("base_failed"), F.col("verdict")).alias("rejected_by"),
        F.col("verdict").isNull().alias("kept"),
    )
