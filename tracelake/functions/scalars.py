"""Scalar expressions that the operators share; all of them run in the JVM."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from tracelake.schema import CEF_SEVERITY, EVE_SEVERITY


def missing(c: Column) -> Column:
    """Null or, for numbers, NaN."""
    return c.isNull() | F.coalesce(F.isnan(c.try_cast("double")), F.lit(False))


def snake_case(name: str) -> str:
    """A header's name: trimmed, lower case, with underscores for blanks, slashes and hyphens."""
    for mark in " /-":
        name = name.strip().replace(mark, "_")
    return name.lower()


def finite(c: Column) -> Column:
    """NaN and infinities as 0.0; null stays null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def number(c: Column, otherwise: float | None = 0.0) -> Column:
    """Text as a number, with a value for what is none."""
    value = c.try_cast("double")
    return value if otherwise is None else F.coalesce(value, F.lit(otherwise))


def clip(c: Column, low: Column, high: Column) -> Column:
    """Values moved into [low, high], if low is below high."""
    return F.when(low < high, F.least(F.greatest(c, low), high)).otherwise(c)


def title(c: Column) -> Column:
    """Words squeezed to single blanks, each capitalised after anything but a letter."""
    squeezed = F.regexp_replace(F.trim(c), r"\s+", " ")
    runs = F.regexp_extract_all(squeezed, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def event_time(*texts: Column) -> Column:
    """Microseconds of the first non-empty text: an ISO time (UTC if it names no zone) or epoch seconds; else null."""
    text = F.coalesce(*[F.nullif(t.cast("string"), F.lit("")) for t in texts])
    seconds = text.try_cast("double")
    return F.coalesce(F.round(seconds * 1_000_000).cast("long"), F.unix_micros(text.try_cast("timestamp")))


def syslog_time(prefix: Column, reference_year: Column | None = None) -> Column:
    """Timestamp of ``<PRI>Mon d [yyyy] hh:mm:ss host``; without a year, that of ``reference_year`` or today's."""
    parts = F.split(F.regexp_replace(F.trim(prefix), r"^<\d+>", ""), r"\s+")
    year = F.year(F.current_date()) if reference_year is None else reference_year
    dated = F.array_join(F.slice(parts, 1, 4), " ")
    undated = F.concat_ws(" ", F.slice(parts, 1, 2), year.cast("string"), F.get(parts, F.lit(2)))
    form = F.lit("MMM d yyyy HH:mm:ss")
    return F.coalesce(F.try_to_timestamp(dated, form), F.try_to_timestamp(undated, form))


def day_first_seconds(c: Column) -> Column:
    """Epoch seconds of d/M/yyyy H:mm[:ss] text, else null."""
    return F.coalesce(*[F.unix_seconds(F.try_to_timestamp(c, F.lit(f))) for f in ("d/M/yyyy H:mm:ss", "d/M/yyyy H:mm")])


def eve_severity(c: Column) -> Column:
    """Event severity of an alert's severity; 1 for unknown ones."""
    lookup = F.create_map(*[F.lit(x) for x in chain(*EVE_SEVERITY.items())])
    return F.coalesce(F.try_element_at(lookup, c.try_cast("int")), F.lit(1))


def cef_severity(c: Column) -> Column:
    """Event severity of a CEF severity, a name or a number from 0 to 10; 1 for anything else."""
    name = F.lower(F.trim(c.cast("string")))
    lookup = F.create_map(*[F.lit(x) for x in chain(*CEF_SEVERITY.items())])
    n = name.try_cast("int")
    steps = F.when(n <= 0, 1).when(n <= 3, 2).when(n <= 5, 3).when(n <= 7, 4).when(n <= 8, 5).when(n > 8, 6)
    return F.coalesce(F.try_element_at(lookup, name), steps, F.lit(1))


def in_order(a: Column, b: Column) -> Column:
    """Whether (address, port) a is not after b: text first, then number."""
    return a <= b
