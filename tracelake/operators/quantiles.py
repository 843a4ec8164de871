"""Exact medians and quantiles of any number of rows: an approximate pass brackets them, a second one counts and picks.

Spark's own exact percentile holds every distinct value of a column in one task. Here a sketch of bounded size
first gives two values that are known to enclose the wanted ranks; what lies strictly between them is a small,
known share of the rows, and only that is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracelake.storage import stored

#: The sketch's values are within this share of the rows of their ranks.
ACCURACY = 20_000
#: Values between the two that enclose a quantile, at most, before they are enclosed more closely.
INSIDE = 500_000
#: Parts into which the values between two ends are cut to draw these closer.
GRID = 256


def _enclosing(value: Column, q: float) -> Column:
    """Two values that enclose the ranks beside a quantile; the least and the largest where there are few values."""
    ends = [max(0.0, q - 2 / ACCURACY), min(1.0, q + 2 / ACCURACY)]
    return F.when(F.count(value) < 10 * ACCURACY, F.array(F.min(value), F.max(value))).otherwise(F.percentile_approx(value, ends, ACCURACY))


def _picked(n: Column, q: float, low: Column, high: Column, below: Column, at_low: Column, inside: Column) -> Column:
    """The interpolated quantile from the counts and the sorted values strictly inside."""

    def ranked(k: Column) -> Column:
        inner = F.get(inside, (k - below - at_low).cast("int"))
        return F.when(k < below + at_low, low).otherwise(F.coalesce(inner, high))

    place = (n - 1) * F.lit(q)
    k = F.floor(place)
    first, second = ranked(k), ranked(F.least(k + 1, n - 1))
    return F.when(n > 0, first + (second - first) * (place - k))


def group_quantiles(df: DataFrame, by: str, values: dict[str, tuple[Column, float]]) -> DataFrame:
    """Per group an exact, interpolated quantile of each value (name: value and share); nulls do not count.

    Two values that enclose the wanted ranks come from a sketch per group, and are drawn closer as long as more than INSIDE
    values of any group lie between them: so no task gathers more, however large a group is.
    """
    shares = [q for _, q in values.values()]
    rows = df.select(F.col(by).alias("by"), *[v.cast("double").alias(f"v{i}") for i, (v, _) in enumerate(values.values())])
    enclosing = [F.struct(F.get(e, F.lit(0)).alias("low"), F.get(e, F.lit(1)).alias("high")) for e in (_enclosing(F.col(f"v{i}"), q) for i, q in enumerate(shares))]
    ends = stored(rows.groupBy(F.col("by").alias("of")).agg(*[e.alias(f"e{i}") for i, e in enumerate(enclosing)]), "group-ends")
    many = range(len(shares))

    def inside(i: int) -> Column:
        return F.when((F.col(f"v{i}") > F.col(f"e{i}.low")) & (F.col(f"v{i}") < F.col(f"e{i}.high")), F.col(f"v{i}"))

    def met(ends: DataFrame) -> DataFrame:
        # one row per group, dealt out by the join so that a group with very many rows can be split
        return rows.join(ends.coalesce(1 << 20), F.col("by").eqNullSafe(F.col("of")))

    def counted(ends: DataFrame, *more: Column) -> DataFrame:
        counts = [x for i in many for x in (F.count(f"v{i}").alias(f"n{i}"), F.first(f"e{i}").alias(f"e{i}"), F.count_if(F.col(f"v{i}") < F.col(f"e{i}.low")).alias(f"below{i}"), F.count_if(F.col(f"v{i}") == F.col(f"e{i}.low")).alias(f"at{i}"), F.count(inside(i)).alias(f"within{i}"))]
        return met(ends).groupBy("by").agg(*counts, *more)

    while True:
        counts = stored(counted(ends), "group-counts")
        if (counts.agg(F.max(F.greatest(*[F.col(f"within{i}") for i in many], F.lit(0)))).first()[0] or 0) <= INSIDE:
            break
        # GRID values of what lies between, of which those beside the wanted rank's share of it are the next ends
        grid = [k / GRID for k in range(GRID + 1)]
        grids = met(ends).groupBy("by").agg(*[F.percentile_approx(inside(i), grid, ACCURACY).alias(f"g{i}") for i in many]).withColumnRenamed("by", "of")
        both = counts.join(grids, F.col("by").eqNullSafe(F.col("of")))
        closer = []
        for i, q in enumerate(shares):
            at = (F.col(f"n{i}") - 1) * F.lit(q) - F.col(f"below{i}") - F.col(f"at{i}")
            # the rank after the wanted one is needed too
            low = F.floor(at / F.col(f"within{i}") * GRID).cast("int") - 1
            high = F.ceil((at + 1) / F.col(f"within{i}") * GRID).cast("int") + 1
            # a wanted rank beyond what lies between is one of the ends themselves
            new_low = F.when(low > 0, F.get(f"g{i}", F.least(low, F.lit(GRID)))).otherwise(F.col(f"e{i}.low"))
            new_high = F.when(high < GRID, F.get(f"g{i}", F.greatest(high, F.lit(0)))).otherwise(F.col(f"e{i}.high"))
            narrow = F.col(f"within{i}") > INSIDE
            closer.append(F.when(narrow, F.struct(new_low.alias("low"), new_high.alias("high"))).otherwise(F.col(f"e{i}")).alias(f"e{i}"))
        fresh = stored(both.select("of", *closer), "group-ends")
        if fresh.exceptAll(ends).isEmpty():
            raise ValueError("values cannot be enclosed more closely")
        ends = fresh
    found = counted(ends, *[F.sort_array(F.collect_list(inside(i))).alias(f"inside{i}") for i in many])
    picked = [_picked(F.col(f"n{i}"), q, F.col(f"e{i}.low"), F.col(f"e{i}.high"), F.col(f"below{i}"), F.col(f"at{i}"), F.col(f"inside{i}")).alias(c) for i, (c, q) in enumerate(zip(values, shares))]
    return found.select(F.col("by").alias(by), *picked)


def quantiles(df: DataFrame, values: dict[str, tuple[Column, float]]) -> dict[str, float | None]:
    """Exact, interpolated quantiles over all rows by name (value and share); None where there is no value.

    One pass brackets, one counts and one picks; where very many rows lie between, brackets are narrowed by further passes.
    """
    if not values:
        return {}
    shares = [q for _, q in values.values()]
    rows = df.select(*[v.cast("double").alias(f"v{i}") for i, (v, _) in enumerate(values.values())])
    first = rows.agg(*[x for i, q in enumerate(shares) for x in (F.count(f"v{i}").alias(f"n{i}"), _enclosing(F.col(f"v{i}"), q).alias(f"e{i}"))]).first()
    ends = {i: list(first[f"e{i}"]) for i in range(len(shares)) if first[f"n{i}"]}
    if not ends:
        return dict.fromkeys(values)

    def inside(i: int) -> Column:
        return (F.col(f"v{i}") > ends[i][0]) & (F.col(f"v{i}") < ends[i][1])

    while True:
        counts = rows.agg(*[x for i in ends for x in (F.count_if(F.col(f"v{i}") < ends[i][0]).alias(f"below{i}"), F.count_if(F.col(f"v{i}") == ends[i][0]).alias(f"at{i}"), F.count_if(inside(i)).alias(f"inside{i}"))]).first()
        # the place of the wanted rank among what lies inside, where that is too much to gather
        wide = {i: ((first[f"n{i}"] - 1) * shares[i] - counts[f"below{i}"] - counts[f"at{i}"]) / counts[f"inside{i}"] for i in ends if counts[f"inside{i}"] > INSIDE}
        if not wide:
            break
        closer = rows.agg(*[_enclosing(F.when(inside(i), F.col(f"v{i}")), min(1.0, max(0.0, share))).alias(f"e{i}") for i, share in wide.items()]).first()
        for i, share in wide.items():
            low, high = closer[f"e{i}"]
            new = [low if share > 2 / ACCURACY else ends[i][0], high if share < 1 - 2 / ACCURACY else ends[i][1]]
            if new == ends[i]:
                raise ValueError("values cannot be enclosed more closely")
            ends[i] = new
    lists = rows.agg(*[F.sort_array(F.collect_list(F.when(inside(i), F.col(f"v{i}")))).alias(f"inside{i}") for i in ends])
    picked = lists.select(*[_picked(F.lit(first[f"n{i}"]), shares[i], F.lit(ends[i][0]), F.lit(ends[i][1]), F.lit(counts[f"below{i}"]), F.lit(counts[f"at{i}"]), F.col(f"inside{i}")).alias(f"p{i}") for i in ends]).first()
    return {c: picked[f"p{i}"] if i in ends else None for i, c in enumerate(values)}
