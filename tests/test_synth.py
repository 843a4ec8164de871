"""Copulas of many classes at once against one at a time; as many jobs for many classes as for one."""

import numpy as np
from pyspark.sql import functions as F

from tracelake.operators import synth


def rows(spark, classes):
    """Classes whose columns hang together in ways of their own."""
    u, v = F.col("u"), F.col("v")
    k = F.col("id") % classes
    return spark.range(classes * 400).withColumns({"u": F.rand(1), "v": F.rand(2)}).select(F.concat(F.lit("c"), k.cast("string")).alias("c"), (u * 10 + k).alias("x"), F.when(k % 2 == 0, u * 5 + v * 0.1).otherwise(v - u * 5).alias("y"), F.lit(3.0).alias("z"), F.when(F.col("id") % 9 != 0, v).alias("w")).cache()


def test_classes_at_once_are_those_one_by_one(spark):
    df = rows(spark, 5)
    every = synth.fit_by(df, ["x", "y", "z", "w"], F.col("c"))
    assert sorted(every) == [f"c{i}" for i in range(5)]
    for name, copula in every.items():
        alone = synth.fit(df.where(F.col("c") == name), ["x", "y", "z", "w"])
        assert np.allclose(copula.quantiles, alone.quantiles) and np.allclose(copula.factor, alone.factor)
    drawn = synth.by_quota(spark, every, {name: 1500 for name in every})
    found = {r.attack_cat: r for r in drawn.groupBy("attack_cat").agg(F.corr("x", "y").alias("r"), F.min("x").alias("low"), F.max("z").alias("z"), F.count(F.lit(1)).alias("n")).collect()}
    for i in range(5):
        r = found[f"c{i}"]
        assert r.n == 1500 and r.z == 3.0 and r.low >= i - 0.1 and (r.r > 0.9 if i % 2 == 0 else r.r < -0.9)


def test_scores_are_those_of_a_loop(spark):
    df = rows(spark, 1)
    copula = synth.fit(df, ["x", "y"])
    values = np.array([(r.x, r.y) for r in df.collect()])
    reached = np.stack([(copula.quantiles[i][None] <= values[:, i, None]).sum(1) for i in range(2)], 1)
    from statistics import NormalDist

    z = np.array([NormalDist().inv_cdf((k + 0.5) / synth.POINTS) for k in range(synth.POINTS)])
    corr = np.corrcoef(z[np.maximum(reached, 1) - 1].T)
    assert np.allclose(copula.factor, np.linalg.cholesky(0.999 * corr + 0.001 * np.eye(2)))


def test_as_many_jobs_for_many_classes(spark):
    def jobs(classes):
        df = rows(spark, classes)
        df.count()
        group = f"copula-{classes}"
        spark.sparkContext.setJobGroup(group, "")
        try:
            synth.fit_by(df, ["x", "y"], F.col("c"))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(19) == jobs(1)


def test_no_rows_and_no_class(spark):
    none = rows(spark, 1).limit(0)
    assert synth.fit_by(none, ["x"], F.col("c")) == {}
    assert list(synth.fit_by(rows(spark, 1), ["x"], F.when(F.col("w").isNull(), "only"))) == ["only"]
    assert synth.by_quota(spark, synth.fit_by(rows(spark, 2), ["x"], F.col("c")), {"c0": 0, "c1": 3}).count() == 3
