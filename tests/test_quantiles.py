"""Grouped quantiles whose ends are drawn closer, against plain sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import quantiles as q


@pytest.mark.parametrize("inside", [3, 40])
def test_ends_are_drawn_closer(spark, monkeypatch, inside):
    """Groups of all shapes: even, with one very common value, constant, small, empty and null; no group gathers more than a few values."""
    monkeypatch.setattr(q, "INSIDE", inside)
    rng = random.Random(inside)
    values = {"even": [rng.random() for _ in range(3000)], "common": [7.0] * 2000 + [rng.gauss(7, 3) for _ in range(900)], "constant": [1.0] * 500, "two": [1.0, 4.0], "none": [None] * 5, None: [float(i % 97) for i in range(800)]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    for share in (0.0, 0.001, 0.5, 0.9, 1.0):
        found = {r.g: (r.a, r.b) for r in q.group_quantiles(df, "g", {"a": (F.col("v"), share), "b": (-F.col("v"), 0.25)}).collect()}
        for g, vs in values.items():
            held = [v for v in vs if v is not None]
            want = (np.quantile(held, share), np.quantile([-v for v in held], 0.25)) if held else (None, None)
            assert found[g] == pytest.approx(want) if held else found[g] == want
