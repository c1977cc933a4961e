"""Exact quantiles against numpy."""

import math

import numpy as np
import pytest

from tonemill.operators.quantiles import exact_quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(0)
    parts = {"normal": rng.normal(0, 1, 1001), "wide": 2.0 ** rng.integers(-900, 900, 500), "ends": np.array([-1.7e308, 1.7e308, 0.0, 1e-320]), "equal": np.full(300, 7.0), "one": np.array([3.5]), None: rng.integers(0, 5, 400).astype(float)}
    rows = [(k, float(x)) for k, v in parts.items() for x in v] + [("none", None), ("one", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {(r.k, r.share): r.value for r in exact_quantiles(df, "x", SHARES, ["k"], parts=16).collect()}
    assert len(got) == len(SHARES) * len(parts)
    for k, v in parts.items():
        v = np.sort(v)
        for s in SHARES:
            at = s * (len(v) - 1)
            a, b = float(v[math.floor(at)]), float(v[math.ceil(at)])
            assert got[k, s] == pytest.approx(a + (b - a) * (at - math.floor(at)) if a != b else a, rel=1e-12)


def test_infinite_values_and_no_rows(spark):
    df = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (5.0,), (float("inf"),), (float("inf"),), (9.0,)], "x double")
    got = {r.share: r.value for r in exact_quantiles(df, "x", [0.0, 1 / 6, 0.5, 4 / 6, 1.0], parts=4).collect()}
    assert got[0.0] == -math.inf and got[0.5] == 5.0 and got[4 / 6] == 9.0 and got[1.0] == math.inf
    assert exact_quantiles(df.limit(0), "x", [0.5]).count() == 0
