"""Refined percentiles against numpy: ties, spreads of any size, null keys, missing values, single rows."""

import math

import numpy as np
import pytest

from lapwing.operators import quantiles

QS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_equal_to_numpy(spark, bins):
    rng = np.random.default_rng(8)
    groups = {
        "normal": rng.normal(size=2000).tolist(), "ties": [1.0] * 500 + [2.0] * 3, "one": [5.5], "two": [-1.0, 4.0], None: list(map(float, range(101))), "wide": [-1.7e308, 1.7e308, 0.0, 1e-300, -1e-300, 3.0],
        "tails": np.exp(rng.normal(size=300) * 40).tolist(), "missing": [None, math.nan, math.inf, -math.inf, 3.0, 1.0],
    }
    rows = [(g, v, 0.5) for g, vs in groups.items() for v in vs] + [("none", None, 0.1), ("none", math.nan, 0.1)]
    df = spark.createDataFrame(rows, "g string, v double, q double").repartition(5)
    if bins == 2:
        df = df.where("g IS NULL OR g IN ('ties', 'one', 'two', 'missing')")
    got = {(r["g"], r["q"]): r["value"] for r in quantiles.percentiles(df, ["g"], "v", QS, bins).collect()}
    kept = {g: [v for v in vs if v is not None and math.isfinite(v)] for g, vs in groups.items() if bins > 2 or g in (None, "ties", "one", "two", "missing")}
    assert set(got) == {(g, q) for g in kept for q in QS}
    for g, vs in kept.items():
        s = sorted(vs)
        for q in QS:
            place = q * (len(s) - 1)
            a, b = s[math.floor(place)], s[math.ceil(place)]
            assert got[g, q] == a + (b - a) * (place - math.floor(place)), (g, q)


def test_nothing_and_bad_q(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert quantiles.percentiles(empty, ["g"], "v", [0.5]).collect() == []
    with pytest.raises(ValueError):
        quantiles.percentiles(empty, ["g"], "v", [1.5])


def test_no_task_keeps_a_group(spark):
    """Of a million distinct values a pass hands on counts of bins only."""
    df = spark.range(1_000_000).selectExpr("id % 1 AS g", "cast(hash(id) as double) + id / 1e7 AS v")
    got = quantiles.percentiles(df, ["g"], "v", [0.5])
    want = df.selectExpr("percentile(v, 0.5) AS p").first()["p"]
    assert abs(got.first()["value"] - want) < 1e-6
    plan = quantiles._refined(df.selectExpr("g AS __k0", "v"), spark.createDataFrame([(0, -1e9, 1e9, 3, 0)], "__k0 long, lo double, hi double, rank long, below long"), ["__k0"], 1024)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in text and "percentile" not in text
