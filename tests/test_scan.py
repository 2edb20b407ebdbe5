"""Block scans against plain recurrences and session windows, at every size of block."""

import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lapwing.operators import resample, scan, segment


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(3)
    rows = [(s, int(i), i / 10 + (i // 40) * 5.0, None if rng.random() < 0.3 else float(rng.normal()), int(rng.integers(3))) for s in "ab" for i in range(500)]
    return spark.createDataFrame(rows, "session_id string, i long, t double, v double, label int").cache()


@pytest.mark.parametrize("rows", [1, 7, 64, 10_000])
def test_folds(samples, rows):
    on, off, v = F.col("label") == 1, F.col("label") == 2, F.col("v")
    folds = {"sum": scan.total(v), "top": scan.largest(v), "low": scan.smallest(v), "held": scan.latest(v, ["i"]), "latched": scan.latch(on, off, ["i"])}
    got = scan.scan(samples, ["session_id"], ["i"], scan.row_block("i", rows), folds)
    got = scan.scan(got, ["session_id"], ["i"], scan.row_block("i", rows), {"next": scan.latest(v, ["i"], True)}, backwards=True)
    w = Window.partitionBy("session_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("session_id").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(off, False).when(on, True), True).over(w)
    want = samples.select("*", F.coalesce(F.sum(v).over(w), F.lit(0.0)).alias("sum"), F.max(v).over(w).alias("top"), F.min(v).over(w).alias("low"), F.last(v, True).over(w).alias("held"), state.alias("latched"), F.last(v, True).over(back).alias("next"))
    rounded = lambda df: sorted(map(repr, df.withColumn("sum", F.round("sum", 9)).select("session_id", "i", "sum", "top", "low", "held", "latched", "next").collect()))
    assert rounded(got) == rounded(want)


@pytest.mark.parametrize("rows", [1, 7, 64, 10_000])
def test_islands(samples, rows):
    by_label = scan.islands(samples, ["session_id"], "i", scan.row_block("i", rows), ["label"], lambda a, b: a["label"] != b["label"])
    by_gap = scan.islands(samples, ["session_id"], "i", scan.row_block("i", rows), ["t"], lambda a, b: a["t"] - b["t"] > 3)
    for got, differs in ((by_label, lambda a, b: a["label"] != b["label"]), (by_gap, lambda a, b: a["t"] - b["t"] > 3)):
        for s in "ab":
            rows_ = sorted((r for r in got.where(F.col("session_id") == s).collect()), key=lambda r: r["i"])
            n = 0
            for k, r in enumerate(rows_):
                n += k > 0 and differs(r, rows_[k - 1])
                assert r["island"] == n


def test_holds_by_blocks(samples):
    left = samples.where("i % 3 = 0").select("session_id", "i", "t")
    right = samples.where("i % 7 = 2 AND v IS NOT NULL").select("session_id", "t", "v")
    for f, out in ((resample.hold, "held"), (resample.interpolate, "value"), (resample.nearest, "value")):
        want = sorted(map(repr, f(left, right).select("session_id", "i", out).collect()))
        for block in (0.5, 13.0, 1e6):
            assert sorted(map(repr, f(left, right, block=block).select("session_id", "i", out).collect())) == want


def recurrence(x, f):
    y, s1, s2 = np.empty_like(x), 0.0, 0.0
    for n, v in enumerate(x):
        y[n] = f.b * v + s1
        s1, s2 = 2 * f.b * v - f.a1 * y[n] + s2, f.b * v - f.a2 * y[n]
    return y


@pytest.mark.parametrize("cutoff", [0.02, 1.0, 49.0])
def test_filter_is_the_recurrence(spark, cutoff):
    f = scan.Biquad.lowpass(cutoff, 100.0)
    x = np.random.default_rng(1).normal(size=5000) + 3
    want = recurrence(x, f)
    assert np.abs(f.run(x)[0] - want).max() < 1e-9 and np.abs(f.run(x[:300])[0] - want[:300]).max() < 1e-9
    df = spark.createDataFrame([("s", int(i), float(v)) for i, v in enumerate(x)], "k string, i long, x double")
    for rows in (1, 300, 2048, 100_000):
        if rows == 1:
            got, n = scan.biquad(df.where("i < 40"), ["k"], "i", "x", "y", f, rows=1), 40
        else:
            got, n = scan.biquad(df, ["k"], "i", "x", "y", f, rows=rows), 5000
        y = np.array([r["y"] for r in got.orderBy("i").collect()])
        assert np.abs(y - want[:n]).max() < 1e-9
    back = np.array([r["y"] for r in scan.biquad(df, ["k"], "i", "x", "y", f, backwards=True, rows=700).orderBy("i").collect()])
    assert np.abs(back - recurrence(x[::-1].copy(), f)[::-1]).max() < 1e-9


def test_zero_phase_and_high_pass(spark):
    x = [None if k % 11 == 3 else float(np.sin(k / 5) + (k % 2)) for k in range(400)]
    df = spark.createDataFrame([("s", "c", k, k / 100, v) for k, v in enumerate(x)], "session_id string, channel string, i long, t double, v double")
    f = scan.Biquad.lowpass(5.0, 100.0)
    import pandas as pd

    filled = pd.Series(x, dtype=float).ffill().bfill().to_numpy()
    twice = recurrence(recurrence(filled, f)[::-1].copy(), f)[::-1]
    got = [r["filtered"] for r in segment.lowpass(df, 5.0, 100.0, zero_phase=True).orderBy("i").collect()]
    assert all(np.isnan(g) if v is None else abs(g - w) < 1e-9 for g, v, w in zip(got, x, twice, strict=True))
    zero = np.array([v or 0.0 for v in x])
    got = [r["filtered"] for r in segment.lowpass(df, 5.0, 100.0, high=True).orderBy("i").collect()]
    assert np.abs(np.array(got) - (zero - recurrence(zero, f))).max() < 1e-9


def test_one_session_is_many_tasks(spark):
    df = spark.range(1_000_000).select((F.col("id") % 1).alias("session_id"), F.lit("c").alias("channel"), F.col("id").alias("i"), (F.col("id") / 100).alias("t"), F.sin(F.col("id") / 50.0).alias("v"), F.lit(36.0).alias("speed"))
    far = segment.distance(df, "speed", 100.0)
    assert abs(far.agg(F.max("distance")).first()[0] - 100_000.0) < 1e-3
    plan = far._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(session_id#\w+, __block#", plan)
    spread = scan.scan(df, ["session_id"], ["i"], scan.row_block(), {"d": scan.total(F.col("speed"))}).groupBy(F.spark_partition_id()).count().count()
    assert spread > 1
    assert segment.lowpass(df, 2.0, 100.0).where("abs(filtered) <= 1.1").count() == 1_000_000
