"""Snapshots against numpy: gates of every mode, windows of laps, missing numbers, constant channels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwing.operators import snapshot


def test_gates(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, -2.0, 5.0, None, math.nan, math.inf)], "g double")
    of = lambda *a: [r[0] for r in df.select(snapshot.gate_keeps(F.col("g"), *a)).collect()]
    assert of() == [False, True, True, True, False, False, False]
    assert of("range", 0, 1) == [True, True, False, False, False, False, False]
    assert of("outside", 0, 1) == [False, False, True, True, False, False, False]
    for bad in (("range", 0, None), ("other",)):
        with pytest.raises(ValueError):
            of(*bad)


@pytest.mark.parametrize("gated", [False, True])
def test_equal_to_numpy(spark, gated):
    rng = np.random.default_rng(6)
    rows = [("s", c, int(i), i / 10, None if i % 13 == 5 else math.nan if i % 17 == 3 else 2.5 if c == "flat" else float(rng.normal()), float(i % 3)) for c in ("a", "flat") for i in range(300)]
    rows += [("s", "empty", 0, 1.0, None, 1.0), ("other", "a", 0, 5.0, 7.0, 1.0)]
    df = spark.createDataFrame(rows, "session_id string, channel string, i long, t double, v double, g double")
    laps = spark.createDataFrame([("s", "L1", 2.0, 11.05, True), ("s", "L2", 11.05, 20.0, True), ("s", "out", 20.0, 30.0, False)], "session_id string, label string, start_t double, end_t double, complete boolean")
    got = {(r["session_id"], r["channel"], r["window"]): r for r in snapshot.snapshot(snapshot.in_laps(df, laps, 3.0 if gated else None), 10, snapshot.gate_keeps(F.col("g")) if gated else None).collect()}
    spans = {"all": (-1, 1e9), "L1": (2.0, 11.05), "L2": (11.05, 20.0)}
    want = {(s, c, w) for s, c, _, t, _, _ in rows for w, (a, b) in spans.items() if a <= t < b and (w == "all" or s == "s")}
    assert set(got) == want
    for (s, c, w), r in got.items():
        a, b = spans[w]
        mine = [x for x in rows if x[0] == s and x[1] == c and a <= x[3] < b]
        kept = [x for x in mine if not gated or x[5] != 0]
        v = np.array([x[4] for x in kept if x[4] is not None and math.isfinite(x[4])])
        assert (r["n"], r["excluded"], r["skipped"]) == (len(v), len(mine) - len(kept), len(kept) - len(v))
        lo, hi = (v.min(), v.max()) if len(v) else (0.0, 1.0)
        pad = max(0.5, abs(lo) * 1e-3) if hi <= lo else 0.0
        assert (r["lo"], r["hi"]) == (lo - pad, hi + pad)
        assert r["counts"] == np.histogram(v, np.linspace(lo - pad, hi + pad, 11))[0].tolist()
        if len(v):
            assert (r["min"], r["max"]) == (v.min(), v.max()) and abs(r["mean"] - v.mean()) < 1e-9 and abs(r["std"] - v.std()) < 1e-9


def test_passes(spark):
    """One pass for all ranges, and one for all counts, however many windows and channels."""
    df = spark.range(100).selectExpr("'s' AS session_id", "concat('c', id % 7) AS channel", "cast(id AS double) AS v", "cast(id % 5 AS string) AS lap")
    text = snapshot.snapshot(df)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Range (0, 100") == 1
