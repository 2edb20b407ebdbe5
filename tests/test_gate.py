"""Passages through a gate circle: from outside, in its direction, not across breaks."""

import math

from lapwing.operators import segment


def test_gate_needs_arming_heading_and_an_unbroken_track(spark):
    a = [2 * math.pi * k / 200 for k in range(600)]
    ring = [("inside", k, k * 0.1, 50 * math.cos(x), 50 * math.sin(x)) for k, x in enumerate(a)]  # begins in the circle at (50, 0)
    there = [("back", k, k * 0.1, float(k - 100), 0.0) for k in range(200)]
    back = [("back", 200 + k, 20 + k * 0.1, float(100 - k), 0.0) for k in range(200)]
    hole = [("hole", k, k * 0.1 + (60 if k >= 200 else 0), 50 * math.cos(x), 50 * math.sin(x)) for k, x in enumerate(a[:500])]
    df = spark.createDataFrame(ring + there + back + hole, "session_id string, i long, t double, x double, y double")
    at = lambda s, x, y, **o: [round(r["t"], 1) for r in segment.visits(df.where(f"session_id = '{s}'"), x, y, 8.0, **o).orderBy("t").collect()]
    assert at("inside", 50.0, 0.0) == [20.0, 40.0]
    assert at("back", 0.0, 0.0) == [10.0]
    assert at("back", 0.0, 0.0, heading=math.pi) == [30.0]
    assert at("hole", 50.0, 0.0) == [19.9, 100.0]
