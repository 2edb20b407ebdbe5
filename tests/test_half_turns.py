"""Curvature where a track turns back on itself, against plain Python."""

import math
import random

from lapwing.operators import geo


def by_hand(points):
    n = len(points)
    g = [[(p[min(k + 1, n - 1)] - p[max(k - 1, 0)]) / (1 if k in (0, n - 1) else 2) for k in range(n)] for p in zip(*points, strict=True)]
    a = [math.atan2(y, x) for x, y in zip(*g, strict=True)]
    swing = [0.0]
    for before, now in zip(a, a[1:], strict=False):
        d = now - before
        s = d - 2 * math.pi * math.floor((d + math.pi) / (2 * math.pi))
        swing.append(math.pi if s == -math.pi and d > 0 else s)
    turn = [swing[1] if k == 0 else swing[k] if k == n - 1 else (swing[k] + swing[k + 1]) / 2 for k in range(n)]
    return [abs(t / step) if (step := math.sqrt(x * x + y * y)) > 0.05 else 0.0 for t, x, y in zip(turn, *g, strict=True)]


def test_half_turns_keep_their_side(spark):
    rng = random.Random(4)
    points = [(0.0, 0.0)]
    while len(points) < 12_000:  # out by steps, and back by multiples of one, so headings are often half a turn apart
        x, y = points[-1]
        dx, dy = rng.randint(-9, 9) * 715.53, rng.randint(-50, 50) * 11.054
        points += [(x + dx, y + dy), (x + 2 * dx, y + 2 * dy), (x + dx, y + dy), (x - dx, y - dy)]
    df = spark.createDataFrame([("s", k, *p) for k, p in enumerate(points)], "session_id string, i long, x double, y double")
    got = [r["curvature"] for r in geo.curvature(df).orderBy("i").collect()]
    want = by_hand(points)
    off = [k for k, (a, b) in enumerate(zip(got, want, strict=True)) if abs(a - b) > 1e-9]
    assert not off, (len(off), off[:5])
