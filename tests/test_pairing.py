"""Lags of planted clocks, refused pairs, the FFT's curve against plain correlation."""

import numpy as np
import pytest

from lapwing.operators import pairing


def test_curve_is_the_correlation():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=700).cumsum(), rng.normal(size=900).cumsum()
    x[50:90], y[300:340] = np.nan, np.nan
    lags = np.arange(-650, 860, 7)
    r, n = pairing.curve(x, y, lags)
    for lag, got, count in zip(lags, r, n, strict=True):
        k = np.arange(len(x))
        k = k[(k + lag >= 0) & (k + lag < len(y))]
        a, b = x[k], y[k + lag]
        good = np.isfinite(a) & np.isfinite(b)
        if good.sum() >= pairing.MIN_POINTS * 5:
            assert count == good.sum() and abs(got - np.corrcoef(a[good], b[good])[0, 1]) < 1e-6
        else:
            assert got == -2


def _drive(seed, seconds, still=0.0):
    rng = np.random.default_rng(seed)
    t = np.arange(0, seconds, 0.01)
    smooth = lambda width: np.convolve(rng.normal(size=len(t) + width), np.ones(width) / np.sqrt(width), "valid")[: len(t)]
    out = {"speed": 60 + 20 * smooth(800), **{c: smooth(60) for c in ("ax", "ay", "az")}}
    for v in out.values():
        v[t < still] = v[0]
    return t, out


def _rows(pair, t, series, lo, hi, shift, every=1):
    at = np.flatnonzero((t >= lo) & (t < hi))[::every]
    return [(pair, c, float(round(t[k] - shift, 4)), float(v[k])) for c, v in series.items() for k in at]


@pytest.fixture(scope="module")
def found(spark):
    kind = "pair string, channel string, t double, v double"
    left, right = [], []
    t, s = _drive(1, 700)
    left += _rows("planted", t, s, 200, 600, 200, 2)  # its clock begins at 200
    right += _rows("planted", t, s, 50, 700, 200 - 123.47, 1)  # right's clock shows 123.47 more
    left += _rows("behind", t, s, 100, 420, 100)
    right += _rows("behind", t, s, 40, 500, 100 + 71.3)
    other = _drive(2, 700)[1]
    left += _rows("strangers", t, s, 0, 400, 0, 5)
    right += _rows("strangers", t, other, 0, 400, 0, 5)
    left += _rows("other axes", t, s, 0, 400, 0, 5)
    right += _rows("other axes", t, {**other, "speed": s["speed"]}, 0, 400, 0, 5)
    left += _rows("no axes", t, {"speed": s["speed"]}, 0, 400, 0, 5)
    right += _rows("no axes", t, {"speed": s["speed"]}, 10, 400, 0, 5)
    left += [("alone", "speed", float(k), float(k % 7)) for k in range(100)] + [("short", "speed", float(k), float(k % 7)) for k in range(20)]
    right += [("short", "speed", float(k), float(k % 7)) for k in range(20)] + [("planted", "speed", float(k), None) for k in range(5)]
    rows = pairing.find_lags(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)).collect()
    return {r["pair"]: r for r in rows}


def test_planted_lags_are_found(found):
    for pair, lag in (("planted", 123.47), ("behind", -71.3), ("no axes", 0.0)):
        assert found[pair]["ok"] and abs(found[pair]["lag"] - lag) <= 0.0101 and found[pair]["reason"] is None, found[pair]
    assert found["planted"]["accel_r"] > 0.95 and found["no axes"]["accel_r"] is None


def test_bad_pairs_are_refused(found):
    assert not found["strangers"]["ok"] and "speeds" in found["strangers"]["reason"]
    assert not found["other axes"]["ok"] and "accelerations" in found["other axes"]["reason"]
    assert found["alone"]["reason"] == found["short"]["reason"] == "no common time to compare"
    assert len(found) == 7


def test_first_minutes_at_rest(spark):
    """Five minutes at rest say nothing; the window with the most movement does."""
    t, s = _drive(3, 900, still=420)
    kind = "pair string, channel string, t double, v double"
    left, right = _rows("p", t, s, 0, 900, 0, 4), _rows("p", t, s, 0, 900, -33.2, 4)
    got = pairing.find_lags(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)).first()
    assert got["ok"] and abs(got["lag"] - 33.2) <= 0.041
