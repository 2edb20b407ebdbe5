"""How far two recordings' clocks are apart, from the speed that both hold, checked by accelerations.

Coarse to fine: Spark reduces each channel to a grid of 0.2 s, on which a pair's lags over +-900 s are compared at once
(a matrix of windows, and by FFT over all the time that both cover); only the windows that are left, some minutes
per pair, are looked at again in the samples themselves, at steps of 0.01 s.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.functions.missing import present
from lapwing.sessions import settled

#: What makes a pair, and the steps of the search (seconds).
MIN_SPEED_R, MIN_ACCEL_R, TIE_R, MIN_POINTS = 0.99, 0.6, 0.02, 60
REACH, COARSE, FINE, REFINE, WINDOW, EVERY = 900.0, 0.2, 0.01, 1.0, 300.0, 1.0
#: The share of a sum of squares that is rounding, and how close sums are to the correlations they give.
STILL, NEAR_R = 1e-24, 1e-6
#: The windows that are tried, in their order.
KINDS = ("first", "liveliest")
#: Up to so many lags are cheaper one by one than by FFT.
FEW = 24
_FOUND = "lag double, r double, n long, accel_r double, ok boolean, reason string"


def pearson(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlation along the last axis over places where both are numbers, -2 where it can't be told (no movement but rounding), and their count."""
    both = np.isfinite(x) & np.isfinite(y)
    n = both.sum(-1)
    x, y, k = np.where(both, x, 0.0), np.where(both, y, 0.0), np.maximum(n, 1)[..., None]
    flat = STILL * (x * x).sum(-1), STILL * (y * y).sum(-1)
    x, y = np.where(both, x - x.sum(-1, keepdims=True) / k, 0.0), np.where(both, y - y.sum(-1, keepdims=True) / k, 0.0)
    xx, yy = (x * x).sum(-1), (y * y).sum(-1)
    scale = np.sqrt(xx * yy)
    moved = (n >= MIN_POINTS) & (xx > flat[0]) & (yy > flat[1]) & (scale > 0)
    return np.where(moved, (x * y).sum(-1) / np.where(scale > 0, scale, 1.0), -2.0), n


def slide(fixed: np.ndarray, v: np.ndarray, starts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`pearson` of `fixed` and v[start + k * step] for many starts from sums, without a row per start: also which starts it is sure of."""
    lo, points = int(starts.min()), len(fixed)
    at = np.arange(lo, int(starts.max()) + (points - 1) * step + 1)
    y = np.where((at >= 0) & (at < len(v)), v[np.clip(at, 0, len(v) - 1)], np.nan)
    mx, my = np.isfinite(fixed), np.isfinite(y)
    x = np.where(mx, fixed - (fixed[mx].mean() if mx.any() else 0.0), 0.0)
    y = np.where(my, y - (y[my].mean() if my.any() else 0.0), 0.0)
    wanted = [(my, mx), (my, x), (my, x * x), (y, mx), (y * y, mx), (y, x)]
    sums = np.zeros((len(wanted), int(starts.max()) - lo + 1))
    for k, (b, a) in enumerate(wanted):
        for phase in range(min(step, sums.shape[1])):
            part = np.correlate(b[phase::step].astype(float), a.astype(float), "valid")
            sums[k, phase::step] = part[: len(sums[k, phase::step])]
    n, sx, sxx, sy, syy, sxy = sums[:, starts - lo]
    n = np.round(n).astype(np.int64)
    k = np.maximum(n, 1)
    vx, vy = sxx - sx * sx / k, syy - sy * sy / k
    sure = (n < MIN_POINTS) | (vx > 1e-6 * sxx) & (vy > 1e-6 * syy)
    good = sure & (n >= MIN_POINTS)
    return np.where(good, (sxy - sx * sy / k) / np.sqrt(np.where(good, vx * vy, 1.0)), -2.0), n, sure


def curve(x: np.ndarray, y: np.ndarray, lags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`pearson` of x[k] and y[k + lag] for many lags over all places that both cover, by FFT of the sums it needs."""
    size = 1 << int(np.ceil(np.log2(len(x) + len(y) + 1)))
    mx, my = np.isfinite(x), np.isfinite(y)
    x, y = np.where(mx, x - np.mean(x[mx]) if mx.any() else 0.0, 0.0), np.where(my, y - np.mean(y[my]) if my.any() else 0.0, 0.0)
    fx = {k: np.conj(np.fft.rfft(v, size)) for k, v in (("1", mx.astype(float)), ("x", x), ("xx", x * x))}
    fy = {k: np.fft.rfft(v, size) for k, v in (("1", my.astype(float)), ("y", y), ("yy", y * y))}
    at = lambda a, b: np.fft.irfft(fx[a] * fy[b], size)[lags % size]
    n = np.round(at("1", "1"))
    k = np.maximum(n, 1)
    sx, sy = at("x", "1"), at("1", "y")
    vx, vy = at("xx", "1") - sx * sx / k, at("1", "yy") - sy * sy / k
    reach = (lags > -len(x)) & (lags < len(y)) & (n >= MIN_POINTS * EVERY / COARSE)
    good = reach & (vx > 1e-9 * np.sum(x * x)) & (vy > 1e-9 * np.sum(y * y))
    return np.where(good, (at("x", "y") - sx * sy / k) / np.sqrt(np.where(good, vx * vy, 1.0)), -2.0), np.where(reach, n, 0).astype(np.int64)


def _curve_at(x: np.ndarray, y: np.ndarray, lags: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, None]:
    """`curve` at the wanted lags, -2 at the others; few are correlated one by one."""
    if wanted.sum() > FEW:
        return np.where(wanted, curve(x, y, lags)[0], -2.0), None
    out = np.full(len(lags), -2.0)
    for k in np.flatnonzero(wanted):
        lo, hi = max(0, -lags[k]), min(len(x), len(y) - lags[k])
        if hi > lo:
            r, n = pearson(x[lo:hi], y[lo + lags[k] : hi + lags[k]])
            out[k] = r if n >= MIN_POINTS * EVERY / COARSE else -2.0
    return out, None


def _grid(rows: pd.DataFrame, channels: list[str]) -> tuple[int, dict[str, np.ndarray]]:
    """Each channel (its place in `channels`) held on ticks of the coarse grid, NaN outside its own samples; the first tick."""
    if rows.empty:
        return 0, {}
    channel, tick, value = rows["channel"].to_numpy(), rows["tick"].to_numpy(), rows["v"].to_numpy(float)
    first, last = int(tick.min()), int(tick.max())
    out = {}
    for k, c in enumerate(channels):
        mine = channel == k
        if mine.any():
            v, at = np.full(last - first + 1, np.nan), tick[mine] - first
            v[at] = value[mine]
            before = np.maximum.accumulate(np.where(np.isfinite(v), np.arange(len(v)), -1))
            out[c] = np.where((before >= 0) & (np.arange(len(v)) <= at.max()), v[before], np.nan)
    return first, out


def _windows(v: np.ndarray, starts: np.ndarray, points: int, step: int) -> np.ndarray:
    """v at starts + k * step, NaN outside."""
    at = starts[:, None] + np.arange(points) * step
    return np.where((at >= 0) & (at < len(v)), v[np.clip(at, 0, len(v) - 1)], np.nan)


def _axes(left: dict, right: dict, accel: tuple[str, ...], score) -> np.ndarray | None:
    """The median over the axes that both have and that can be compared."""
    found = [score(left[c], right[c])[0] for c in accel if c in left and c in right]
    if not found:
        return None
    known = np.where(np.stack(found) > -2, np.stack(found), np.nan)
    some = np.isfinite(known).any(axis=0)
    if not some.any():
        return None
    out = np.full(known.shape[1], np.nan)
    out[some] = np.nanmedian(known[:, some], axis=0)
    return out


def candidates(a0: int, a: dict, b0: int, b: dict, speed: str, accel: tuple[str, ...], expect: float) -> list[tuple[str, float, float, float]]:
    """(kind, lag, begin, end): the best lag over the first minutes that both cover, and the one that accelerations like best over all of it."""
    if speed not in a or speed not in b:
        return []
    lags = round(expect / COARSE) + np.arange(-round(REACH / COARSE), round(REACH / COARSE) + 1)
    step, points = round(EVERY / COARSE), round(WINDOW / EVERY)
    begin = np.maximum(a0, b0 - lags)
    out = []
    # one recording's first minutes stay, the other's move along: sums say which lags may be best, and these are compared
    r, n, sure = np.empty(len(lags)), np.empty(len(lags), np.int64), np.empty(len(lags), bool)
    later = lags >= b0 - a0
    if later.any():
        r[later], n[later], sure[later] = slide(_windows(a[speed], np.array([0]), points, step)[0], b[speed], (a0 + lags - b0)[later], step)
    if not later.all():
        r[~later], n[~later], sure[~later] = slide(_windows(b[speed], np.array([0]), points, step)[0], a[speed], (b0 - lags - a0)[~later], step)
    close = np.flatnonzero(~sure | (r >= r.max() - TIE_R - NEAR_R) & (r > -2))
    r[:] = -2.0
    for some in np.array_split(close, 1 + len(close) // 1000):
        r[some], n[some] = pearson(_windows(a[speed], (begin - a0)[some], points, step), _windows(b[speed], (begin + lags - b0)[some], points, step))
    if (r > -2).any():
        tied = np.flatnonzero(r >= r.max() - TIE_R)
        k = min(tied, key=lambda k: (-n[k], abs(lags[k] * COARSE - expect)))
        out.append(("first", lags[k] * COARSE, begin[k] * COARSE, begin[k] * COARSE + WINDOW))
    shift = lags + a0 - b0
    whole, n = curve(a[speed], b[speed], shift)
    good = whole >= MIN_SPEED_R - 0.01  # the grid blurs it a little; the samples decide
    like = _axes(a, b, accel, lambda x, y: _curve_at(x, y, shift, good)) if good.any() else None
    good &= (like >= MIN_ACCEL_R - 0.1) if like is not None else True
    if good.any():
        k = max(np.flatnonzero(good), key=lambda k: (like[k] if like is not None else whole[k], n[k]))
        # of the time that both cover, the minutes in which the speed varies most
        lo, hi = max(a0, b0 - lags[k]), min(a0 + len(a[speed]), b0 + len(b[speed]) - lags[k])
        starts = np.arange(lo, max(lo + 1, hi - round(WINDOW / COARSE) + 1), round(WINDOW / COARSE / 4))
        with np.errstate(all="ignore"):
            spread = np.nan_to_num(np.nanstd(_windows(a[speed], starts - a0, points, step), axis=1), nan=-1.0)
        start = starts[int(np.argmax(spread))]
        out.append(("liveliest", lags[k] * COARSE, start * COARSE, start * COARSE + WINDOW))
    return out


def _held(t: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The last sample at or before each time, NaN before the first and after the last."""
    if not len(t):
        return np.full(at.shape, np.nan)
    k = np.searchsorted(t, at, side="right") - 1
    return np.where((k >= 0) & (at <= t[-1]), v[np.clip(k, 0, None)], np.nan)


def settle(a: dict, b: dict, speed: str, accel: tuple[str, ...], lag: float, begin: float, end: float, expect: float) -> tuple:
    """(lag, r, n, accel_r, ok, reason) from the samples {channel: (t, v)} of a window: the speed's best lag near `lag`, which accelerations then pin down."""
    at = np.arange(begin, end, EVERY)
    fixed = {c: _held(*a[c], at) for c in a}
    score = lambda c, lags: pearson(fixed[c][None, :], _held(*b[c], at[None, :] + lags[:, None]))
    both = lambda lags: _axes({c: c for c in fixed}, {c: c for c in b}, accel, lambda c, _: score(c, lags))
    if speed not in a or speed not in b:
        return lag, -1.0, 0, None, False, "no samples of the speed"
    near = lag + np.arange(-round(COARSE / FINE), round(COARSE / FINE) + 1) * FINE
    r, n = score(speed, near)
    k = max(range(len(near)), key=lambda k: (r[k], -abs(near[k] - lag)))
    best, best_r, best_n = near[k], r[k], n[k]
    like = both(np.array([best]))
    like = None if like is None else float(like[0])
    if like is not None:
        around = best + np.arange(-round(REFINE / FINE), round(REFINE / FINE) + 1) * FINE
        liked, (r, n) = both(around), score(speed, around)
        fit = np.flatnonzero((np.nan_to_num(liked, nan=-2.0) > like) & (r >= MIN_SPEED_R) & (n >= MIN_POINTS))
        if len(fit):
            k = max(fit, key=lambda k: (liked[k], -abs(around[k] - best)))
            best, best_r, best_n, like = around[k], r[k], n[k], float(liked[k])
    if best_n < MIN_POINTS or best_r < MIN_SPEED_R:
        reason = f"speeds correlate by {best_r:.3f} only"
    elif abs(best - expect) > REACH:
        reason = "the lag is out of reach"
    elif like is not None and like < MIN_ACCEL_R:
        reason = f"accelerations correlate by {like:.3f} only"
    else:
        reason = None
    return float(round(best, 6)), float(max(best_r, -1.0)), int(best_n), like, reason is None, reason


def find_lags(left: DataFrame, right: DataFrame, speed: str = "speed", accel: tuple[str, ...] = ("ax", "ay", "az"), expect: DataFrame | None = None) -> DataFrame:
    """(pair, lag, r, n, accel_r, ok, reason) of pairs of recordings (pair, channel, t, v): left at t is right at t + lag.

    `expect` (pair, expect) has the clocks' estimates, 0 where there is none. A pair is taken (`ok`) where the speeds
    correlate by 0.99, over 60 points a second apart at least, and the median of the accelerations (if any axis is in
    both) by 0.6. Two windows of five minutes are tried: the first that both cover at the lag, then the one in which
    the speed varies most at the lag that all the common time likes best. Of two refused ones the better by `r` is returned.
    Missing samples are left out; a pair without common time has one row with ok false. The grid has five rows a second and channel.
    Each side is read twice, for the grid and for the windows. Sides that come dealt by `pair` aren't shuffled again.
    """
    channels = [speed, *accel]
    right = right.select(*(F.col(c).alias(c) for c in ("pair", "channel", "t", "v")))  # both may come from one table
    kind = left.schema["pair"].dataType.simpleString()
    place = (F.array_position(F.array(*map(F.lit, channels)), F.col("channel")) - 1).cast("int").alias("channel")
    clean = lambda df: df.where(F.col("channel").isin(channels)).select("pair", place, "t", present(F.col("v")).alias("v")).where("v IS NOT NULL")
    # what isn't a sample leaves a row of channel -1 for its pair, so that all pairs come out of one search
    usable = F.coalesce(F.col("channel").isin(channels) & F.col("pair").isNotNull() & present(F.col("v")).isNotNull(), F.lit(False))
    tick = F.ceil(F.col("t") / COARSE).cast("long")
    spots = lambda df: df.select("pair", F.when(usable, place).otherwise(-1).alias("channel"), F.when(usable, tick).otherwise(0).alias("tick"), "t", present(F.col("v")).alias("v"))
    grid = lambda df: spots(df).groupBy("pair", "channel", "tick").agg(F.max_by("v", "t").alias("v"))
    fixed = grid(left)
    fixed = fixed.join(expect.select("pair", "expect"), "pair", "left") if expect is not None else fixed.withColumn("expect", F.lit(0.0))
    fixed = fixed.withColumn("expect", F.coalesce("expect", F.lit(0.0)))

    def search(key: tuple, l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:  # noqa: E741
        l, r = l[l["channel"] >= 0], r[r["channel"] >= 0]  # noqa: E741
        found, want = [], 0.0
        if not l.empty and not r.empty:
            want = float(l["expect"].iloc[0])
            found = candidates(*_grid(l, channels), *_grid(r, channels), speed, accel, want)
        return pd.DataFrame([(key[0], *c, want) for c in found or [(None, None, None, None)]], columns=["pair", "kind", "lag", "begin", "end", "expect"])

    grids = fixed.groupBy("pair").cogroup(grid(right).groupBy("pair"))
    tried = grids.applyInPandas(search, f"pair {kind}, kind string, lag double, begin double, end double, expect double")

    def decide(key: tuple, l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:  # noqa: E741
        def series(df: pd.DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
            t = df["t"].to_numpy(float)
            order = np.argsort(t, kind="stable")
            t, v, channel = t[order], df["v"].to_numpy(float)[order], df["channel"].to_numpy()[order]
            return {c: (t[channel == k], v[channel == k]) for k, c in enumerate(channels) if (channel == k).any()}

        names, rows = ["pair", "kind", *(c.split()[0] for c in _FOUND.split(", "))], []
        for kind in KINDS:  # the second window is asked only where the first is refused
            mine, other = l[l["kind"] == kind], r[r["kind"] == kind]
            any_ = mine if not mine.empty else other
            if not any_.empty:
                lag, begin, end, want = (float(any_[c].iloc[0]) for c in ("lag", "begin", "end", "expect"))
                rows.append((key[0], kind, *settle(series(mine), series(other), speed, accel, lag, begin, end, want)))
                if rows[-1][6]:
                    break
        return pd.DataFrame(rows, columns=names)

    tried = settled(tried, "lags")  # one or two rows per pair, asked for by both sides
    given, tried = tried.select("pair").distinct(), tried.where("kind IS NOT NULL")
    again = tried.select(*(F.col(c).alias(c) for c in tried.columns))
    cut = lambda df, of, shift, more: clean(df).join(of, "pair").where((F.col("t") >= F.col("begin") + shift - more) & (F.col("t") <= F.col("end") + shift + more))
    more = 30.0  # seconds about a window: holds begin there, and lags move it a little
    windows = cut(left, tried, F.lit(0.0), more).groupBy("pair").cogroup(cut(right, again, F.col("lag"), more).groupBy("pair"))
    rows = windows.applyInPandas(decide, f"pair {kind}, kind string, {_FOUND}")
    rank = F.when(F.col("ok"), F.when(F.col("kind") == "first", 0).otherwise(1)).otherwise(2)
    names = [c.split()[0] for c in _FOUND.split(", ")]
    best = rows.groupBy("pair").agg(F.min_by(F.struct(*names), F.struct(rank, -F.col("r"))).alias("b")).select("pair", "b.*")
    none = F.coalesce("ok", F.lit(False)).alias("ok"), F.when(F.col("ok").isNull(), "no common time to compare").otherwise(F.col("reason")).alias("reason")
    return given.join(best, "pair", "left").select("pair", "lag", "r", "n", "accel_r", *none)
