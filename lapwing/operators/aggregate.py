"""Statistics, histograms, heatmaps, envelopes, spectra."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.missing import finite, present


def eight_stats(v: str = "v", order: str = "i") -> list[Column]:
    """Minimum, maximum, largest magnitude, mean, first, last, change and population deviation of the finite samples."""
    x = present(F.col(v))
    at = F.when(x.isNotNull(), F.col(order))
    start, end = F.min_by(x, at), F.max_by(x, at)
    return [F.min(x).alias("min"), F.max(x).alias("max"), F.max(F.abs(x)).alias("abs_max"), F.avg(x).alias("mean"), start.alias("start"), end.alias("end"), (end - start).alias("change"), F.stddev_pop(x).alias("std"), F.count(x).alias("n")]


def stats(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    return samples.groupBy(*keys).agg(*eight_stats())


def in_windows(samples: DataFrame, windows: DataFrame, closed: bool = False) -> DataFrame:
    """Samples with the windows (session_id, start_t, end_t, ..) that hold them; half open unless `closed`."""
    inside = (F.col("t") >= F.col("start_t")) & ((F.col("t") <= F.col("end_t")) if closed else (F.col("t") < F.col("end_t")))
    return samples.join(windows, "session_id").where(inside)


def cursor_stats(samples: DataFrame, a: float, b: float) -> DataFrame:
    """Minimum, maximum, mean and number of finite samples between two cursors, ends included."""
    x = present(F.col("v"))
    inside = samples.where(F.col("t").between(min(a, b), max(a, b)))
    return inside.groupBy("session_id", "channel").agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.count(x).alias("n"))


def _edges(lo: Column, hi: Column) -> tuple[Column, Column]:
    """A range without width is padded."""
    pad = F.when(lo == hi, F.greatest(F.lit(0.5), F.abs(lo) * 0.001)).otherwise(0.0)
    return lo - pad, hi + pad


def bin_of(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin from 0; the last bin holds its upper edge; NULL outside. Edges are lo + k * width, and decide."""
    width = (hi - lo) / bins
    edge = lambda k: F.when(k >= bins, hi).otherwise(lo + k * width)
    k = F.least(F.greatest(F.floor((v - lo) / width), F.lit(0)), F.lit(bins - 1))
    k = F.when(v < edge(k), k - 1).when((v >= edge(k + 1)) & (k < bins - 1), k + 1).otherwise(k)
    return F.when((v >= lo) & (v <= hi), k.cast("int"))


def histogram(samples: DataFrame, bins: int = 40, keys: Sequence[str] = ("channel",), colour: str | None = None) -> DataFrame:
    """Counts per bin of equal width over the finite samples' range, empty bins included."""
    bins = max(4, min(500, bins))
    valid = samples.where(finite(F.col("v")))
    lo, hi = _edges(F.min("v"), F.max("v"))
    ranges = valid.groupBy(*keys).agg(lo.alias("lo"), hi.alias("hi"))
    binned = valid.join(F.broadcast(ranges) if not keys else ranges, list(keys)).withColumn("bin", bin_of(F.col("v"), F.col("lo"), F.col("hi"), bins))
    extra = [] if colour is None else [F.avg(present(F.col(colour))).alias("colour_mean"), F.min(present(F.col(colour))).alias("colour_min"), F.max(present(F.col(colour))).alias("colour_max")]
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"), *extra)
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = grid.join(counts, [*keys, "bin"], "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)).cast("long")).withColumn("left_edge", F.col("lo") + F.col("bin") * ((F.col("hi") - F.col("lo")) / bins)).drop("lo", "hi")


def summary(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Minimum, maximum, mean, median, deviation and the 5th and 95th percentile, linear between samples."""
    x = present(F.col("v"))
    p = lambda q: F.percentile(x, q)
    return samples.groupBy(*keys).agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), p(0.5).alias("median"), F.stddev_pop(x).alias("std"), p(0.05).alias("p5"), p(0.95).alias("p95"))


def heatmap(df: DataFrame, x: str, y: str, z: str | None = None, bins: tuple[int, int] = (60, 40), ranges: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Counts (and mean, least and largest z) per cell; cells without rows are left out, rows out of range too."""
    nx, ny = (max(8, min(200, b)) for b in bins)
    valid = df.where(finite(F.col(x)) & finite(F.col(y)))
    if ranges is None:
        span = valid.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
        pad = lambda a, b, s: F.col(a) + s * F.when(F.col(a) == F.col(b), 0.5).otherwise(0.0)
        span = span.select(pad("x0", "x1", -1).alias("x0"), pad("x1", "x0", 1).alias("x1"), pad("y0", "y1", -1).alias("y0"), pad("y1", "y0", 1).alias("y1"))
        valid = valid.crossJoin(F.broadcast(span))  # one row
    else:
        valid = valid.select("*", *(F.lit(float(v)).alias(n) for v, n in zip(ranges, ("x0", "x1", "y0", "y1"), strict=True)))
    cells = valid.select(bin_of(F.col(x), F.col("x0"), F.col("x1"), nx).alias("bx"), bin_of(F.col(y), F.col("y0"), F.col("y1"), ny).alias("by"), *([present(F.col(z)).alias("z")] if z else []))
    extra = [F.avg("z").alias("z_mean"), F.min("z").alias("z_min"), F.max("z").alias("z_max")] if z else []
    return cells.where("bx IS NOT NULL AND by IS NOT NULL").groupBy("bx", "by").agg(F.count("*").alias("n"), *extra)


def envelope(samples: DataFrame, buckets: int = 500, keys: Sequence[str] = ("session_id", "channel")) -> DataFrame:
    """Mean, least and largest value of equally filled buckets; series of up to 2 * buckets samples stay as they are.

    `i` counts a series' samples from 0. Bucket k begins at trunc(k * (n / buckets)), in doubles.
    """
    w = Window.partitionBy(*keys)
    s = samples.withColumn("n", F.count("*").over(w).cast("double"))
    step = F.col("n") / buckets
    edge = lambda k: F.when(k >= buckets, F.col("n")).otherwise(F.floor(k * step))
    k = F.least(F.floor((F.col("i") + 1) * buckets / F.col("n")), F.lit(buckets - 1))
    k = F.when(F.col("i") < edge(k), k - 1).when(F.col("i") >= edge(k + 1), k + 1).otherwise(k)
    bucket = F.when(F.col("n") > 2 * buckets, k).otherwise(F.col("i")).cast("long")
    x = present(F.col("v"))
    g = s.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(((F.min("t") + F.max("t")) / 2).alias("t"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n"))
    return g


def decimate(samples: DataFrame, most: int, keys: Sequence[str] = ("session_id", "channel")) -> DataFrame:
    """Every n-th real sample, so that at most `most` are left."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return samples.withColumn("__stride", F.ceil(n / most)).where("i % __stride = 0").drop("__stride")


WINDOWS = {
    "hann": lambda n: 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)),
    "hamming": lambda n: 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1)),
    "blackman": lambda n: 0.42 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)) + 0.08 * np.cos(4 * np.pi * np.arange(n) / (n - 1)),
    "rectangular": np.ones,
    "flattop": lambda n: sum(a * np.cos(2 * np.pi * k * np.arange(n) / (n - 1)) for k, a in enumerate((0.21557895, -0.41663158, 0.277263158, -0.083578947, 0.006947368))),
}


def welch(samples: DataFrame, rate: float, points: int = 1024, overlap: float = 0.5, window: str = "hann", keys: Sequence[str] = ("session_id", "channel")) -> DataFrame:
    """One-sided power density by Welch's method: (keys, bin, frequency, psd, amplitude).

    Samples go to the segments that hold them, so each segment is a group of `points` samples and a
    long series is many groups; a last segment ends at the last sample. Missing samples are filled
    before. The mean of each segment is taken off.
    """
    points = 1 << max(4, min(15, int(np.ceil(np.log2(max(points, 16))))))
    step = max(1, int(round(points * (1 - max(0.0, min(0.95, overlap))))))
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("i")
    back = Window.partitionBy(*keys).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    x = present(F.col("v"))
    s = samples.select(*keys, "i", x.alias("v"), F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    known = F.when(F.col("v").isNotNull(), F.struct("i", "v"))
    s = s.select(*keys, "i", "v", "n", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("p"), F.last(known, True).over(back).alias("q"))
    fill = F.when(F.col("p.i").isNull(), F.col("q.v")).when(F.col("q.i").isNull(), F.col("p.v")).when(F.col("p.i") == F.col("q.i"), F.col("p.v"))
    s = s.withColumn("v", F.coalesce(fill.otherwise(F.col("p.v") + (F.col("q.v") - F.col("p.v")) * (F.col("i") - F.col("p.i")) / (F.col("q.i") - F.col("p.i"))), F.lit(0.0)))
    top = F.greatest(F.floor((F.col("n") - points) / step), F.lit(0))
    first = F.greatest(F.ceil((F.col("i") - points + 1) / step), F.lit(0))
    end = F.least(F.floor(F.col("i") / step), top)
    starts = F.when(first <= end, F.transform(F.sequence(first, end), lambda k: k * step)).otherwise(F.array().cast("array<bigint>"))
    tail = F.when((F.col("n") > points) & ((F.col("n") - points) % step != 0) & (F.col("i") >= F.col("n") - points), F.array(F.col("n") - points)).otherwise(F.array().cast("array<bigint>"))
    spread = s.select(*keys, "i", "v", F.explode(F.concat(starts, tail)).alias("start"))
    shape = WINDOWS[window](points)
    gain = float((shape**2).sum())

    @F.pandas_udf("array<double>")
    def power(segments: pd.Series) -> pd.Series:
        out = []
        for values in segments:
            v = np.zeros(points)
            v[: len(values)] = np.asarray(values) - np.mean(values)
            p = np.abs(np.fft.rfft(v * shape)) ** 2 / (rate * gain)
            p[1:-1] *= 2
            out.append(p)
        return pd.Series(out)

    segments = spread.groupBy(*keys, "start").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s"))  # `points` samples at most
    spectra = segments.select(*keys, F.posexplode(power(F.transform("s", lambda p: p["v"]))).alias("bin", "p"))
    df = rate / points
    return spectra.groupBy(*keys, "bin").agg(F.avg("p").alias("psd")).select(*keys, "bin", (F.col("bin") * df).alias("frequency"), "psd", F.sqrt(F.col("psd") * df).alias("amplitude"))


def line_fit(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least squares of y on x: slope, intercept, R2, RMS, and the slope through the origin."""
    a, b = present(F.col(x)), present(F.col(y))
    g = df.where(finite(F.col(x)) & finite(F.col(y))).groupBy(*keys).agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"), F.sqrt((F.regr_syy(b, a) - F.regr_sxy(b, a) ** 2 / F.regr_sxx(b, a)) / F.count(a)).alias("rms"), (F.sum(a * b) / F.sum(a * a)).alias("origin_slope"), F.count(a).alias("n"))
    return g
