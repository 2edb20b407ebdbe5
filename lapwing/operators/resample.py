"""Joins along time: as-of holds, interpolation, nearest samples, bin means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.operators import scan


def around(left: DataFrame, right: DataFrame, session: str = "session_id", block: float | None = None, sides: tuple[str, ...] = ("prev", "next")) -> DataFrame:
    """Left rows with the right samples at or before (`prev`) and at or after (`next`) their t, and the right range.

    Both sides are put on one axis and filled along it: one shuffle by session, no join on a range. With `block`,
    seconds, the axis is scanned in blocks of so long a time, and a session is as many tasks as it has blocks.
    """
    r = right.select(session, "t", F.lit(0).alias("side"), F.struct("t", "v").alias("s"))
    keep = [c for c in left.columns if c not in (session, "t")]
    mine = left.select(session, "t", F.lit(1).alias("side"), F.struct(*([F.lit(1).alias("_")] + [F.col(c) for c in keep])).alias("mine"))
    both = mine.unionByName(r, allowMissingColumns=True)
    if block:
        cut, found = scan.time_block(block), both.withColumn("back", -F.col("side"))
        if "prev" in sides:
            found = scan.scan(found, [session], ["t", "side"], cut, {"prev": scan.latest(F.col("s"), ["t", "side"])})
        if "next" in sides:
            found = scan.scan(found, [session], ["t", "back"], cut, {"next": scan.latest(F.col("s"), ["t", "back"], True)}, backwards=True)
        ends = right.groupBy(session).agg(F.min("t").alias("r_min"), F.max("t").alias("r_max"))
        found = found.where("side = 1").select(session, "t", *(F.col(f"mine.{c}").alias(c) for c in keep), *sides)
        return found.join(ends, session, "left")
    upto = Window.partitionBy(session).orderBy("t", "side")
    onward = Window.partitionBy(session).orderBy(F.desc("t"), "side")
    whole = Window.partitionBy(session)
    at = F.when(F.col("side") == 0, F.col("t"))
    filled = both.select("*", F.last("s", True).over(upto).alias("prev"), F.last("s", True).over(onward).alias("next"), F.min(at).over(whole).alias("r_min"), F.max(at).over(whole).alias("r_max"))
    return filled.where("side = 1").select(session, "t", *(F.col(f"mine.{c}").alias(c) for c in keep), "prev", "next", "r_min", "r_max")


def hold(left: DataFrame, right: DataFrame, closed: bool = False, block: float | None = None) -> DataFrame:
    """The last right sample at each left t; nothing before the first, at or (unless `closed`) after the last. `block`: seconds that one task scans."""
    inside = F.col("t") >= F.col("r_min")
    inside &= (F.col("t") <= F.col("r_max")) if closed else (F.col("t") < F.col("r_max"))
    return around(left, right, block=block, sides=("prev",)).withColumn("held", F.when(inside, F.col("prev.v"))).drop("prev", "next", "r_min", "r_max")


def interpolate(left: DataFrame, right: DataFrame, clamp: bool = True, block: float | None = None) -> DataFrame:
    """Linear between the right samples around each left t; beyond the ends the end value, or nothing."""
    p, n = F.col("prev"), F.col("next")
    between = p["v"] + (n["v"] - p["v"]) * ((F.col("t") - p["t"]) / (n["t"] - p["t"]))
    value = F.when(p.isNull(), n["v"] if clamp else None).when(n.isNull(), p["v"] if clamp else None).when(p["t"] == n["t"], p["v"]).otherwise(between)
    return around(left, right, block=block).withColumn("value", value).drop("prev", "next", "r_min", "r_max")


def nearest(left: DataFrame, right: DataFrame, tie_left: bool = True, inside: bool = False, block: float | None = None) -> DataFrame:
    """The right sample closest in time; of equally close ones the earlier or the later. `inside`: nothing beyond the right ends."""
    p, n = F.col("prev"), F.col("next")
    dp, dn = F.col("t") - p["t"], n["t"] - F.col("t")
    value = F.when(p.isNull(), n["v"]).when(n.isNull(), p["v"]).when((dp <= dn) if tie_left else (dp < dn), p["v"]).otherwise(n["v"])
    if inside:
        value = F.when(p.isNotNull() & n.isNotNull(), value)
    return around(left, right, block=block).withColumn("value", value).drop("prev", "next", "r_min", "r_max")


def bin_mean(samples: DataFrame, step: float, keys: tuple[str, ...] = ("session_id", "channel")) -> DataFrame:
    """Mean of the samples within half a step of each multiple of `step`, half open."""
    k = F.floor(F.col("t") / step + 0.5).cast("long")
    return samples.groupBy(*keys, k.alias("k")).agg(F.avg("v").alias("mean"), F.count("v").alias("n"))


def repeat_to_master(native: DataFrame, master: DataFrame, factor: Column, n: Column) -> DataFrame:
    """Regular rates: each native sample is repeated `factor` times, the last one to the end."""
    want = F.least(F.floor(F.col("i") / factor), n - 1).cast("long")
    m = master.withColumn("__k", want)
    return m.join(native.select("session_id", F.col("i").alias("__k"), "v"), ["session_id", "__k"], "left").drop("__k")


def outer_on_time(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Full outer join of two series on times that are equal within the tolerance; of several samples there the first."""
    key = lambda df, v: df.select("session_id", "t", F.round(F.col("t") / tolerance).cast("long").alias("tick"), F.col("v").alias(v)).groupBy("session_id", "tick").agg(F.min_by(v, F.struct("t", v)).alias(v))
    return key(a, "a").join(key(b, "b"), ["session_id", "tick"], "full_outer").withColumn("t", F.col("tick") * tolerance)
