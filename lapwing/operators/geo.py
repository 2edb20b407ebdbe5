"""GPS tracks: validity, metres, breaks and jumps, distance, curvature, attitude."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lapwing.functions.missing import finite

#: Metres per degree.
LON_M, LAT_M = 111_320.0, 110_540.0


def _rows():
    return Window.partitionBy("session_id").orderBy("i")


def _all():
    return Window.partitionBy("session_id")


def track(fixes: DataFrame, sats: str | None = None, least: int = 10) -> DataFrame:
    """Valid fixes (session_id, i, t, lat, lon) in metres from the first one: adds x, y.

    Zero and missing coordinates aren't valid, and under 4 satellites neither, in sessions that ever
    had 4. Sessions of under `least` valid fixes are left out.
    """
    ok = finite(F.col("lat")) & finite(F.col("lon")) & (F.abs("lat") > 1e-3) & (F.abs("lon") > 1e-3)
    if sats:
        ok &= (F.max(sats).over(_all()) < 4) | (F.col(sats) >= 4)
    good = fixes.withColumn("__ok", ok).where("__ok").drop("__ok")
    good = good.withColumn("lat0", F.first("lat").over(_rows())).withColumn("lon0", F.first("lon").over(_rows())).withColumn("__n", F.count("*").over(_all())).where(F.col("__n") >= least)
    x = (F.col("lon") - F.col("lon0")) * LON_M * F.cos(F.radians("lat0"))
    return good.withColumn("x", x).withColumn("y", (F.col("lat") - F.col("lat0")) * LAT_M).drop("lat0", "lon0", "__n")


def classify(path: DataFrame, gap: float = 1.0, spike_kmh: float = 400.0) -> DataFrame:
    """Adds step_m, dt, is_break (a hole or a jump before the sample) and is_jump (either end of an impossible step)."""
    step = F.hypot(F.col("x") - F.lag("x").over(_rows()), F.col("y") - F.lag("y").over(_rows()))
    dt = F.col("t") - F.lag("t").over(_rows())
    p = path.withColumn("step_m", step).withColumn("dt", dt)
    p = p.withColumn("__jump", F.coalesce((F.col("dt") > 0) & (F.col("step_m") / F.when(F.col("dt") > 0, F.col("dt")) * 3.6 > spike_kmh), F.lit(False)))
    return p.withColumn("is_break", F.coalesce(F.col("dt") > gap, F.lit(False)) | F.col("__jump")).withColumn("is_jump", F.col("__jump") | F.coalesce(F.lead("__jump").over(_rows()), F.lit(False))).drop("__jump")


def path_distance(classified: DataFrame) -> DataFrame:
    """Adds distance: steps summed, breaks add nothing."""
    step = F.when(F.col("is_break"), 0.0).otherwise(F.coalesce("step_m", F.lit(0.0)))
    return classified.withColumn("distance", F.sum(step).over(_rows().rowsBetween(Window.unboundedPreceding, 0)))


def gps_summary(classified: DataFrame, gap: float = 1.0) -> DataFrame:
    """Fixes, jumps, holes, the worst jump, the longest hole and the segments of each session."""
    hole = F.col("dt") > gap
    return classified.groupBy("session_id").agg(
        F.count("*").alias("fixes"), F.count_if("is_jump").alias("jumps"), F.count_if(F.coalesce(hole, F.lit(False))).alias("holes"), F.max(F.when(F.col("is_jump"), F.col("step_m"))).alias("worst_jump_m"), F.max(F.when(hole, F.col("dt"))).alias("longest_hole_s"), (F.count_if("is_break") + 1).alias("segments")
    )


def break_aware_decimate(classified: DataFrame, step: int) -> DataFrame:
    """Every `step`-th sample; a break stays on the segment that it falls in."""
    b = F.max(F.col("is_break").cast("int")).over(Window.partitionBy("session_id", F.floor((F.col("i") - 1) / step)))
    return classified.withColumn("is_break", b == 1).where(F.col("i") % step == 0)


def unwrap(angle: Column, key: str = "session_id", order: str = "i") -> Column:
    """Step of an angle with its turns taken out: sum it along the session for the unwrapped angle."""
    d = angle - F.lag(angle).over(Window.partitionBy(key).orderBy(order))
    step = d - 2 * F.pi() * F.floor((d + F.pi()) / (2 * F.pi()))
    return F.coalesce(F.when((step == -F.pi()) & (d > 0), F.pi()).otherwise(step), F.lit(0.0))  # half a turn keeps its sign


def gradient(v: Column, at: Column) -> Column:
    """Central difference over `at`, one-sided at the ends."""
    hi, lo = F.coalesce(F.lead(v).over(_rows()), v), F.coalesce(F.lag(v).over(_rows()), v)
    ahi, alo = F.coalesce(F.lead(at).over(_rows()), at), F.coalesce(F.lag(at).over(_rows()), at)
    return F.when(ahi != alo, (hi - lo) / (ahi - alo))


@F.pandas_udf(DoubleType())
def heading(y: pd.Series, x: pd.Series) -> pd.Series:
    """The angle of (x, y) as the C library gives it; the JVM's is off by a last bit in one of five, which turns half turns over."""
    return pd.Series(list(map(math.atan2, y, x)), dtype=float)


def curvature(path: DataFrame) -> DataFrame:
    """Adds curvature, the change of heading per metre; 0 where hardly anything is driven.

    Heading, way and turn are central differences over the samples, one-sided at the ends.
    """
    first, last = F.lag("x").over(_rows()).isNull(), F.lead("x").over(_rows()).isNull()
    sides = F.when(first | last, 1.0).otherwise(2.0)
    per_sample = lambda c: (F.coalesce(F.lead(c).over(_rows()), F.col(c)) - F.coalesce(F.lag(c).over(_rows()), F.col(c))) / sides
    p = path.withColumn("gx", per_sample("x")).withColumn("gy", per_sample("y")).withColumn("heading", heading("gy", "gx")).withColumn("swing", unwrap(F.col("heading")))
    turn = F.when(first, F.lead("swing").over(_rows())).when(last, F.col("swing")).otherwise((F.col("swing") + F.lead("swing").over(_rows())) / 2)
    p = p.withColumn("turn", turn).withColumn("step", F.hypot("gx", "gy"))
    return p.withColumn("curvature", F.when(F.col("step") > 0.05, F.abs(F.col("turn") / F.col("step"))).otherwise(0.0)).drop("gx", "gy", "heading", "swing", "turn", "step")


#: Fixed values of the kinds of tracks: km/h from which a sample counts, samples, metres of extent, ways driven per extent, and shares of the sides.
MOVING, ENOUGH, EXTENT, SMALL_TRACK = 8.0, 20, 15.0, 140.0
REPEATS = {"once": 3.0, "to and fro": 18.0, "eight": 35.0}
NARROW, SQUARE = 0.5, 0.65


def classify_track(path: DataFrame, speed: str | None = None) -> DataFrame:
    """runs, figure8 or circuit by the extent of what is driven, how often it is driven over and its proportions.

    `speed` names a column in km/h; without one it is that of the step to each sample.
    """
    p = path
    if speed is None:
        own = F.hypot(F.col("x") - F.lag("x").over(_rows()), F.col("y") - F.lag("y").over(_rows())) / (F.col("t") - F.lag("t").over(_rows())) * 3.6
        p = p.withColumn("__speed", own).withColumn("__speed", F.coalesce("__speed", F.lead("__speed").over(_rows())))
    p = p.where(F.col(speed or "__speed") > MOVING)
    p = p.withColumn("step", F.coalesce(F.hypot(F.col("x") - F.lag("x").over(_rows()), F.col("y") - F.lag("y").over(_rows())), F.lit(0.0)))
    extent = lambda c: F.max(c) - F.min(c)
    g = p.groupBy("session_id").agg(F.count("*").alias("samples"), extent("x").alias("wide"), extent("y").alias("high"), F.sum("step").alias("path"))
    g = path.select("session_id").distinct().join(g, "session_id", "left").withColumn("diagonal", F.hypot("wide", "high"))
    repeat, aspect = F.col("path") / F.col("diagonal"), F.least("wide", "high") / F.greatest("wide", "high", F.lit(1e-9))
    still = (F.coalesce("samples", F.lit(0)) < ENOUGH) | (F.col("diagonal") < EXTENT)
    kind = (
        F.when(still, "runs").when(repeat < REPEATS["once"], "runs")
        .when((F.col("diagonal") <= SMALL_TRACK) & (repeat >= REPEATS["eight"]) & (aspect >= SQUARE), "figure8")
        .when((aspect < NARROW) & (repeat >= REPEATS["to and fro"]), "runs").otherwise("circuit")
    )
    return g.withColumn("kind", kind)


def wrap_angle(a: Column) -> Column:
    """Into [-pi, pi)."""
    return a - 2 * F.pi() * F.floor((a + F.pi()) / (2 * F.pi()))


def rotate(roll: Column, pitch: Column, yaw: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A body vector in the world: roll, then pitch (nose up is positive), then yaw."""
    y1, z1 = y * F.cos(roll) - z * F.sin(roll), y * F.sin(roll) + z * F.cos(roll)
    x2, z2 = x * F.cos(pitch) - z1 * F.sin(pitch), x * F.sin(pitch) + z1 * F.cos(pitch)
    return x2 * F.cos(yaw) - y1 * F.sin(yaw), x2 * F.sin(yaw) + y1 * F.cos(yaw), z2


def cumulative_energy(samples: DataFrame, power: str, rate: float) -> DataFrame:
    """Adds drive_kwh and regen_kwh: trapezoids of the positive and of the negative power."""
    p = F.coalesce(F.col(power), F.lit(0.0))
    upto = _rows().rowsBetween(Window.unboundedPreceding, 0)
    part = lambda side: F.coalesce(0.5 * (side + F.lag(side).over(_rows())) / rate / 3600, F.lit(0.0))
    s = samples.withColumn("__d", part(F.greatest(p, F.lit(0.0)))).withColumn("__r", part(F.greatest(-p, F.lit(0.0))))
    return s.withColumn("drive_kwh", F.sum("__d").over(upto)).withColumn("regen_kwh", F.sum("__r").over(upto)).drop("__d", "__r")
