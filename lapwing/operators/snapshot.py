"""Distributions of every channel over the whole session and each complete lap, in two passes over the samples.

Neither the number of windows nor of channels adds a pass: a sample counts in its windows by an expansion of the row, the
first pass takes each window's range and statistics, the second counts bins. Both shuffle one row per window and bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.missing import finite, present
from lapwing.operators import scan
from lapwing.operators.aggregate import _edges, bin_of
from lapwing.sessions import settled

ALL = "all"


def gate_keeps(v: Column, mode: str = "nonzero", lo: float | None = None, hi: float | None = None) -> Column:
    """Does a sample of the gate channel let the row count? Missing numbers never do.

    nonzero: v isn't 0; range: lo <= v <= hi; outside: v < lo or v > hi. An expression of any kind will do as `v`.
    """
    if mode == "nonzero":
        inside = v != 0
    elif mode in ("range", "outside"):
        if lo is None or hi is None:
            raise ValueError(f"a gate of mode {mode} needs both ends")
        inside = v.between(float(lo), float(hi)) if mode == "range" else (v < float(lo)) | (v > float(hi))
    else:
        raise ValueError(f"no gate of mode {mode}")
    return F.coalesce(finite(v) & inside, F.lit(False))


def in_laps(samples: DataFrame, laps: DataFrame, block: float | None = None) -> DataFrame:
    """Samples with `lap`, the label of the complete lap (session_id, label, start_t, end_t, complete) they lie in, half open; null outside.

    Laps don't overlap: they and the samples go on one axis, and the last lap that began decides. With `block`, seconds, the
    axis is scanned in blocks of so long a time, else a session is one window.
    """
    lap = laps.where("complete").select("session_id", F.col("start_t").alias("t"), F.struct(F.col("label").cast("string").alias("label"), "end_t").alias("lap"), F.lit(0).alias("side"))
    mine = samples.select("session_id", "t", F.struct("*").alias("row"), F.lit(1).alias("side"))
    both = mine.unionByName(lap, allowMissingColumns=True)
    if block:
        met = scan.scan(both, ["session_id"], ["t", "side"], scan.time_block(block), {"lap": scan.latest(F.col("lap"), ["t", "side"])})
    else:
        met = both.withColumn("lap", F.last("lap", True).over(Window.partitionBy("session_id").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)))
    return met.where("side = 1").select("row.*", F.when(F.col("t") < F.col("lap.end_t"), F.col("lap.label")).alias("lap"))


def snapshot(samples: DataFrame, bins: int = 40, keep: Column | None = None) -> DataFrame:
    """(session_id, channel, window, n, excluded, skipped, lo, hi, min, max, mean, std, counts) of samples (session_id, channel, v, lap).

    A window is `all` or a lap's label. `excluded` counts what the gate `keep` keeps out, `skipped` missing numbers that it lets
    in. Bins are of equal width from lo to hi, the window's own range (a range without width is padded; without numbers 0 to 1),
    the last one holds its upper end. A lap labelled `all` would be one with the session; label laps otherwise.
    """
    bins = max(4, min(500, bins))
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    window = F.explode(F.array_compact(F.array(F.lit(ALL), F.col("lap").cast("string"))))
    rows = samples.select("session_id", "channel", F.when(kept, present(F.col("v").cast("double"))).alias("x"), kept.alias("kept"), window.alias("window"))
    keys = ["session_id", "channel", "window"]
    lo, hi = _edges(F.coalesce(F.min("x"), F.lit(0.0)), F.coalesce(F.max("x"), F.lit(1.0)))
    whole = rows.groupBy(*keys).agg(  # a row per window
        F.count("x").alias("n"), F.count_if(~F.col("kept")).alias("excluded"), F.count_if(F.col("kept") & F.col("x").isNull()).alias("skipped"), lo.alias("lo"), hi.alias("hi"),
        F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
    )
    whole = settled(whole, "windows")
    binned = rows.where("x IS NOT NULL").join(whole.select(*keys, "lo", "hi"), keys).groupBy(*keys, bin_of(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("held"))
    full = binned.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "held"))).alias("held"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.try_element_at("held", k), F.lit(0)).cast("long"))
    return whole.join(full, keys, "left").select(*whole.columns, counts.alias("counts"))
