"""Exact percentiles of groups of any size, by histograms that are refined.

`percentile` keeps all distinct values of a group in one task's memory. Here a pass counts a group's values in bins, each
with its least and largest value; the bin that holds a wanted rank is the next pass's range, until its least and
largest value are the same. A pass shuffles counts only, a few thousand per group, and reads the rows once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.missing import present
from lapwing.sessions import settled

BINS = 1024
BROADCAST_GROUPS = 200_000  # ranges of a pass up to which they are broadcast; more are joined by a shuffle


def percentiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], bins: int = BINS) -> DataFrame:
    """(keys, q, value): linear between the values about the place q (n - 1); missing values are left out, and so is a group without others.

    Keys may be null. The number of passes grows with the logarithm of the spread of values to the base `bins`: two or three
    for measured values, whatever their number; ties end a search early.
    """
    if any(not 0 <= q <= 1 for q in qs):
        raise ValueError("a percentile lies between 0 and 1")
    names = [f"__k{k}" for k in range(len(keys))]
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keys, names, strict=True)), present(F.col(value).cast("double")).alias("v")).where("v IS NOT NULL")
    whole = settled(rows.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "ranges")
    place = F.col("q") * (F.col("n") - 1)
    asked = whole.select("*", F.explode(F.array(*map(F.lit, map(float, qs)))).alias("q")).select("*", F.floor(place).alias("low"), F.ceil(place).alias("high"))
    ranks = asked.select(*names, "lo", "hi", F.explode(F.array("low", "high")).alias("rank")).distinct()
    open_ = ranks.withColumn("below", F.lit(0).cast("long"))
    done: list[DataFrame] = []
    while True:
        open_ = settled(open_, "open")
        done.append(open_.where("lo = hi").select(*names, "rank", F.col("lo").alias("value")))
        open_ = open_.where("lo < hi")
        if open_.isEmpty():
            break
        open_ = _refined(rows, open_, names, bins)
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    found = settled(found, "found")
    at = lambda c, out: found.select(*(F.col(n).alias(f"{n}_{out}") for n in names), F.col("rank").alias(c), F.col("value").alias(out))
    same = lambda out: [F.col(n).eqNullSafe(F.col(f"{n}_{out}")) for n in names]
    both = asked.join(at("low_", "a"), [*same("a"), F.col("low") == F.col("low_")]).join(at("high_", "b"), [*same("b"), F.col("high") == F.col("high_")])
    between = F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place))
    return both.select(*(F.col(n).alias(c) for c, n in zip(keys, names, strict=True)), "q", between.alias("value"))


def _refined(rows: DataFrame, open_: DataFrame, names: list[str], bins: int) -> DataFrame:
    """The wanted ranks with the bin they lie in as their range."""
    ranges = open_.select(*(F.col(n).alias(f"{n}_") for n in names), "lo", "hi").distinct()
    n = ranges.count()
    ranges = F.broadcast(ranges) if n <= BROADCAST_GROUPS else ranges
    # half ranges, so that the width of a range of the largest doubles is a number
    share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    bin_ = F.when(F.col("v") == F.col("hi"), bins).otherwise(F.least(F.floor(share * bins), F.lit(bins - 1))).cast("int")
    inside = rows.join(ranges, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    counted = inside.groupBy(*names, "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("held"), F.min("v").alias("least"), F.max("v").alias("most"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(*names, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = counted.select(*(F.col(n).alias(f"{n}_") for n in names), F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), "held", "least", "most", before.alias("before"))
    met = open_.join(counted, [*(F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names), F.col("lo") == F.col("lo_"), F.col("hi") == F.col("hi_")])
    mine = (F.col("rank") >= F.col("below") + F.col("before")) & (F.col("rank") < F.col("below") + F.col("before") + F.col("held"))
    return met.where(mine).select(*names, F.col("least").alias("lo"), F.col("most").alias("hi"), "rank", (F.col("below") + F.col("before")).alias("below"))
