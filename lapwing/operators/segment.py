"""Laps, runs, sections and gates: cutting a session along its samples."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.missing import finite, present
from lapwing.operators import scan

SPAN_M = 50_000.0  # metres of a block on an axis of distance
WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def islands(df: DataFrame, key: str, starts: Column, order: str = "i", out: str = "island") -> DataFrame:
    """Numbers the stretches of a session from 0; a row where `starts` holds begins one."""
    return scan.scan(df, [key], [order], scan.row_block(order), {out: scan.total(starts.cast("long"))}).withColumn(out, F.col(out) - 1)


def runs(samples: DataFrame, moving: Column, gap: float = 3.0, shortest: float = 4.0) -> DataFrame:
    """(session_id, run, start_t, end_t, n): moving stretches that stops of over `gap` seconds part, of `shortest` seconds at least."""
    m = samples.where(moving).select("session_id", "i", "t")
    m = scan.islands(m, ["session_id"], "i", scan.row_block(), ["t"], lambda row, before: row["t"] - before["t"] > gap, "run")
    found = m.groupBy("session_id", "run").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("n"))
    return found.where(F.col("end_t") - F.col("start_t") >= shortest)


def change_islands(samples: DataFrame, counter: str, out: str = "lap_index") -> DataFrame:
    """Numbers the stretches in which a counter or label stays; a missing label is a stretch of its own."""
    return scan.islands(samples, ["session_id"], "i", scan.row_block(), [counter], lambda row, before: row[counter] != before[counter], out)


def change_laps(samples: DataFrame, counter: str) -> DataFrame:
    """Laps where a counter or label changes: (session_id, lap_index, label, start_t, end_t, start_i, n); the first and the last aren't complete."""
    cut = change_islands(samples, counter)
    laps = cut.groupBy("session_id", "lap_index").agg(F.min_by(counter, "i").alias("label"), F.min("t").alias("start_t"), F.max("t").alias("last_t"), F.min("i").alias("start_i"), F.count("*").alias("n"))
    ends = Window.partitionBy("session_id").orderBy("lap_index")
    return laps.withColumn("end_t", F.coalesce(F.lead("start_t").over(ends), F.col("last_t"))).withColumn("complete", (F.col("lap_index") > 0) & F.lead("lap_index").over(ends).isNotNull()).drop("last_t")


def lap_table(laps: DataFrame) -> DataFrame:
    """Adds lap_time, and delta to the best complete lap."""
    best = F.min(F.when(F.col("complete"), F.col("end_t") - F.col("start_t"))).over(Window.partitionBy("session_id"))
    return laps.withColumn("lap_time", F.col("end_t") - F.col("start_t")).withColumn("delta", F.col("lap_time") - best)


def plausible(laps: DataFrame, length: str | None = None) -> DataFrame:
    """complete only within 0.4 to 2.5 times the median time (and 0.35 to 1.6 times the median length, 50 m at least); sessions of under 3 laps stay."""
    w = Window.partitionBy("session_id")
    time = F.col("lap_time")
    ok = F.coalesce((time >= 0.4 * F.percentile(present(time), 0.5).over(w)) & (time <= 2.5 * F.percentile(present(time), 0.5).over(w)) & finite(time), F.lit(False))
    if length:
        d = F.col(length)
        ok &= (d >= F.greatest(F.lit(50.0), 0.35 * F.percentile(present(d), 0.5).over(w))) & (d <= 1.6 * F.percentile(present(d), 0.5).over(w))
    return laps.withColumn("complete", F.col("complete") & F.when(F.count("*").over(w) >= 3, ok).otherwise(True))


def cut_quality(laps: DataFrame) -> DataFrame:
    """Complete laps and the variation of their times per session."""
    t = F.when(F.col("complete"), F.col("lap_time"))
    return laps.groupBy("session_id").agg(F.count(t).alias("laps"), (F.stddev_pop(t) / F.avg(t)).alias("variation"))


def default_pair(laps: DataFrame) -> DataFrame:
    """The two fastest complete laps of each session, rank 1 and 2."""
    w = Window.partitionBy("session_id").orderBy("lap_time", "lap_index")
    return laps.where("complete").withColumn("rank", F.row_number().over(w)).where("rank <= 2")


def reference_lap(laps: DataFrame) -> DataFrame:
    """The fastest complete lap, else the longest one."""
    w = Window.partitionBy("session_id").orderBy(F.desc("complete"), F.when(F.col("complete"), F.col("lap_time")).otherwise(-F.col("lap_time")), "lap_index")
    return laps.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def distance(samples: DataFrame, speed: str, rate: float) -> DataFrame:
    """Cumulative distance in m from km/h: rectangles, the first sample included; missing and negative speeds count as 0."""
    v = F.greatest(F.coalesce(present(F.col(speed)), F.lit(0.0)), F.lit(0.0)) / 3.6 / rate
    return scan.scan(samples, ["session_id"], ["i"], scan.row_block(), {"distance": scan.total(v)})


def first_arrival(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """(session_id, target, t): the first time that the running largest distance reaches each target.

    That is the least time of all samples so far or farther: targets (session_id, target) and samples go on one axis
    by distance, scanned from its far end.
    """
    both = targets.select("session_id", F.col("target").alias("d"), F.lit(None).cast("double").alias("t"), F.lit(0).alias("side"))
    both = both.union(_arrived(samples).select("session_id", "d", "t", F.lit(1)))
    back = _from_far(both, "t", "at")
    return back.where("side = 0").select("session_id", F.col("d").alias("target"), F.col("at").alias("t"))


def _arrived(samples: DataFrame) -> DataFrame:
    return samples.groupBy("session_id", F.col("distance").alias("d")).agg(F.min("t").alias("t"))


def _from_far(axis: DataFrame, t: str, out: str) -> DataFrame:
    """Adds the least `t` of the rows (session_id, d, side) as far or farther; of one distance, side 1 comes before side 0."""
    return scan.scan(axis, ["session_id"], ["d", "side"], F.floor(F.col("d") / SPAN_M), {out: scan.smallest(F.col(t))}, backwards=True)


def rolling_best(samples: DataFrame, length: float) -> DataFrame:
    """(session_id, best, start_t): the least time over any stretch of `length` metres.

    A stretch begins where a distance is first reached, and ends at the first arrival at or after its far end. The
    samples and the ends of the stretches go on one axis, scanned from its far end.
    """
    none = F.lit(None).cast("double")
    entry = lambda d, arrived, side: F.struct(d.alias("d"), arrived.alias("arrived"), F.col("d").alias("begin"), F.col("t").alias("start"), F.lit(side).alias("side"))
    sides = F.array(entry(F.col("d"), F.col("t"), 1), entry(F.col("d") + length, none, 0))
    axis = _from_far(_arrived(samples).select("session_id", F.inline(sides)), "arrived", "first_t")
    first = lambda side: F.max(F.when(F.col("side") == side, F.col("first_t")))
    ends = axis.groupBy("session_id", "begin", "start").agg(first(1).alias("reached"), first(0).alias("end_t")).where("reached = start AND end_t IS NOT NULL")
    took = F.col("end_t") - F.col("start")
    return ends.groupBy("session_id").agg(F.min(took).alias("best"), F.min_by("start", F.struct(took, "start")).alias("start_t"))


def overlay(samples: DataFrame, laps: DataFrame, step: float = 1.0) -> DataFrame:
    """(session_id, lap_index, k, time): time into the lap at each `step` metres of it, linear between samples."""
    inside = samples.join(laps.select("session_id", "lap_index", "start_t", "end_t"), "session_id").where("t >= start_t AND t < end_t")
    w = Window.partitionBy("session_id", "lap_index").orderBy("i")
    s = inside.withColumn("d", F.col("distance") - F.first("distance").over(w)).withColumn("x", F.col("t") - F.col("start_t"))
    s = s.withColumn("d0", F.lag("d").over(w)).withColumn("x0", F.lag("x").over(w)).where("d0 IS NULL OR d > d0")
    first = F.when(F.col("d0").isNull(), F.lit(0)).otherwise(F.floor(F.col("d0") / step) + 1).cast("long")
    last = F.floor(F.col("d") / step).cast("long")
    s = s.withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    at = F.when(F.col("d0").isNull(), F.col("x")).otherwise(F.col("x0") + (F.col("x") - F.col("x0")) * (F.col("k") * step - F.col("d0")) / (F.col("d") - F.col("d0")))
    return s.select("session_id", "lap_index", "k", at.alias("time"))


def visits(
    track: DataFrame, x: float | Column, y: float | Column, radius: float | Column, heading: float | Column | None = None, tolerance: float = 75.0,
    span: int = 10, gap: float = 1.5, since: Column | None = None, also: tuple[str, ...] = (),
) -> DataFrame:
    """One row per passage through a gate circle: the closest sample's time and distance, and its columns `also`.

    The track is split where a step takes over `gap` seconds or `is_break` (if there) holds, and pieces of
    under 3 samples are left out. A visit counts if its piece was outside before, and if the way from
    the closest sample to the one `span` samples on is within `tolerance` degrees of the gate's
    `heading` (radians; none given: as at the session's closest sample). Columns give each session its own
    gate; `since` says from where on samples count.
    """
    session = Window.partitionBy("session_id")
    w, piece = session.orderBy("i"), Window.partitionBy("session_id", "piece")
    on = lambda c: F.coalesce(F.lead(c, span).over(w), F.last(c).over(w.rowsBetween(*WHOLE))) - F.col(c)
    cut = F.coalesce(F.col("t") - F.lag("t").over(w) > gap, F.lit(True))
    if "is_break" in track.columns:
        cut |= F.coalesce("is_break", F.lit(False))
    t = track.withColumn("d", F.hypot(F.col("x") - x, F.col("y") - y)).withColumn("inside", F.col("d") < radius).withColumn("heading", F.atan2(on("y"), on("x")))
    t = t.withColumn("gate", F.min_by("heading", F.struct("d", "i")).over(session) if heading is None else heading if isinstance(heading, Column) else F.lit(float(heading)))
    t = t.withColumn("cut", cut).withColumn("counts", F.lit(True) if since is None else since)
    kept = dict.fromkeys(["session_id", "i", "t", "d", "inside", "heading", "gate", "cut", "counts", *also])
    t = islands(t.select(*kept), "session_id", F.col("cut"), out="piece").where("counts").drop("cut", "counts").withColumn("n", F.count("*").over(piece))
    t = t.withColumn("before", F.lag("inside").over(piece.orderBy("i"))).withColumn("begins", F.col("inside") & ~F.coalesce("before", F.lit(False)))
    t = islands(t.where("inside AND n >= 3"), "session_id", F.col("begins"), out="visit").where("visit >= 0")  # samples outside begin none
    closest = F.struct("d", "i")
    carried = [F.min_by(c, closest).alias(c) for c in also]
    v = t.groupBy("session_id", "visit").agg(F.min_by("t", closest).alias("t"), F.min("d").alias("d"), F.min_by("heading", closest).alias("heading"), F.first("gate").alias("gate"), F.bool_or(F.col("begins") & F.coalesce(~F.col("before"), F.lit(False))).alias("armed"), *carried)
    off = F.abs(F.pmod(F.col("heading") - F.col("gate") + F.pi(), 2 * F.pi()) - F.pi())
    return v.where(F.col("armed") & (off <= math.radians(tolerance))).withColumn("visit", F.row_number().over(session.orderBy("visit")).cast("long") - 1).select("session_id", "visit", "t", "d", *also)


def debounce(crossings: DataFrame, shortest: float, keys: tuple[str, ...] = ("session_id",), inclusive: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """Crossings (keys, t) over `shortest` seconds after the last one that was kept (`inclusive`: exactly so many will do).

    A greedy choice; columns `also` stay, and order those of one time. Sorted partitions stream through it, so neither
    many keys of few crossings nor one of many cost more than their rows.
    """
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, n = None, -math.inf, 0
        for batch in batches:
            rows, numbers = [], []
            for k, (*of, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*keys, "t")), strict=True)):
                if of != key:
                    key, last, n = of, -math.inf, 0
                if t is not None and (t - last > shortest or inclusive and t - last == shortest):
                    rows.append(k)
                    numbers.append(n)
                    last, n = t, n + 1
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in keys), pa.array(numbers, pa.int64()), *(kept.column(c) for c in ("t", *also))], [*keys, "crossing", "t", *also])

    kind = lambda c: f"`{c}` {crossings.schema[c].dataType.simpleString()}"
    schema = ", ".join([*map(kind, keys), "crossing long", "t double", *map(kind, also)])
    order = [F.asc_nulls_last(c) for c in ("t", *also)]
    return crossings.select(*keys, F.col("t").cast("double").alias("t"), *also).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(keep, schema)


def line_crossings(track: DataFrame, ax: float, ay: float, bx: float, by: float) -> DataFrame:
    """(session_id, t): where the track crosses the line from a to b, linear between samples."""
    w = Window.partitionBy("session_id").orderBy("i")
    side = (bx - ax) * (F.col("y") - ay) - (by - ay) * (F.col("x") - ax)
    s = track.withColumn("side", side).withColumn("side0", F.lag("side").over(w)).withColumn("t0", F.lag("t").over(w)).withColumn("x0", F.lag("x").over(w)).withColumn("y0", F.lag("y").over(w))
    s = s.where((F.col("side0") < 0) & (F.col("side") >= 0)).withColumn("f", F.col("side0") / (F.col("side0") - F.col("side")))
    px, py = F.col("x0") + F.col("f") * (F.col("x") - F.col("x0")), F.col("y0") + F.col("f") * (F.col("y") - F.col("y0"))
    along = ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)
    return s.where(along.between(0, 1)).select("session_id", (F.col("t0") + F.col("f") * (F.col("t") - F.col("t0"))).alias("t"))


def winding_laps(track: DataFrame, shortest: float = 8.0) -> DataFrame:
    """(session_id, turn, start_t, end_t, complete): laps by the turns about the track's centre, counter-clockwise.

    A lap ends where another whole turn is first reached, more than `shortest` seconds after the last
    such place; turns that are lost again by the end don't count. What comes before the first and after
    the last place isn't complete, and a lap without duration is left out.
    """
    c = Window.partitionBy("session_id")
    w = c.orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    a = track.withColumn("angle", F.atan2(F.col("y") - F.avg("y").over(c), F.col("x") - F.avg("x").over(c)))
    d = F.col("angle") - F.lag("angle").over(w)
    a = a.withColumn("turned", F.coalesce(d - 2 * F.pi() * F.round(d / (2 * F.pi())), F.lit(0.0))).withColumn("turns", F.sum("turned").over(upto) / (2 * F.pi()))
    a = a.withColumn("reached", F.floor(F.max("turns").over(upto))).withColumn("before", F.coalesce(F.lag("reached").over(w), F.lit(0)))
    a = a.withColumn("total", F.floor(F.last("turns").over(w.rowsBetween(*WHOLE))))
    places = debounce(a.where((F.col("reached") > F.col("before")) & (F.col("before") < F.col("total"))), shortest).select("session_id", "t")
    ends = track.groupBy("session_id").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    edges = places.union(ends.select("session_id", "first")).union(ends.select("session_id", "last"))
    place = Window.partitionBy("session_id").orderBy("t")
    n, all_ = F.row_number().over(place), F.count("*").over(c)
    laps = edges.withColumn("end_t", F.lead("t").over(place)).withColumn("turn", n.cast("long") - 1).withColumn("complete", (n > 1) & (n < all_ - 1))
    return laps.where(F.col("end_t") > F.col("t")).select("session_id", "turn", F.col("t").alias("start_t"), "end_t", "complete")


def sections(grid: DataFrame, sensitivity: float = 1.0, shortest: float = 25.0, smooth: int = 8) -> DataFrame:
    """(session_id, section, kind, start_m, end_m) from |lateral measure| v at each metre d of the reference lap.

    The measure is smoothed over an odd number of points about `smooth` metres, of which those beyond
    the ends count as 0. Corners are where it reaches p10 + (p90 - p10) * 0.35 / sensitivity; a flat
    measure has none. Spans under
    `shortest` metres go to their neighbours, the shortest first, over the few spans of a lap.
    """
    w = Window.partitionBy("session_id").orderBy("d")
    half = max(1, round(smooth / 2)) if smooth > 0 else 0
    g = grid.withColumn("s", F.sum(F.abs("v")).over(w.rowsBetween(-half, half)) / (2 * half + 1))
    whole = Window.partitionBy("session_id")
    p = lambda q: F.percentile("s", q).over(whole)
    g = g.withColumn("low", p(0.1)).withColumn("spread", p(0.9) - F.col("low"))
    g = g.withColumn("corner", F.coalesce((F.col("spread") > 1e-9) & (F.col("s") >= F.col("low") + F.col("spread") * 0.35 / sensitivity), F.lit(False)))
    g = g.select("session_id", "d", "corner", F.coalesce(F.col("corner") != F.lag("corner").over(w), F.lit(True)).alias("new"))
    g = islands(g, "session_id", F.col("new"), "d", "span")
    spans = g.groupBy("session_id", "span").agg(F.first("corner").alias("corner"), F.min("d").cast("double").alias("start_m"), (F.max("d") + 1).cast("double").alias("end_m"))

    def absorb(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [list(r) for r in pdf.sort_values("start_m")[["corner", "start_m", "end_m"]].itertuples(index=False)]
        while len(rows) > 1:
            k = min(range(len(rows)), key=lambda j: (rows[j][2] - rows[j][1], j))
            if rows[k][2] - rows[k][1] >= shortest:
                break
            rows[k][0] = not rows[k][0]
            merged = [rows[0]]
            for r in rows[1:]:
                if r[0] == merged[-1][0]:
                    merged[-1][2] = r[2]
                else:
                    merged.append(r)
            rows = merged
        return pd.DataFrame([(pdf["session_id"].iloc[0], n, "corner" if c else "straight", a, b) for n, (c, a, b) in enumerate(rows)], columns=["session_id", "section", "kind", "start_m", "end_m"])

    kind = grid.schema["session_id"].dataType.simpleString()
    parts = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number keeps many sessions of few spans from being one task
    return spans.repartition(parts, "session_id").groupBy("session_id").applyInPandas(absorb, f"session_id {kind}, section long, kind string, start_m double, end_m double")


def lowpass(samples: DataFrame, cutoff: float, rate: float, high: bool = False, zero_phase: bool = False) -> DataFrame:
    """Second-order Butterworth along each session and channel: `filtered`, by a scan in blocks.

    A cutoff at or over half the rate gives the input. Missing samples count as 0 (zero phase: filled,
    then missing again).
    """
    keys, x = ["session_id", "channel"], present(F.col("v"))
    s = samples.select("session_id", "channel", "i", "t", "v")
    if zero_phase:
        s = scan.scan(s, keys, ["i"], scan.row_block(), {"filled": scan.latest(x, ["i"])})
        s = scan.scan(s, keys, ["i"], scan.row_block(), {"next": scan.latest(x, ["i"], True)}, backwards=True)
        s = s.withColumn("filled", F.coalesce("filled", "next", F.lit(0.0))).drop("next")
    else:
        s = s.withColumn("filled", F.coalesce(x, F.lit(0.0)))
    if cutoff < rate / 2:
        f = scan.Biquad.lowpass(cutoff, rate)
        s = scan.biquad(s, keys, "i", "filled", "y", f)
        s = scan.biquad(s, keys, "i", "y", "y", f, backwards=True) if zero_phase else s
    else:
        s = s.withColumn("y", F.col("filled"))
    out = F.col("filled") - F.col("y") if high else F.col("y")
    return s.select("session_id", "channel", "i", "t", "v", (F.when(x.isNotNull(), out).otherwise(F.lit(float("nan"))) if zero_phase else out).alias("filtered"))


def time_report(durations: DataFrame, laps: list) -> DataFrame:
    """Section by lap durations: (session_id, section, a column per lap, best, best_lap, spread)."""
    g = durations.groupBy("session_id", "section").pivot("lap_index", laps).agg(F.max("duration"))
    trusted = durations.where("complete").groupBy("session_id", "section").agg(F.min("duration").alias("best"), F.min_by("lap_index", F.struct("duration", "lap_index")).alias("best_lap"), (F.max("duration") - F.min("duration")).alias("spread"))
    return g.join(trusted, ["session_id", "section"], "left")


#: Bands of a duration by its ratio to the section's best.
BANDS = (("best", 1.005), ("close", 1.03), ("fair", 1.08))


def time_report_rows(durations: DataFrame) -> DataFrame:
    """The report of all laps as rows (session_id, section, lap_index, duration, best, best_lap, spread, ratio, band).

    The best is of complete laps, of all where a section has none. `band` is best, close or fair, else empty.
    """
    keys = ["session_id", "section"]
    known, order = F.col("duration").isNotNull(), F.struct("duration", "lap_index")
    whole = durations.groupBy(*keys).agg(
        *(f.alias(f"{n}{k}") for k, of in (("_c", known & F.col("complete")), ("_a", known)) for n, f in (("best", F.min(F.when(of, order))), ("most", F.max(F.when(of, F.col("duration"))))))
    )
    chosen = F.coalesce("best_c", "best_a")
    least = whole.select(*keys, chosen["duration"].alias("best"), chosen["lap_index"].alias("best_lap"), (F.coalesce("most_c", "most_a") - chosen["duration"]).alias("spread"))
    ratio = F.when(F.col("best") > 0, F.col("duration") / F.col("best"))
    band = F.when(F.col("ratio").isNull(), "")
    for name, most in BANDS:
        band = band.when(F.col("ratio") <= most, name)
    return durations.join(least, keys).withColumn("ratio", ratio).withColumn("band", band.otherwise("")).select(*keys, "lap_index", "duration", "best", "best_lap", "spread", "ratio", "band")


def theoretical_best(durations: DataFrame) -> DataFrame:
    """Sum of each session's best section times, over complete laps."""
    best = durations.where("complete").groupBy("session_id", "section").agg(F.min("duration").alias("best"))
    return best.groupBy("session_id").agg(F.sum("best").alias("theoretical"), F.count("*").alias("sections"))
