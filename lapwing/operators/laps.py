"""Laps from tracks: driving phases, gates that a session comes back to, the quality of a cut, and which kind of lap fits.

A track here is (session_id, i, t, x, y, speed in km/h), `is_break` optional. Laps are
(session_id, lap_index, start_t, end_t, complete). Searches for a gate read the track several times; what they
find, a few rows per lap and place, is stored between the steps, which run when the function is called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.missing import present
from lapwing.operators.geo import classify_track
from lapwing.operators.resample import interpolate, nearest
from lapwing.operators.segment import debounce, plausible, visits
from lapwing.sessions import settled

#: km/h and seconds of driving, metres of a candidate's cell, moving samples that a search needs.
MOVING, SUSTAINED, CELL, ENOUGH = 8.0, 3.0, 10.0, 10
#: A gate's radius in metres, least and as a share of the track's extent; the same for half a line's width.
RADIUS, LEAST_RADIUS, RADIUS_SHARE = 30.0, 6.0, 0.15
LINE, LEAST_LINE, LINE_SHARE = 12.0, 6.0, 0.08
#: Seconds of the shortest lap, seconds that part a track, degrees that headings may differ by.
SHORTEST, HOLE, TOLERANCE = 8.0, 1.5, 75.0
#: Fixed values of a weak cut: complete laps, and the variation of times and lengths.
WEAK_LAPS, WEAK_VARIATION = 2, 0.65
#: Fixed values of a figure-8 gate: entries, crossings, and loops with a direction.
EIGHT_ENTRIES, EIGHT_CROSSINGS, EIGHT_LOOPS = 3, 4, 6
#: Seconds within which a crossing entered by hand is one that is there.
SNAP = 0.05
#: Metres of a cell in which lines and steps meet; wider than half a line, so a crossing is in its gate's cell or one beside it.
REACH = 12.5
GATE = ("session_id", "first_i")
#: What the searches read of a track.
TRACK = ("session_id", "i", "t", "x", "y", "speed", "is_break")


def _along(*keys: str):
    return Window.partitionBy(*(keys or ("session_id",))).orderBy("i")


def _upto(*keys: str):
    return _along(*keys).rowsBetween(Window.unboundedPreceding, 0)


def _wrapped(angle: Column) -> Column:
    """The size of an angle, turns taken out."""
    return F.abs(F.pmod(angle + F.pi(), 2 * F.pi()) - F.pi())


def driving(track: DataFrame, rate: float) -> DataFrame:
    """(session_id, drive_i, start_t, end_t, start_d, end_d, diagonal): from the first sample that begins 3 s of faster samples only, to the last.

    Sessions that never drive so long have no row.
    """
    hold = max(1, round(rate * SUSTAINED))
    fast = F.coalesce(F.col("speed") > MOVING, F.lit(False)).cast("int")
    t = driven(track).withColumn("fast", fast).withColumn("sum", F.sum("fast").over(_upto()))
    full = F.lead("sum", hold - 1).over(_along()) - F.col("sum") + F.col("fast") == hold
    t = t.withColumn("begins", F.when(full, F.col("i")))
    at = lambda c: F.min_by(c, "begins")
    extent = F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    g = t.groupBy("session_id").agg(
        F.min("begins").alias("drive_i"), at("t").alias("start_t"), F.max_by("t", "i").alias("end_t"), at("driven").alias("start_d"), F.max_by("driven", "i").alias("end_d"), extent.alias("diagonal")
    )
    return g.where("drive_i IS NOT NULL")


def driven(track: DataFrame) -> DataFrame:
    """Adds driven: metres from the mean speed of each step; holes of over 1.5 s add nothing."""
    dt = F.col("t") - F.lag("t").over(_along())
    step = (F.col("speed") + F.lag("speed").over(_along())) / 7.2 * dt
    return track.withColumn("driven", F.coalesce(F.sum(F.when((dt > 0) & (dt <= HOLE), step).otherwise(0.0)).over(_upto()), F.lit(0.0)))


def gate_candidates(track: DataFrame, cell: float = CELL) -> DataFrame:
    """(session_id, first_i, px, py, entries): the cells of a grid that moving samples visit.

    A candidate lies at the mean of its samples, counts how often the car came into its cell, and is
    known by the first sample there. Sessions of under 10 moving samples have none.
    """
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    m = track.where(F.col("speed") > MOVING).withColumn("bx", at("x")).withColumn("by", at("y"))
    here = F.struct("bx", "by")
    m = m.withColumn("enters", F.coalesce(here != F.lag(here).over(_along()), F.lit(True)))
    g = m.groupBy("session_id", "bx", "by").agg(F.min("i").alias("first_i"), F.avg("x").alias("px"), F.avg("y").alias("py"), F.count_if("enters").alias("entries"), F.count("*").alias("n"))
    return g.withColumn("n", F.sum("n").over(Window.partitionBy("session_id"))).where(F.col("n") >= ENOUGH).select("session_id", "first_i", "px", "py", "entries")


def cut(crossings: DataFrame, phase: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Laps between crossings (keys, t, d_from, d_to) within the driving phase (keys, start_t, end_t, start_d, end_d): adds way_m.

    What comes before the first and after the last crossing is a lap that isn't complete; one without duration is left out.
    """
    edge = lambda df, t, d_from, d_to, place: df.select(*keys, F.col(t).alias("start_t"), F.col(d_from).alias("d_from"), F.col(d_to).alias("d_to"), F.lit(place).alias("place"))
    inside = crossings.join(phase.select(*keys, "start_t", "end_t"), list(keys)).where("t BETWEEN start_t AND end_t").drop("start_t", "end_t")
    edges = edge(phase, "start_t", "start_d", "start_d", 0).union(edge(inside, "t", "d_from", "d_to", 1)).union(edge(phase, "end_t", "end_d", "end_d", 2))
    w = Window.partitionBy(*keys).orderBy("start_t", "place")
    n, all_ = F.row_number().over(w), F.count("*").over(Window.partitionBy(*keys))
    laps = edges.withColumn("end_t", F.lead("start_t").over(w)).withColumn("way_m", F.abs(F.lead("d_to").over(w) - F.col("d_from")))
    laps = laps.withColumn("lap_index", n.cast("long") - 1).withColumn("complete", (n > 1) & (n < all_ - 1))
    return laps.where("end_t > start_t").select(*keys, "lap_index", "start_t", "end_t", "complete", "way_m")


def quality(laps: DataFrame, keys: tuple[str, ...] = ("session_id",), shortest: float = SHORTEST) -> DataFrame:
    """(keys, laps, variation) of cuts: complete laps near the median time and way, and how their times and ways vary (infinite without any).

    Near is 0.4 to 2.5 times the median time, 0.35 to 1.6 times the median way, and 50 m at least.
    """
    w = Window.partitionBy(*keys)
    q = laps.withColumn("took", F.col("end_t") - F.col("start_t")).where(F.col("took") >= shortest)
    q = q.withColumn("mt", F.percentile("took", 0.5).over(w)).withColumn("md", F.percentile("way_m", 0.5).over(w))
    good = F.col("complete") & F.expr("took BETWEEN 0.4 * mt AND 2.5 * mt AND way_m BETWEEN 0.35 * md AND 1.6 * md AND way_m >= 50")
    spread = lambda c: F.stddev_pop(F.when(good, F.col(c))) / F.greatest(F.avg(F.when(good, F.col(c))), F.lit(1e-9))
    return q.groupBy(*keys).agg(F.count_if(good).alias("laps"), F.coalesce(spread("took") + spread("way_m"), F.lit(math.inf)).alias("variation"))


def _with_heading(track: DataFrame, span: int) -> DataFrame:
    w = _along()
    on = lambda c: F.coalesce(F.lead(c, span).over(w), F.last(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) - F.col(c)
    return track.withColumn("heading", F.atan2(on("y"), on("x")))


def circle_crossings(track: DataFrame, gates: DataFrame, span: int, shortest: float = SHORTEST, tolerance: float = TOLERANCE) -> DataFrame:
    """Passages (session_id, t, d_from, d_to) of each session's gate circle (session_id, first_i, px, py, radius) in the direction driven at first_i."""
    t = driven(track).join(gates.select("session_id", "first_i", "px", "py", "radius"), "session_id")
    there = F.max(F.when(F.col("i") == F.col("first_i"), F.col("heading"))).over(Window.partitionBy("session_id"))
    v = visits(t, F.col("px"), F.col("py"), F.col("radius"), there, tolerance, span, HOLE, F.col("i") >= F.col("first_i"), ("driven",))
    return debounce(v, shortest, also=("driven",)).select("session_id", "t", F.col("driven").alias("d_from"), F.col("driven").alias("d_to"))


def line_crossings(track: DataFrame, gates: DataFrame, span: int, shortest: float = SHORTEST, tolerance: float = TOLERANCE, directed: bool = True) -> DataFrame:
    """Crossings (session_id, first_i, t, d_from, d_to) of short lines through each gate (session_id, first_i, px, py, half), along the direction driven there.

    Steps and lines meet in the cells of a grid, so a session's gates aren't held against all its samples.
    `directed` takes crossings from right to left only, driven within `tolerance` degrees of the gate's direction.
    """
    t = _with_heading(driven(track), span)
    gate = gates.select("session_id", "first_i", "px", "py", "half").join(t.select("session_id", F.col("i").alias("first_i"), F.col("heading").alias("gate")), list(GATE))
    cell = lambda c: F.floor(c / REACH).cast("long")
    beside = lambda c: F.explode(F.sequence(cell(F.col(c)) - 1, cell(F.col(c)) + 1))
    gate = gate.withColumn("cx", beside("px")).withColumn("cy", beside("py"))
    for c in ("i", "t", "x", "y", "driven"):
        t = t.withColumn(f"{c}0", F.lag(c).over(_along()))
    whole = F.col("i0").isNotNull() & (F.col("t") - F.col("t0") <= HOLE)
    if "is_break" in track.columns:
        whole &= ~F.coalesce("is_break", F.lit(False))
    covered = lambda c: F.explode(F.sequence(cell(F.least(f"{c}0", c)), cell(F.greatest(f"{c}0", c))))
    steps = t.where(whole).withColumn("cx", covered("x")).withColumn("cy", covered("y"))
    m = steps.join(gate, ["session_id", "cx", "cy"]).where(F.col("i0") >= F.col("first_i"))
    ahead, aside = F.cos("gate"), F.sin("gate")
    off = lambda x, y: (F.col(y) - F.col("py")) * ahead - (F.col(x) - F.col("px")) * aside
    m = m.withColumn("s0", off("x0", "y0")).withColumn("s1", off("x", "y"))
    left = F.expr("s0 <= 0 AND s1 > 0")
    m = m.where(left if directed else left | F.expr("s0 >= 0 AND s1 < 0"))
    change = F.col("s1") - F.col("s0")
    m = m.withColumn("f", F.when(F.abs(change) < 1e-12, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), -F.col("s0") / change))))
    on = lambda c: F.col(f"{c}0") + F.col("f") * (F.col(c) - F.col(f"{c}0"))
    hit = lambda c: F.least(F.greatest(c, f"{c}0"), F.greatest(F.least(c, f"{c}0"), on(c)))
    m = m.where((cell(hit("x")) == F.col("cx")) & (cell(hit("y")) == F.col("cy")))  # a step and a line share several cells; the crossing is in one
    m = m.where(F.abs((on("x") - F.col("px")) * ahead + (on("y") - F.col("py")) * aside) <= F.col("half"))
    if directed:
        m = m.where(_wrapped(F.col("heading") - F.col("gate")) <= math.radians(tolerance))
    found = m.select(*GATE, on("t").alias("at"), F.when(F.col("f") == 0, F.col("driven0")).otherwise(F.col("driven")).alias("d_from"), F.when(F.col("f") == 1, F.col("driven")).otherwise(F.col("driven0")).alias("d_to"))
    return debounce(found.withColumnRenamed("at", "t"), shortest, GATE, True, ("d_from", "d_to")).drop("crossing")


def gps_laps(track: DataFrame, rate: float, gate: DataFrame | None = None, shortest: float = SHORTEST, radius: float = RADIUS) -> DataFrame:
    """Laps between passages of a gate: that of `gate` (session_id, px, py), else found in the track.

    The found gate is the first place that a session comes into three times, else where it starts driving. Where
    its cut is weak, lines through all places that are visited twice are cut as well, and the best one
    is taken if it gives two more complete laps. Laps start with the driving phase; sessions without
    one have none. The quality of all cuts counts laps from `shortest` seconds on; the laps returned include shorter ones.
    """
    span, phase = max(1, round(rate)), settled(driving(track, rate), "phase")
    if gate is not None:
        off = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
        at = track.join(gate.select("session_id", "px", "py"), "session_id")
        chosen = at.groupBy("session_id").agg(F.min_by("i", F.struct(off, "i")).alias("first_i"), F.first("px").alias("px"), F.first("py").alias("py"))
        return cut(_circle(track, chosen, phase, span, shortest, radius), phase).drop("way_m")
    places = settled(gate_candidates(track), "places")
    first = places.where("entries >= 3").groupBy("session_id").agg(F.min_by(F.struct("first_i", "px", "py"), "first_i").alias("found"))
    begin = track.join(phase.select("session_id", "drive_i"), "session_id").where("i = drive_i").select("session_id", F.struct(F.col("i").alias("first_i"), F.col("x").alias("px"), F.col("y").alias("py")).alias("begin"))
    chosen = begin.join(first, "session_id", "left").select("session_id", F.coalesce("found", "begin").alias("g")).select("session_id", "g.*")
    base = settled(cut(_circle(track, settled(chosen, "gates"), phase, span, shortest, radius), phase), "laps")
    judged = phase.join(quality(base, shortest=shortest), "session_id", "left").select("session_id", F.coalesce("laps", F.lit(0)).alias("base_laps"), F.coalesce("variation", F.lit(math.inf)).alias("base_variation"))
    weak = settled(judged.where((F.col("base_laps") < WEAK_LAPS) | (F.col("base_variation") > WEAK_VARIATION)), "weak")
    if weak.isEmpty():
        return base.drop("way_m")
    half = F.greatest(F.lit(LEAST_LINE), F.least(F.lit(LINE), LINE_SHARE * F.col("diagonal"))).alias("half")
    lines = places.where("entries >= 2").join(weak, "session_id").join(phase, "session_id").select("session_id", "first_i", "px", "py", "entries", half)
    found = settled(line_crossings(track.join(weak.select("session_id"), "session_id", "left_semi"), lines, span, shortest), "crossings")
    per_gate = found.join(phase, "session_id").where("t >= start_t").select(*GATE).distinct().join(phase, "session_id")
    tried = settled(cut(found, per_gate, GATE), "tried")
    rank = F.struct("laps", -F.col("variation"), "entries", -F.col("first_i"))
    best = quality(tried, GATE, shortest).join(lines, list(GATE)).groupBy("session_id").agg(F.max_by("first_i", rank).alias("first_i"), F.max_by("laps", rank).alias("laps"))
    better = settled(best.join(weak, "session_id").where(F.col("laps") >= F.col("base_laps") + 2).select(*GATE), "better")
    return tried.join(better, list(GATE), "left_semi").drop("first_i", "way_m").unionByName(base.join(better, "session_id", "left_anti").drop("way_m"))


def _circle(track: DataFrame, gates: DataFrame, phase: DataFrame, span: int, shortest: float, radius: float) -> DataFrame:
    wide = F.greatest(F.lit(LEAST_RADIUS), F.least(F.lit(radius), RADIUS_SHARE * F.col("diagonal")))
    return circle_crossings(track, gates.join(phase.select("session_id", wide.alias("radius")), "session_id"), span, shortest)


def turn_direction(samples: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, turn) of pieces of track: 1 counter-clockwise, -1 clockwise, 0 neither or under 8 samples.

    By the area between way and chord where it is 8 % of the piece's box, else by six tenths of a turn about its centre.
    """
    w, whole = _along(*keys), Window.partitionBy(*keys)
    s = samples.withColumn("part", F.lag("x").over(w) * F.col("y") - F.col("x") * F.lag("y").over(w))
    s = s.withColumn("angle", F.atan2(F.col("y") - F.avg("y").over(whole), F.col("x") - F.avg("x").over(whole)))
    d = F.col("angle") - F.lag("angle").over(w)
    g = s.withColumn("swing", d - 2 * F.pi() * F.round(d / (2 * F.pi()))).groupBy(*keys).agg(
        F.count("*").alias("n"), (F.sum("part") / 2).alias("area"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("box"), F.sum("swing").alias("sweep")
    )
    by_area = (F.col("box") > 1e-9) & (F.abs("area") >= 0.08 * F.col("box"))
    turn = F.when(F.col("n") < 8, 0).when(by_area, F.signum("area")).when(F.abs("sweep") < 1.2 * F.pi(), 0).otherwise(F.signum("sweep"))
    return g.select(*keys, F.coalesce(turn.cast("int"), F.lit(0)).alias("turn"))


def within(samples: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ("session_id",), also: tuple[str, ...] = ("lap_index",)) -> DataFrame:
    """Samples with the span (keys, start_t, end_t, also) that holds them; spans don't overlap, and a sample on a shared edge goes to the later one.

    Both are put on one axis and filled along it, so no sample meets more than one span.
    """
    columns = [c for c in samples.columns if c not in (*keys, "t")]
    a = samples.select(*keys, "t", F.lit(1).alias("side"), F.struct(F.lit(1).alias("_"), *columns).alias("mine"))
    b = spans.select(*keys, F.col("start_t").alias("t"), F.lit(0).alias("side"), F.struct("start_t", "end_t", *also).alias("span"))
    w = Window.partitionBy(*keys).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    held = a.unionByName(b, allowMissingColumns=True).withColumn("span", F.last("span", True).over(w)).where("side = 1 AND t <= span.end_t")
    return held.select(*keys, "t", *(F.col(f"mine.{c}").alias(c) for c in columns), *(F.col(f"span.{c}").alias(c) for c in ("start_t", "end_t", *also)))


def figure8_laps(track: DataFrame, rate: float, shortest: float = SHORTEST) -> DataFrame:
    """Laps of a figure of eight, one per loop: lines through places that are visited three times, crossed both ways.

    The line wins whose laps have a direction most often, then the one whose directions change most, then whose
    times vary least; with under six such loops a session is cut by `gps_laps`. A session's track is read once for
    each of its places, which its extent bounds.
    """
    span, phase = max(1, round(rate)), settled(driving(track, rate), "phase")
    lines = gate_candidates(track).where(F.col("entries") >= EIGHT_ENTRIES).select("session_id", "first_i", "px", "py", F.lit(LINE).alias("half"))
    found = settled(line_crossings(track, lines, span, shortest, directed=False), "crossings")
    enough = settled(found.join(phase.select("session_id", "start_t"), "session_id").where("t >= start_t").groupBy(*GATE).agg(F.count("*").alias("n")).where(F.col("n") >= EIGHT_CROSSINGS), "gates")
    tried = settled(cut(found.join(enough.select(*GATE), list(GATE), "left_semi"), enough.select(*GATE).join(phase, "session_id"), GATE), "tried")
    took = F.col("end_t") - F.col("start_t")
    full = tried.where("complete").withColumn("took", took).where(F.col("took") >= shortest)
    median = F.percentile("took", 0.5).over(Window.partitionBy(*GATE))
    full = full.withColumn("median", median).where("took BETWEEN 0.4 * median AND 2.5 * median")
    pieces = within(track.select("session_id", "i", "t", "x", "y").join(enough.select(*GATE), "session_id"), full, GATE)
    loops = full.join(turn_direction(pieces, (*GATE, "lap_index")), [*GATE, "lap_index"]).where("turn <> 0")
    loops = loops.withColumn("changes", (F.col("turn") != F.lag("turn").over(Window.partitionBy(*GATE).orderBy("lap_index"))).cast("int"))
    ranks = loops.groupBy(*GATE).agg(F.count("*").alias("loops"), F.avg("changes").alias("changes"), (F.stddev_pop("took") / F.avg("took")).alias("variation"))
    rank = F.struct("loops", "changes", -F.col("variation"), -F.col("first_i"))
    best = settled(ranks.where(F.col("loops") >= EIGHT_LOOPS).groupBy("session_id").agg(F.max_by("first_i", rank).alias("first_i")), "best")
    eights = tried.join(best, list(GATE), "left_semi").drop("first_i", "way_m")
    return eights.unionByName(gps_laps(track.join(best, "session_id", "left_anti"), rate, shortest=shortest))


def lap_way(laps: DataFrame, samples: DataFrame) -> DataFrame:
    """Adds way_m: `distance` at the last sample up to the end less that at the last one up to the start."""
    ends = laps.select("session_id", "lap_index", F.explode(F.array(F.struct(F.col("start_t").alias("t"), F.lit(0).alias("end")), F.struct(F.col("end_t").alias("t"), F.lit(1).alias("end")))).alias("e"))
    a = ends.select("session_id", "e.t", F.lit(1).alias("side"), "lap_index", "e.end")
    b = samples.select("session_id", "t", F.lit(0).alias("side"), F.col("distance").alias("d"))
    w = Window.partitionBy("session_id").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    held = a.unionByName(b, allowMissingColumns=True).withColumn("d", F.last("d", True).over(w)).where("side = 1")
    way = held.groupBy("session_id", "lap_index").agg((F.max(F.when(F.col("end") == 1, F.col("d"))) - F.coalesce(F.max(F.when(F.col("end") == 0, F.col("d"))), F.lit(0.0))).alias("way_m"))
    return laps.join(way, ["session_id", "lap_index"], "left")


def detect_laps(track: DataFrame, runs: DataFrame, rate: float, counted: DataFrame | None = None, shortest: float = SHORTEST) -> DataFrame:
    """Each session's laps by the kind that fits: adds method (counter, figure8, gps or run), lap_time, turn.

    Laps from a live counter or beacon channel (`counted`, as of `change_laps`) win; else the track's kind
    decides. A circuit with at most two laps, none complete, and at least two `runs` (as of `segment.runs`) is cut by
    runs, as are sessions without a track. Laps of under `shortest` seconds are left out and
    implausible ones made incomplete, but not runs. Loops of a figure of eight get their turn, else it is NULL.
    """
    columns = ("session_id", "lap_index", "start_t", "end_t", "complete")
    track = settled(track.select(*(c for c in track.columns if c in TRACK)), "track")  # each search reads it several times
    driven_ = settled(runs.select("session_id", F.col("run").cast("long").alias("lap_index"), "start_t", "end_t", F.lit(True).alias("complete")), "runs")
    none = driven_.where("false")
    counted = none if counted is None else counted.select(*columns)
    rest = track.join(counted.select("session_id").distinct(), "session_id", "left_anti")
    kinds = settled(classify_track(rest, "speed").select("session_id", "kind"), "kinds")
    of = lambda kind: rest.join(kinds.where(F.col("kind") == kind), "session_id", "left_semi")
    eights = figure8_laps(of("figure8"), rate, shortest).select(*columns, F.lit("figure8").alias("method"))
    rounds = gps_laps(of("circuit"), rate, shortest=shortest).select(*columns, F.lit("gps").alias("method"))
    cut_ = settled(counted.withColumn("method", F.lit("counter")).unionByName(eights).unionByName(rounds).where(F.col("end_t") - F.col("start_t") >= shortest), "cuts")
    poor = cut_.where("method = 'gps'").groupBy("session_id").agg(F.count("*").alias("n"), F.bool_or("complete").alias("any")).where("n <= 2 AND NOT any")
    several = driven_.groupBy("session_id").agg(F.count("*").alias("n")).where("n >= 2").select("session_id")
    poor = poor.select("session_id").join(several, "session_id", "left_semi")
    by_run = driven_.join(cut_.join(poor, "session_id", "left_anti").select("session_id").distinct(), "session_id", "left_anti")
    kept = cut_.join(poor, "session_id", "left_anti").withColumn("lap_time", F.col("end_t") - F.col("start_t"))
    kept = settled(plausible(lap_way(kept, driven(track).withColumn("distance", present(F.col("driven")))), "way_m").drop("way_m"), "laps")
    turns = turn_direction(within(track.select("session_id", "i", "t", "x", "y"), kept.where("method = 'figure8'")), ("session_id", "lap_index"))
    kept = kept.join(turns.withColumn("figure8", F.lit(True)), ["session_id", "lap_index"], "left").withColumn("turn", F.when((F.col("method") == "figure8") & (F.col("turn") != 0), F.col("turn"))).drop("figure8")
    return kept.unionByName(by_run.withColumn("method", F.lit("run")).withColumn("lap_time", F.col("end_t") - F.col("start_t")).withColumn("turn", F.lit(None).cast("int")))


def beacon_laps(track: DataFrame, beacons: DataFrame, rate: float, shortest: float = 4.0) -> DataFrame:
    """A series of laps for each beacon (session_id, beacon, px, py): adds beacon; what lies before its first and after its last passage isn't complete."""
    kind = track.schema["session_id"].dataType
    key = F.to_json(F.struct("session_id", "beacon"))
    named = beacons.select("session_id", "beacon", "px", "py").withColumn("key", key)
    each = track.join(named.select("session_id", "key"), "session_id").drop("session_id").withColumnRenamed("key", "session_id")
    laps = gps_laps(each, rate, named.select(F.col("key").alias("session_id"), "px", "py"))
    laps = laps.where(F.col("end_t") - F.col("start_t") >= shortest).withColumnRenamed("session_id", "key")
    w = Window.partitionBy("key").orderBy("start_t")
    numbered = laps.withColumn("lap_index", F.row_number().over(w).cast("long") - 1)
    return numbered.join(named.select("session_id", "beacon", "key"), "key").select(F.col("session_id").cast(kind), "beacon", "lap_index", "start_t", "end_t", "complete")


def section_bands(samples: DataFrame, laps: DataFrame, sections: DataFrame) -> DataFrame:
    """When each lap is in each section: (session_id, lap_index, section, kind, start_t, end_t, duration).

    `sections` (session_id, section, kind, start_m, end_m) belong to the reference lap; on another lap their edges lie at
    the same shares of its way, where that is first reached (`samples`: session_id, i, t, distance). The first and
    the last edge are the lap's own start and end. Laps without samples have no bands.
    """
    lap = ("session_id", "lap_index")
    held = within(samples.select("session_id", "i", "t", "distance"), laps)
    w = _upto(*lap)
    held = held.withColumn("way", F.max("distance").over(w) - F.first("distance").over(w))
    reached = held.groupBy(*lap, "way").agg(F.min("t").alias("t"))
    whole = held.groupBy(*lap).agg(F.max("way").alias("whole"), F.first("start_t").alias("start_t"), F.first("end_t").alias("end_t"))
    length = F.max("end_m").over(Window.partitionBy("session_id"))
    edges = sections.withColumn("share", F.when(length > 0, F.col("end_m") / length).otherwise(0.0)).withColumn("last", F.col("end_m") == length)
    targets = whole.join(edges, "session_id").withColumn("way", F.least(F.col("share"), F.lit(1.0)) * F.col("whole"))
    columns = ["section", "kind", "start_t", "end_t", "last"]
    a = targets.select(*lap, "way", F.lit(0).alias("side"), F.struct(*columns).alias("edge"))
    b = reached.select(*lap, "way", F.lit(1).alias("side"), "t")
    back = Window.partitionBy(*lap).orderBy(F.desc("way"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    at = a.unionByName(b, allowMissingColumns=True).withColumn("t", F.last("t", True).over(back)).where("side = 0").select(*lap, "edge.*", "t")
    at = at.withColumn("until", F.when(F.col("last"), F.col("end_t")).otherwise(F.col("t")))
    start = F.coalesce(F.lag("until").over(Window.partitionBy(*lap).orderBy("section")), F.col("start_t"))
    bands = at.select(*lap, "section", "kind", start.alias("start_t"), F.col("until").alias("end_t"))
    return bands.withColumn("duration", F.greatest(F.lit(0.0), F.col("end_t") - F.col("start_t")))


def band_samples(samples: DataFrame, bands: DataFrame) -> DataFrame:
    """Samples with the lap and section they fall in; an edge belongs to the later band, a lap's last one to its last."""
    return within(samples, bands.where("end_t > start_t"), also=("lap_index", "section", "kind"))


def place_notes(notes: DataFrame, samples: DataFrame, track: DataFrame) -> DataFrame:
    """Notes (session_id, t, note) with distance, linear between samples, and x, y of the closest track sample (of two as close the earlier).

    Beyond the first and the last sample, or without any, a place is NULL.
    """
    kept = notes.select("session_id", "t", "note")
    far = interpolate(kept, samples.select("session_id", "t", F.col("distance").alias("v")), clamp=False).withColumnRenamed("value", "distance")
    near = nearest(far, track.select("session_id", "t", F.struct("x", "y").alias("v")), inside=True)
    return near.select("session_id", "t", "note", "distance", "value.x", "value.y")


def distance_window(samples: DataFrame, start_m: float, end_m: float) -> DataFrame:
    """(session_id, start_t, end_t) of a range of metres: first arrival at its start, last sample that isn't beyond its end.

    Starts beyond a session's way give its last sample, and a range never ends before it starts.
    """
    s = samples.select("session_id", "i", "t", F.max("distance").over(_upto()).alias("top"))
    at = lambda hit: F.when(hit, F.struct("i", "t"))
    g = s.groupBy("session_id").agg(F.min(at(F.col("top") >= start_m)).alias("a"), F.max(at(F.col("top") <= end_m)).alias("z"), F.max(F.struct("i", "t")).alias("end"))
    first = F.coalesce("a", "end")
    return g.select("session_id", first["t"].alias("start_t"), F.when(F.col("z").isNull() | (F.col("z.i") < first["i"]), first["t"]).otherwise(F.col("z.t")).alias("end_t"))


def insert_crossings(laps: DataFrame, missed: DataFrame) -> DataFrame:
    """Laps with crossings that were missed (session_id, t) put in; one within 0.05 s of a lap's edge is that edge.

    Of crossings entered within 0.05 s of each other the earliest counts. The first and the last lap aren't complete.
    """
    edges = laps.select("session_id", F.explode(F.array("start_t", "end_t")).alias("t")).distinct().withColumn("new", F.lit(False))
    here = missed.join(laps.select("session_id").distinct(), "session_id", "left_semi").select("session_id", "t").withColumn("new", F.lit(True))
    w = Window.partitionBy("session_id").orderBy("t")
    known = F.when(~F.col("new"), F.col("t"))
    both = edges.union(here).withColumn("before", F.last(known, True).over(w)).withColumn("after", F.last(known, True).over(Window.partitionBy("session_id").orderBy(F.desc("t"))))
    apart = both.where(F.col("new") & (F.coalesce(F.col("t") - F.col("before"), F.lit(1.0)) > SNAP) & (F.coalesce(F.col("after") - F.col("t"), F.lit(1.0)) > SNAP))
    merged = edges.select("session_id", "t").union(debounce(apart, SNAP).select("session_id", "t"))
    n, all_ = F.row_number().over(w), F.count("*").over(Window.partitionBy("session_id"))
    out = merged.withColumn("end_t", F.lead("t").over(w)).withColumn("lap_index", n.cast("long") - 1).withColumn("complete", (n > 1) & (n < all_ - 1))
    return out.where("end_t IS NOT NULL").select("session_id", "lap_index", F.col("t").alias("start_t"), "end_t", "complete")
