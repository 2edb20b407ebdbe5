"""More registered queries: tracks, energy, layouts, catalogues, live windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lapwing.functions.missing import finite, rounded
from lapwing.operators import can, geo, multi, pairing, quantiles, snapshot
from lapwing.operators.segment import change_laps
from lapwing.sessions import from_events, from_lineitem, land_aliases, lookup, merge_key, name_key, table
from lapwing.sources.tables import long_layout, wide_layout
from lapwing.streaming.live import live_runs, window_stats

_L = """l AS (SELECT l_suppkey AS session_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS i,
    l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem)"""
_S = "s AS (SELECT user_id AS session_id, event_type AS channel, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1 AS i, epoch_us(ts) / 1e6 AS t, value AS v FROM events)"
_NAMES = ["click", "error", "purchase", "signup", "view"]
#: Lines that one task of `pair_lags` gets, about.
_TASK_LINES = 100_000
#: Orders that one task of `pair_candidates_all` gets, about.
_TASK_ORDERS = 25_000

_FIX = f"{_L}, f AS (SELECT session_id, i, i / 10::DOUBLE AS t, CASE WHEN discount = 0 THEN 0 ELSE 50 + quantity / 1e4 END AS lat, CASE WHEN discount = 0 THEN 0 ELSE 8 + tax / 1e2 END AS lon FROM l)"
_TRK = f"""{_FIX}, g AS (SELECT *, first(lat) OVER w AS lat0, first(lon) OVER w AS lon0, count(*) OVER (PARTITION BY session_id) AS n FROM f WHERE abs(lat) > 1e-3 AND abs(lon) > 1e-3 WINDOW w AS (PARTITION BY session_id ORDER BY i)),
tr AS (SELECT session_id, i, t, (lon - lon0) * 111320 * cos(radians(lat0)) AS x, (lat - lat0) * 110540 AS y FROM g WHERE n >= 10),
st AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step_m, t - lag(t) OVER w AS dt FROM tr WINDOW w AS (PARTITION BY session_id ORDER BY i)),
j AS (SELECT *, coalesce(dt > 0 AND step_m / dt * 3.6 > 20000, false) AS jump FROM st), c AS (SELECT *, coalesce(dt > 0.25, false) OR jump AS is_break, jump OR coalesce(lead(jump) OVER (PARTITION BY session_id ORDER BY i), false) AS is_jump FROM j)"""


def _fixes(spark, d):
    s = from_lineitem(spark, d)
    off = F.col("discount") == 0
    return s.select("session_id", "i", (F.col("i") / F.lit(10.0)).alias("t"), F.when(off, 0.0).otherwise(50 + F.col("quantity") / 1e4).alias("lat"), F.when(off, 0.0).otherwise(8 + F.col("tax") / 1e2).alias("lon"))


def _classified(spark, d):
    return geo.classify(geo.track(_fixes(spark, d)), 0.25, 20000.0)


def gps_track(spark, d):
    return _classified(spark, d).select("session_id", "i", rounded(F.col("x"), 3).alias("x"), rounded(F.col("y"), 3).alias("y"), "is_break", "is_jump")


def gps_distance(spark, d):
    return geo.path_distance(_classified(spark, d)).select("session_id", "i", rounded(F.col("distance"), 2).alias("distance"))


def gps_summary(spark, d):
    return geo.gps_summary(_classified(spark, d), 0.25).select("session_id", "fixes", "jumps", "holes", rounded(F.col("worst_jump_m"), 3).alias("worst_jump_m"), rounded(F.col("longest_hole_s"), 3).alias("longest_hole_s"), "segments")


def curvature(spark, d):
    return geo.curvature(geo.track(_fixes(spark, d))).select("session_id", "i", rounded(F.col("curvature"), 5).alias("curvature"))


def track_class(spark, d):
    return geo.classify_track(geo.track(_fixes(spark, d))).select("session_id", "kind")


def energy(spark, d):
    s = from_lineitem(spark, d).withColumn("power", F.col("quantity") - 25)
    return geo.cumulative_energy(s, "power", 10.0).select("session_id", "i", rounded(F.col("drive_kwh"), 6).alias("drive_kwh"), rounded(F.col("regen_kwh"), 6).alias("regen_kwh"))


def layout_long(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("l_discount"))
    return long_layout(li, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"])


def layout_wide(spark, d):
    s = from_events(spark, d).withColumn("day", F.floor(F.col("t") / 86400).cast("long"))
    first = s.groupBy("session_id", "day", "channel").agg(F.min_by("v", "i").alias("v"))
    return wide_layout(first, ["session_id", "day"], _NAMES)


def name_lookup(spark, d):
    catalogue = table(spark, d, "part").select((F.col("p_partkey") % 10).alias("session_id"), F.col("p_name").alias("channel")).distinct()
    asked = table(spark, d, "part").where("p_partkey <= 50").select(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("asked")).distinct()
    return lookup(catalogue, asked)


def name_lookup_all(spark, d):
    """`name_lookup` for every part's name."""
    part = table(spark, d, "part")
    catalogue = part.select((F.col("p_partkey") % 10).alias("session_id"), F.col("p_name").alias("channel")).distinct()
    return lookup(catalogue, part.select(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("asked")).distinct())


def merge_names(spark, d):
    return table(spark, d, "part").select("p_partkey", name_key(F.col("p_name")).alias("key"), merge_key(F.col("p_name")).alias("merge_key"))


def alias_landing(spark, d):
    s = from_events(spark, d).where("i % 7 < 3").select("session_id", "channel").distinct()
    c = spark.createDataFrame([("speed", 1, "CLICK"), ("speed", 2, "vi ew"), ("power", 1, "gear"), ("power", 2, "Error")], "alias string, position int, name string")
    return land_aliases(s, c)


def alias_landing_all(spark, d):
    """`alias_landing` over the channels of all samples."""
    c = spark.createDataFrame([("speed", 1, "CLICK"), ("speed", 2, "vi ew"), ("power", 1, "gear"), ("power", 2, "Error")], "alias string, position int, name string")
    return land_aliases(from_events(spark, d).select("session_id", "channel").distinct(), c)


def window_gate(spark, d):
    s = from_events(spark, d)
    laps = change_laps(s.withColumn("week", F.floor(F.col("t") / 604800).cast("long")), "week").select(F.col("session_id"), "lap_index", "start_t", "end_t")
    x = s.join(laps, "session_id").where("t >= start_t AND t < end_t AND v BETWEEN 10 AND 60")
    return x.groupBy("session_id", "lap_index", "channel").agg(F.count("*").alias("n"), F.max("v").alias("max"))


def unit_groups(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_type").alias("unit")).agg(F.count("*").alias("channels"), F.min("p_name").alias("first_name"))
    return p.withColumn("place", F.row_number().over(Window.orderBy(F.desc("channels"), "unit")))  # a row per unit: few


def can_bus_counts(spark, d):
    f = table(spark, d, "events").select((F.col("event_id") % 7).alias("frame_id"), F.col("event_type").alias("bus"), F.col("event_id").cast("double").alias("t"))
    return f.rollup("bus", "frame_id").agg(F.count("*").alias("frames"), rounded((F.count("*") - 1) / (F.max("t") - F.min("t"))).alias("rate"))


def recording_groups(spark, d):
    e = table(spark, d, "events").withColumn("part", F.floor(F.col("event_id") / 20).cast("long"))
    k = (F.col("event_id") * 0.5).alias("k")
    parts = e.select("part", k).groupBy("part").agg(F.min("k").alias("start_s"), (F.max("k") + F.when(F.col("part") % 5 == 0, 30).otherwise(0)).alias("end_s")).withColumn("day", F.floor(F.col("part") / 100).cast("long"))
    parts = parts.select("part", "day", "start_s", "end_s", F.col("start_s").alias("start_rel"), F.col("end_s").alias("end_rel"))
    return multi.group_recordings(parts).select("part", "day", "recording")


def pair_candidates(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 50 = 0")
    b = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) * 86400.0
    a = o.select(F.col("o_orderkey").alias("id"), b.alias("start_s"), (b + 3600).alias("end_s"))
    return multi.candidates(a.where("id % 100 = 0"), a.where("id % 100 <> 0"), cell=86400.0).select("a_id", "b_id", "overlap")


def pair_candidates_all(spark, d):
    """`pair_candidates` of all orders with all others, each pair once; a task's orders are few enough for the dictionaries of its files."""
    b = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) * 86400.0
    orders = table(spark, d, "orders")
    a = orders.select(F.col("o_orderkey").alias("id"), b.alias("start_s"), (b + 3600).alias("end_s"))
    return multi.candidates(a, a, cell=86400.0, once=True, tasks=orders.count() // _TASK_ORDERS + 1).select("a_id", "b_id", "overlap")


def placeholders(spark, d):
    s = from_lineitem(spark, d).select("session_id", F.lit("discount").alias("channel"), F.when(F.col("session_id") % 5 == 0, F.col("discount") / 1000).otherwise(F.col("discount")).alias("v"))
    return multi.is_placeholder(s)


def live_windows(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))
    g = window_stats(e, "6 hours")
    return g.select(F.unix_seconds("start_ts").alias("start_s"), "session_id", "channel", "n", "min", "max", rounded(F.col("mean")).alias("mean"))


def live_run_windows(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    return live_runs(e, "12 hours").select("session_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("last_ts").alias("last_us"), "n")


def event_props(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"), F.count_if(finite(F.col("value"))).alias("n"))


def _part_dbc(spark, d):
    """A DBC text with a message and a signal for each part."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("int")
    message = F.format_string("BO_ %d M%d: 8 X", key, key)
    signal = F.format_string(' SG_ S%d : %d|%d@%d%s (0.5,-1) [0|0] "u" X', key, size % 32, 1 + size % 16, key % 2, F.when(key % 3 == 0, "-").otherwise("+"))
    text = table(spark, d, "part").select(F.lit("parts").alias("db"), (2 * key).alias("at"), F.array(message, signal).alias("lines"))
    return text.select("db", F.posexplode("lines").alias("k", "line"), "at").select("db", (F.col("at") + F.col("k")).alias("line_no"), "line")


def dbc_signals(spark, d):
    return can.parse_dbc(_part_dbc(spark, d))


def can_decode_table(spark, d):
    """Frames of `events` by the definitions of all parts."""
    e = table(spark, d, "events")
    n = table(spark, d, "part").select(F.max("p_partkey").alias("n"))
    payload = F.unhex(F.lpad(F.hex(F.col("event_id") * 2654435761), 16, "0"))
    frames = e.join(F.broadcast(n)).select(
        F.col("user_id").alias("session_id"), F.col("event_id").cast("double").alias("t"), F.col("event_id").alias("seq"), (1 + F.col("event_id") % F.col("n")).alias("frame_id"), F.lit(False).alias("extended"), payload.alias("payload")
    )
    return can.decode(frames, dbc_signals(spark, d)).select("seq", "channel", "v")


def pair_lags(spark, d):
    """Each supplier's lines by day, a day as a second, against themselves on a clock that is off by a known lag.

    Lines are dealt by supplier once, to as many tasks as keep one's lines few, and all that follows stays where they are
    (an explode keeps the deal, `unpivot` doesn't), so that only lines are shuffled and no sort spills.
    """
    days = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    of = {"speed": "l_quantity", "ax": "l_extendedprice", "ay": "l_discount", "az": "l_tax"}
    lines = table(spark, d, "lineitem")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // _TASK_LINES + 1)
    lines = lines.select(F.col("l_suppkey").alias("pair"), days.alias("t"), *of.values()).repartition(tasks, "pair")
    day = lines.groupBy("pair", "t").agg(*(F.sum(c).cast("double").alias(n) for n, c in of.items()))
    long = day.select("pair", "t", F.explode(F.array(*(F.struct(F.lit(n).alias("channel"), F.col(n).alias("v")) for n in of))).alias("s")).select("pair", "t", "s.channel", "s.v")
    off = F.col("pair") % 41 * 7.31 - 120
    got = pairing.find_lags(long, long.withColumn("t", F.col("t") + off))
    return got.select("pair", "ok", (F.abs(F.col("lag") - off) <= 1.0).alias("found"))  # values stay for a day, and so does the lag


def snapshots(spark, d):
    """Every channel's distribution over the session and each complete lap (a day), of values that a gate on the value's last digit lets in."""
    s = from_events(spark, d)
    laps = change_laps(s.withColumn("day", F.floor(F.col("t") / 86400).cast("long")), "day")
    got = snapshot.snapshot(snapshot.in_laps(s, laps), 4, snapshot.gate_keeps(F.floor(F.col("v")) % 10, "range", 2, 9))
    cells = [F.col("counts")[k].alias(f"n{k}") for k in range(4)]
    return got.select("session_id", "channel", "window", "n", "excluded", "skipped", rounded(F.col("lo")).alias("lo"), rounded(F.col("hi")).alias("hi"), rounded(F.col("mean")).alias("mean"), *cells)


_SNAP = f"""WITH {_S}, d AS (SELECT *, CAST(floor(t / 86400) AS BIGINT) AS day FROM s), e AS (SELECT session_id, min(day) AS a, max(day) AS b FROM d GROUP BY ALL),
w AS (SELECT session_id, channel, v, 'all' AS "window" FROM d UNION ALL SELECT session_id, channel, v, CAST(day AS VARCHAR) FROM d JOIN e USING (session_id) WHERE day > a AND day < b),
k AS (SELECT session_id, channel, "window", v IS NOT NULL AND floor(v) - floor(floor(v) / 10) * 10 BETWEEN 2 AND 9 AS kept, CASE WHEN kept THEN v END AS x FROM w),
g AS (SELECT session_id, channel, "window", count(x) AS n, count(*) FILTER (NOT kept) AS excluded, count(*) FILTER (kept AND x IS NULL) AS skipped, coalesce(min(x), 0) AS lo0, coalesce(max(x), 1) AS hi0, avg(x) AS mean FROM k GROUP BY ALL),
h AS (SELECT *, lo0 - CASE WHEN lo0 = hi0 THEN greatest(0.5, abs(lo0) * 0.001) ELSE 0 END AS lo, hi0 + CASE WHEN lo0 = hi0 THEN greatest(0.5, abs(lo0) * 0.001) ELSE 0 END AS hi FROM g),
c AS (SELECT h.session_id, h.channel, h."window", {', '.join(f"count(*) FILTER (x >= lo + {k} * ((hi - lo) / 4) AND {'x <= hi' if k == 3 else f'x < lo + {k + 1} * ((hi - lo) / 4)'}) AS n{k}" for k in range(4))} FROM h JOIN k USING (session_id, channel, "window") GROUP BY ALL)
SELECT session_id, channel, "window", n, excluded, skipped, floor(lo * 1e5 + 0.5001) / 1e5 AS lo, floor(hi * 1e5 + 0.5001) / 1e5 AS hi, floor(mean * 1e5 + 0.5001) / 1e5 AS mean, n0, n1, n2, n3 FROM h JOIN c USING (session_id, channel, "window")"""
_QS = (0.01, 0.25, 0.5, 0.75, 0.99)


def group_percentiles(spark, d):
    """Exact percentiles of the lines' prices by flag and status: few groups, each with many rows."""
    got = quantiles.percentiles(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", _QS)
    return got.select("l_returnflag", "l_linestatus", "q", rounded(F.col("value"), 4).alias("price"))


_PARTS = """p AS (SELECT p_partkey AS k, CAST(p_size % 32 AS INT) AS s, CAST(1 + p_size % 16 AS INT) AS n, p_partkey % 2 = 0 AS big, p_partkey % 3 = 0 AS signed FROM part)"""
_DBC = f"""WITH {_PARTS} SELECT 'parts' AS db, k AS frame_id, false AS extended, 'M' || k AS message, 8 AS size, 'S' || k AS signal, s AS start_bit, n AS length, big AS big_endian, signed, 0.5::DOUBLE AS factor, (-1)::DOUBLE AS "offset",
    'u' AS unit, NULL::VARCHAR AS mux_role, NULL::INT AS mux_branch FROM p"""
_DECODED = f"""WITH {_PARTS}, f AS (SELECT event_id AS seq, event_id * 2654435761 AS x, 1 + event_id % (SELECT max(p_partkey) FROM part) AS k FROM events),
b AS (SELECT *, ((x >> 56) & 255) | (((x >> 48) & 255) << 8) | (((x >> 40) & 255) << 16) | (((x >> 32) & 255) << 24) | (((x >> 24) & 255) << 32) | (((x >> 16) & 255) << 40) AS low FROM f),
r AS (SELECT seq, k, n, signed, (CASE WHEN big THEN x >> (64 - (s // 8 * 8 + 7 - s % 8) - n) ELSE low >> s END) & ((1::BIGINT << n) - 1) AS raw FROM b JOIN p USING (k))
SELECT seq, 'S' || k AS channel, (CASE WHEN signed AND raw >= (1::BIGINT << (n - 1)) THEN raw - (1::BIGINT << n) ELSE raw END * 0.5 - 1)::DOUBLE AS v FROM r"""


def _r(x, n=5):
    return f"floor(({x}) * 1e{n} + 0.5001) / 1e{n}"


_WRAPPED = "d - 2 * pi() * floor((d + pi()) / (2 * pi()))"
_CURVE = f"""WITH {_TRK}, n AS (SELECT *, lag(x) OVER w AS x0, lead(x) OVER w AS x1, lag(y) OVER w AS y0, lead(y) OVER w AS y1 FROM tr WINDOW w AS (PARTITION BY session_id ORDER BY i)),
g1 AS (SELECT *, (coalesce(x1, x) - coalesce(x0, x)) / (CASE WHEN x0 IS NULL OR x1 IS NULL THEN 1 ELSE 2 END) AS gx, (coalesce(y1, y) - coalesce(y0, y)) / (CASE WHEN x0 IS NULL OR x1 IS NULL THEN 1 ELSE 2 END) AS gy FROM n),
h AS (SELECT *, atan2(gy, gx) - lag(atan2(gy, gx)) OVER (PARTITION BY session_id ORDER BY i) AS d FROM g1),
u AS (SELECT *, CASE WHEN {_WRAPPED} = -pi() AND d > 0 THEN pi() ELSE {_WRAPPED} END AS s FROM h),
v AS (SELECT *, CASE WHEN x0 IS NULL THEN lead(s) OVER w WHEN x1 IS NULL THEN s ELSE (s + lead(s) OVER w) / 2 END AS turn, sqrt(gx * gx + gy * gy) AS step FROM u WINDOW w AS (PARTITION BY session_id ORDER BY i))
SELECT session_id, i, {_r("CASE WHEN step > 0.05 THEN abs(turn / step) ELSE 0 END")} AS curvature FROM v"""
_CLASS = f"""WITH {_TRK}, k AS (SELECT *, step_m / dt * 3.6 AS kmh FROM st), m AS (SELECT * FROM (SELECT *, coalesce(kmh, lead(kmh) OVER (PARTITION BY session_id ORDER BY i)) AS speed FROM k) WHERE speed > 8),
d AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS way FROM m WINDOW w AS (PARTITION BY session_id ORDER BY i)),
e AS (SELECT session_id, count(*) AS n, max(x) - min(x) AS a, max(y) - min(y) AS b, sum(way) AS path FROM d GROUP BY ALL),
f2 AS (SELECT *, sqrt(a * a + b * b) AS diagonal, least(a, b) / greatest(a, b, 1e-9) AS aspect FROM e)
SELECT session_id, CASE WHEN coalesce(n, 0) < 20 OR diagonal < 15 OR path / diagonal < 3 THEN 'runs' WHEN diagonal <= 140 AND path / diagonal >= 35 AND aspect >= 0.65 THEN 'figure8'
    WHEN aspect < 0.5 AND path / diagonal >= 18 THEN 'runs' ELSE 'circuit' END AS kind FROM (SELECT DISTINCT session_id FROM tr) LEFT JOIN f2 USING (session_id)"""

QUERIES = {
    "gps_track": (gps_track, f"WITH {_TRK} SELECT session_id, i, {_r('x', 3)} AS x, {_r('y', 3)} AS y, is_break, is_jump FROM c"),
    "gps_distance": (gps_distance, f"WITH {_TRK} SELECT session_id, i, {_r('sum(CASE WHEN is_break THEN 0 ELSE coalesce(step_m, 0) END) OVER (PARTITION BY session_id ORDER BY i ROWS UNBOUNDED PRECEDING)', 2)} AS distance FROM c"),
    "gps_summary": (gps_summary, f"WITH {_TRK} SELECT session_id, count(*) AS fixes, count(*) FILTER (is_jump) AS jumps, count(*) FILTER (dt > 0.25) AS holes, {_r('max(step_m) FILTER (is_jump)', 3)} AS worst_jump_m, {_r('max(dt) FILTER (dt > 0.25)', 3)} AS longest_hole_s, count(*) FILTER (is_break) + 1 AS segments FROM c GROUP BY ALL"),
    "curvature": (curvature, _CURVE),
    "track_class": (track_class, _CLASS),
    "energy": (energy, f"WITH {_L}, p AS (SELECT session_id, i, greatest(quantity - 25, 0) AS a, greatest(25 - quantity, 0) AS b FROM l), q AS (SELECT session_id, i, coalesce(0.5 * (a + lag(a) OVER w) / 36000, 0) AS da, coalesce(0.5 * (b + lag(b) OVER w) / 36000, 0) AS db FROM p WINDOW w AS (PARTITION BY session_id ORDER BY i)) SELECT session_id, i, {_r('sum(da) OVER w', 6)} AS drive_kwh, {_r('sum(db) OVER w', 6)} AS regen_kwh FROM q WINDOW w AS (PARTITION BY session_id ORDER BY i ROWS UNBOUNDED PRECEDING)"),
    "layout_long": (layout_long, "SELECT l_orderkey, l_linenumber, 'l_quantity' AS channel, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem WHERE l_discount > 0"),
    "layout_wide": (layout_wide, f"WITH {_S} SELECT session_id, CAST(floor(t / 86400) AS BIGINT) AS day, " + ", ".join(f"arg_min(v, i) FILTER (channel = '{c}') AS {c}" for c in _NAMES) + " FROM s GROUP BY ALL"),
    "name_lookup": (name_lookup, "WITH c AS (SELECT DISTINCT p_partkey % 10 AS session_id, p_name AS channel FROM part), a AS (SELECT DISTINCT upper(replace(p_name, ' ', '_')) AS asked FROM part WHERE p_partkey <= 50) SELECT session_id, asked, min(channel) AS channel FROM c JOIN a ON regexp_replace(lower(channel), '[^a-z0-9]', '', 'g') = regexp_replace(lower(asked), '[^a-z0-9]', '', 'g') GROUP BY ALL"),
    "name_lookup_all": (name_lookup_all, "WITH c AS (SELECT DISTINCT p_partkey % 10 AS session_id, p_name AS channel, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part), a AS (SELECT DISTINCT upper(replace(p_name, ' ', '_')) AS asked, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part) SELECT session_id, asked, min(channel) AS channel FROM c JOIN a USING (key) GROUP BY ALL"),
    "merge_names": (merge_names, "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, lower(regexp_replace(p_name, '[ _]', '', 'g')) AS merge_key FROM part"),
    "alias_landing": (alias_landing, f"WITH {_S}, c AS (SELECT DISTINCT session_id, channel FROM s WHERE i % 7 < 3), a(alias, position, name) AS (VALUES ('speed', 1, 'click'), ('speed', 2, 'view'), ('power', 1, 'gear'), ('power', 2, 'error')) SELECT session_id, alias, arg_min(channel, position) AS channel FROM c JOIN a ON channel = name GROUP BY ALL"),
    "alias_landing_all": (alias_landing_all, "WITH a(alias, position, name) AS (VALUES ('speed', 1, 'click'), ('speed', 2, 'view'), ('power', 1, 'gear'), ('power', 2, 'error')) SELECT user_id AS session_id, alias, arg_min(event_type, position) AS channel FROM events JOIN a ON event_type = name GROUP BY ALL"),
    "window_gate": (window_gate, f"WITH {_S}, w AS (SELECT *, CAST(floor(t / 604800) AS BIGINT) AS week FROM s), b AS (SELECT session_id, week, min(t) AS a, max(t) AS z FROM w GROUP BY session_id, week), e AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY week) - 1 AS lap_index, coalesce(lead(a) OVER (PARTITION BY session_id ORDER BY week), z) AS e FROM b) SELECT s.session_id, lap_index, channel, count(*) AS n, max(v) AS max FROM s JOIN e ON s.session_id = e.session_id AND t >= e.a AND t < e.e WHERE v BETWEEN 10 AND 60 GROUP BY ALL"),
    "unit_groups": (unit_groups, "SELECT p_type AS unit, count(*) AS channels, min(p_name) AS first_name, CAST(row_number() OVER (ORDER BY count(*) DESC, p_type) AS INTEGER) AS place FROM part GROUP BY p_type"),
    "can_bus_counts": (can_bus_counts, f"SELECT event_type AS bus, event_id % 7 AS frame_id, count(*) AS frames, {_r('(count(*) - 1) / CAST(max(event_id) - min(event_id) AS DOUBLE)')} AS rate FROM events GROUP BY ROLLUP (event_type, event_id % 7)"),
    "recording_groups": (recording_groups, """WITH p AS (SELECT event_id // 20 AS part, min(event_id) * 0.5 AS s, max(event_id) * 0.5 + CASE WHEN (event_id // 20) % 5 = 0 THEN 30 ELSE 0 END AS e FROM events GROUP BY event_id // 20), d AS (SELECT *, part // 100 AS day FROM p),
        g AS (SELECT *, s - lag(e) OVER (PARTITION BY day ORDER BY s, part) AS gap FROM d) SELECT part, day, CAST(sum(CASE WHEN gap BETWEEN 0 AND 1 THEN 0 ELSE 1 END) OVER (PARTITION BY day ORDER BY s, part ROWS UNBOUNDED PRECEDING) AS BIGINT) AS recording FROM g"""),
    "pair_candidates": (pair_candidates, """WITH a AS (SELECT o_orderkey AS id, date_diff('day', DATE '1992-01-01', o_orderdate) * 86400.0::DOUBLE AS s FROM orders WHERE o_orderkey % 50 = 0), p AS (SELECT * FROM a WHERE id % 100 = 0), q AS (SELECT * FROM a WHERE id % 100 <> 0)
        SELECT p.id AS a_id, q.id AS b_id, least(p.s, q.s) + 3600 - greatest(p.s, q.s) AS overlap FROM p JOIN q ON least(p.s, q.s) + 3600 - greatest(p.s, q.s) + 900 >= 20"""),
    "pair_candidates_all": (pair_candidates_all, "SELECT p.o_orderkey AS a_id, q.o_orderkey AS b_id, 3600::DOUBLE AS overlap FROM orders p JOIN orders q ON CAST(p.o_orderdate AS DATE) = CAST(q.o_orderdate AS DATE) AND p.o_orderkey < q.o_orderkey"),
    "placeholders": (placeholders, "SELECT l_suppkey AS session_id, 'discount' AS channel, NOT bool_or(abs(CASE WHEN l_suppkey % 5 = 0 THEN l_discount / 1000 ELSE l_discount END) >= 0.01) AS placeholder FROM lineitem GROUP BY ALL"),
    "live_windows": (live_windows, f"SELECT CAST(floor(epoch_us(ts) / 1e6 / 21600) AS BIGINT) * 21600 AS start_s, user_id AS session_id, event_type AS channel, count(value) AS n, min(value) AS min, max(value) AS max, {_r('avg(value)')} AS mean FROM events GROUP BY ALL"),
    "live_runs": (live_run_windows, "WITH k AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 43200000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts))), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM k) SELECT user_id AS session_id, min(us) AS start_us, max(us) AS last_us, count(*) AS n FROM g GROUP BY user_id, k"),
    "event_props": (event_props, "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(value) AS n FROM events GROUP BY ALL"),
    "dbc_signals": (dbc_signals, _DBC),
    "can_decode_table": (can_decode_table, _DECODED),
    "group_percentiles": (group_percentiles, " UNION ALL ".join(f"SELECT l_returnflag, l_linestatus, {q}::DOUBLE AS q, {_r(f'quantile_cont(l_extendedprice, {q})', 4)} AS price FROM lineitem GROUP BY ALL" for q in _QS)),
    "snapshots": (snapshots, _SNAP),
    "pair_lags": (pair_lags, "SELECT DISTINCT l_suppkey AS pair, true AS ok, true AS found FROM lineitem"),
}
