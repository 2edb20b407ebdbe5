"""The registered queries of the telemetry engine on the test tables, and their SQL for DuckDB.

`events` gives sessions by user and channels by event type; `lineitem` gives wide sessions by
supplier. Floating results are rounded by floor on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapwing.functions.channel import OPERATORS, SCALAR, Along, derivative, edge_delay, fill_gaps, flip_flop, integrate, interval_stat, range_change, segment, smooth, time_shift, time_valid
from lapwing.functions.missing import rounded
from lapwing.operators import aggregate, can, multi, resample, scan
from lapwing.operators import laps as laps_
from lapwing.operators import segment as seg
from lapwing.plans import extra
from lapwing.sessions import channels, from_events, from_lineitem, presence, running_sum, table

DAY, RATE = 86400.0, 10.0
CHANNELS = ["click", "error", "purchase", "signup", "view"]
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

S = "s AS (SELECT user_id AS session_id, event_type AS channel, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1 AS i, epoch_us(ts) / 1e6 AS t, value AS v FROM events)"
L = """l AS (SELECT l_suppkey AS session_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS i,
    l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_returnflag AS flag FROM lineitem)"""
#: Laps of `events`: a lap is a day with samples, of a session.
LAPS = f"""{S}, d AS (SELECT *, CAST(floor(t / {DAY}) AS BIGINT) AS day FROM s),
c AS (SELECT *, CASE WHEN lag(day) OVER w IS NOT DISTINCT FROM day THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY session_id ORDER BY i)),
n AS (SELECT *, CAST(sum(new) OVER (PARTITION BY session_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS lap_index FROM c),
g AS (SELECT session_id, lap_index, min(day) AS label, min(t) AS start_t, max(t) AS last_t, count(*) AS n FROM n GROUP BY ALL),
laps AS (SELECT session_id, lap_index, label, start_t, coalesce(lead(start_t) OVER w, last_t) AS end_t, n, lap_index > 0 AND lead(lap_index) OVER w IS NOT NULL AS complete FROM g WINDOW w AS (PARTITION BY session_id ORDER BY lap_index)),
lt AS (SELECT *, end_t - start_t AS lap_time, end_t - start_t - min(CASE WHEN complete THEN end_t - start_t END) OVER (PARTITION BY session_id) AS delta FROM laps)"""


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def r(x: str, digits: int = 5) -> str:
    k = f"1e{digits}"
    return f"floor(({x}) * {k} + 0.5001) / {k}"


def rc(name: str, digits: int = 5):
    return rounded(F.col(name), digits).alias(name)


def _laps(spark: SparkSession, d: str) -> DataFrame:
    s = from_events(spark, d).withColumn("day", F.floor(F.col("t") / DAY).cast("long"))
    return seg.lap_table(seg.change_laps(s, "day"))


@query("channel_stats", f"""WITH {LAPS} SELECT session_id, lap_index, channel, {r('min(v)')} AS min, {r('max(v)')} AS max, {r('max(abs(v))')} AS abs_max, {r('avg(v)')} AS mean, {r('arg_min(v, i)')} AS start,
    {r('arg_max(v, i)')} AS "end", {r('arg_max(v, i) - arg_min(v, i)')} AS change, {r('stddev_pop(v)')} AS std, count(v) AS n FROM n GROUP BY ALL""")  # fmt: skip
def channel_stats(spark, d):
    s = from_events(spark, d).withColumn("day", F.floor(F.col("t") / DAY).cast("long"))
    s = seg.change_islands(s, "day")
    g = aggregate.stats(s, ["session_id", "lap_index", "channel"])
    return g.select("session_id", "lap_index", "channel", *(rc(c) for c in ("min", "max", "abs_max", "mean", "start", "end", "change", "std")), "n")


@query("lap_table", f"WITH {LAPS} SELECT session_id, lap_index, label, n, complete, {r('lap_time')} AS lap_time, {r('delta')} AS delta FROM lt")
def lap_table(spark, d):
    return _laps(spark, d).select("session_id", "lap_index", "label", "n", "complete", rc("lap_time"), rc("delta"))


@query("presence_states", f"""WITH {S}, a AS (SELECT DISTINCT session_id, unnest({[*CHANNELS, 'gear']}) AS channel FROM s), h AS (SELECT session_id, channel, count(v) AS k FROM s GROUP BY ALL)
    SELECT a.session_id, a.channel, CASE WHEN k IS NULL THEN 'missing' WHEN k = 0 THEN 'empty' ELSE 'present' END AS state FROM a LEFT JOIN h USING (session_id, channel)""")  # fmt: skip
def presence_states(spark, d):
    return presence(from_events(spark, d), [*CHANNELS, "gear"])


@query("channel_catalogue", f"""WITH {S}, k AS (SELECT *, t - lag(t) OVER (PARTITION BY session_id, channel ORDER BY t, i) AS dt FROM s)
    SELECT session_id, channel, count(*) AS n, count(v) AS n_valid, {r('1e6 / quantile_cont(dt, 0.5) FILTER (dt > 0)')} AS rate FROM k GROUP BY ALL""")
def channel_catalogue(spark, d):
    return channels(from_events(spark, d)).select("session_id", "channel", "n", "n_valid", rounded(F.col("rate") * 1e6).alias("rate"))


_PAIR = f"{S}, a AS (SELECT session_id, i, t FROM s WHERE channel = 'click'), b AS (SELECT session_id, i, t, v FROM s WHERE channel = 'view')"


def _clicks_views(spark, d):
    s = from_events(spark, d)
    return s.where("channel = 'click'").select("session_id", "i", "t"), s.where("channel = 'view'").select("session_id", "t", "v")


@query("hold_asof", f"""WITH {_PAIR}, x AS (SELECT session_id, max(t) AS m FROM b GROUP BY ALL)
    SELECT a.session_id, a.i, CASE WHEN a.t < x.m THEN b.v END AS held FROM a ASOF LEFT JOIN b ON a.session_id = b.session_id AND a.t >= b.t LEFT JOIN x ON a.session_id = x.session_id""")
def hold_asof(spark, d):
    a, b = _clicks_views(spark, d)
    return resample.hold(a, b, block=30 * DAY).select("session_id", "i", "held")


_AROUND = f"""{_PAIR}, p AS (SELECT a.*, b.t AS pt, b.v AS pv FROM a ASOF LEFT JOIN b ON a.session_id = b.session_id AND a.t >= b.t),
q AS (SELECT p.*, b.t AS nt, b.v AS nv FROM p ASOF LEFT JOIN b ON p.session_id = b.session_id AND p.t <= b.t)"""


@query("upsample_linear", f"WITH {_AROUND} SELECT session_id, i, {r('CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv WHEN pt = nt THEN pv ELSE pv + (nv - pv) * ((t - pt) / (nt - pt)) END', 4)} AS value FROM q")
def upsample_linear(spark, d):
    return resample.interpolate(*_clicks_views(spark, d)).select("session_id", "i", rc("value", 4))


@query("resample_nearest", f"WITH {_AROUND} SELECT session_id, i, CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv WHEN t - pt <= nt - t THEN pv ELSE nv END AS value FROM q")
def resample_nearest(spark, d):
    return resample.nearest(*_clicks_views(spark, d)).select("session_id", "i", "value")


@query("resample_mean", f"WITH {S} SELECT session_id, channel, CAST(floor(t / 21600 + 0.5) AS BIGINT) AS k, {r('avg(v)')} AS mean, count(v) AS n FROM s GROUP BY ALL")
def resample_mean(spark, d):
    return resample.bin_mean(from_events(spark, d), 21600.0).select("session_id", "channel", "k", rc("mean"), "n")


@query("master_hold", f"""WITH {S}, a AS (SELECT session_id, v, row_number() OVER (PARTITION BY session_id ORDER BY i) - 1 AS k FROM s WHERE channel = 'view'), c AS (SELECT session_id, count(*) AS n FROM a GROUP BY ALL)
    SELECT s.session_id, s.i, a.v AS held FROM s JOIN c USING (session_id) LEFT JOIN a ON a.session_id = s.session_id AND a.k = least(CAST(floor(s.i / 5) AS BIGINT), c.n - 1)""")
def master_hold(spark, d):
    s = from_events(spark, d)
    native = s.where("channel = 'view'").withColumn("i", F.row_number().over(Window.partitionBy("session_id").orderBy("i")) - 1)
    master = s.select("session_id", "i").join(native.groupBy("session_id").agg(F.count("*").alias("n")), "session_id")
    return resample.repeat_to_master(native, master, F.lit(5), F.col("n")).select("session_id", "i", F.col("v").alias("held"))


@query("outer_time_join", f"""WITH {S}, a AS (SELECT session_id, CAST(floor(t / 3600) AS BIGINT) AS tick, first(v ORDER BY i) AS a FROM s WHERE channel = 'click' GROUP BY ALL), b AS (SELECT session_id, CAST(floor(t / 3600) AS BIGINT) AS tick, first(v ORDER BY i) AS b FROM s WHERE channel = 'view' GROUP BY ALL)
    SELECT session_id, tick, a, b FROM a FULL JOIN b USING (session_id, tick)""")
def outer_time_join(spark, d):
    s = from_events(spark, d).withColumn("hour", F.floor(F.col("t") / 3600).cast("long"))
    first = lambda c: s.where(F.col("channel") == c).groupBy("session_id", "hour").agg(F.min_by("v", "i").alias("v")).withColumn("t", F.col("hour") * 1e-6)
    return resample.outer_on_time(first("click"), first("view")).select("session_id", "tick", "a", "b")


@query("histogram", """WITH s AS (SELECT event_type AS channel, value AS v FROM events), e AS (SELECT channel, min(v) AS lo, max(v) AS hi FROM s GROUP BY ALL), w AS (SELECT *, (hi - lo) / 40 AS w FROM e),
b AS (SELECT channel, least(greatest(floor((v - lo) / w), 0), 39) AS k, v, lo, hi, w FROM s JOIN w USING (channel)),
c AS (SELECT channel, CAST(CASE WHEN v < lo + k * w THEN k - 1 WHEN k < 39 AND v >= CASE WHEN k + 1 >= 40 THEN hi ELSE lo + (k + 1) * w END THEN k + 1 ELSE k END AS INTEGER) AS bin FROM b),
n AS (SELECT channel, bin, count(*) AS n FROM c GROUP BY ALL), g AS (SELECT *, CAST(unnest(range(40)) AS INTEGER) AS bin FROM w)
SELECT channel, bin, coalesce(n, 0) AS n, floor((lo + bin * w) * 1e5 + 0.5001) / 1e5 AS left_edge FROM g LEFT JOIN n USING (channel, bin)""")
def histogram(spark, d):
    s = table(spark, d, "events").select(F.col("event_type").alias("channel"), F.col("value").alias("v"))
    return aggregate.histogram(s, 40).select("channel", "bin", "n", rc("left_edge"))


@query("heatmap", """WITH b AS (SELECT least(CAST(floor((l_quantity - 0) / (60.0 / 30)) AS INTEGER), 29) AS bx, least(CAST(floor(l_extendedprice / (120000.0 / 20)) AS INTEGER), 19) AS "by", l_discount AS z FROM lineitem WHERE l_quantity BETWEEN 0 AND 60 AND l_extendedprice BETWEEN 0 AND 120000)
SELECT bx, "by", count(*) AS n, floor(avg(z) * 1e5 + 0.5001) / 1e5 AS z_mean, min(z) AS z_min, max(z) AS z_max FROM b GROUP BY ALL""")
def heatmap(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"))
    return aggregate.heatmap(li, "x", "y", "z", (30, 20), (0, 60, 0, 120000)).select("bx", "by", "n", rc("z_mean"), "z_min", "z_max")


@query("percentile_summary", f"""WITH {S} SELECT session_id, channel, min(v) AS min, max(v) AS max, {r('avg(v)')} AS mean, {r('quantile_cont(v, 0.5)')} AS median, {r('stddev_pop(v)')} AS std, {r('quantile_cont(v, 0.05)')} AS p5, {r('quantile_cont(v, 0.95)')} AS p95 FROM s GROUP BY ALL""")
def percentile_summary(spark, d):
    return aggregate.summary(from_events(spark, d), ["session_id", "channel"]).select("session_id", "channel", "min", "max", rc("mean"), rc("median"), rc("std"), rc("p5"), rc("p95"))


_BUCKETS = 16


@query("envelope", f"""WITH {L}, c AS (SELECT session_id, i, price AS v, count(*) OVER (PARTITION BY session_id) AS n FROM l), e AS (SELECT session_id, n, CAST(unnest(range({_BUCKETS})) AS BIGINT) AS k FROM (SELECT DISTINCT session_id, n FROM c)),
f AS (SELECT session_id, k, floor(k * (CAST(n AS DOUBLE) / {_BUCKETS})) AS a, CASE WHEN k = {_BUCKETS - 1} THEN n ELSE floor((k + 1) * (CAST(n AS DOUBLE) / {_BUCKETS})) END AS b FROM e),
g AS (SELECT c.session_id, CASE WHEN n > {2 * _BUCKETS} THEN k ELSE i END AS bucket, i, v FROM c LEFT JOIN f ON c.session_id = f.session_id AND c.i >= f.a AND c.i < f.b)
SELECT session_id, bucket, {r('(min(i) + max(i)) / 2.0')} AS t, {r('avg(v)', 3)} AS mean, min(v) AS min, max(v) AS max, count(v) AS n FROM g GROUP BY ALL""")
def envelope(spark, d):
    s = from_lineitem(spark, d).select("session_id", "i", F.col("i").cast("double").alias("t"), F.col("price").alias("v"))
    return aggregate.envelope(s, _BUCKETS, ("session_id",)).select("session_id", "bucket", rc("t"), rc("mean", 3), "min", "max", "n")


@query("decimate", f"WITH {L} SELECT session_id, i, price FROM (SELECT *, CAST(ceil(count(*) OVER (PARTITION BY session_id) / 100.0) AS BIGINT) AS k FROM l) WHERE i % k = 0")
def decimate(spark, d):
    return aggregate.decimate(from_lineitem(spark, d), 100, ("session_id",)).select("session_id", "i", "price")


@query("cursor_stats", f"WITH {S} SELECT session_id, channel, min(v) AS min, max(v) AS max, {r('avg(v)')} AS mean, count(v) AS n FROM s WHERE t BETWEEN 1704500000 AND 1705500000 GROUP BY ALL")
def cursor_stats(spark, d):
    return aggregate.cursor_stats(from_events(spark, d), 1705500000.0, 1704500000.0).select("session_id", "channel", "min", "max", rc("mean"), "n")


@query("line_fit", """SELECT l_suppkey AS session_id, floor(regr_slope(l_extendedprice, l_quantity) * 100 + 0.5001) / 100 AS slope, floor(regr_intercept(l_extendedprice, l_quantity) * 100 + 0.5001) / 100 AS intercept, floor(regr_r2(l_extendedprice, l_quantity) * 1e5 + 0.5001) / 1e5 AS r2,
    floor(sum(l_extendedprice * l_quantity) / sum(l_quantity * l_quantity) * 100 + 0.5001) / 100 AS origin_slope, count(*) AS n FROM lineitem GROUP BY ALL""")
def line_fit(spark, d):
    return aggregate.line_fit(from_lineitem(spark, d), "quantity", "price", ["session_id"]).select("session_id", rc("slope", 2), rc("intercept", 2), rc("r2"), rc("origin_slope", 2), "n")


A = Along(rate=RATE)
_SEG = f"{L}, g AS (SELECT *, sum(CASE WHEN quantity >= 48 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS seg, CASE WHEN discount > 0.02 THEN price END AS x FROM l)"


def _segmented(spark, d):
    return from_lineitem(spark, d).withColumn("seg", segment((F.col("quantity") >= 48).cast("double"), A))


@query("interval_stats", f"""WITH {_SEG} SELECT session_id, i, min(x) OVER w AS stat_min, max(x) OVER w AS stat_max, {r('avg(x) OVER w', 3)} AS stat_mean, {r('stddev_pop(x) OVER w', 3)} AS stat_std_dev,
    arg_min(x, i) OVER w AS stat_start, arg_max(x, i) OVER w AS stat_end FROM g WINDOW w AS (PARTITION BY session_id, seg)""")
def interval_stats(spark, d):
    s, on = _segmented(spark, d), (F.col("discount") > 0.02).cast("double")
    names = ("stat_min", "stat_max", "stat_mean", "stat_std_dev", "stat_start", "stat_end")
    got = s.select("session_id", "i", *(interval_stat(n, F.col("price"), A, "seg", on).alias(n) for n in names))
    return got.select("session_id", "i", "stat_min", "stat_max", rc("stat_mean", 3), rc("stat_std_dev", 3), "stat_start", "stat_end")


@query("integrate", f"""WITH {_SEG}, p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY session_id, seg ORDER BY i) = 1 OR NOT discount > 0.02 THEN 0.0 ELSE 0.5 * (quantity + lag(quantity) OVER (PARTITION BY session_id ORDER BY i)) * 0.1 END AS step FROM g)
    SELECT session_id, i, {r('sum(step) OVER (PARTITION BY session_id, seg ORDER BY i ROWS UNBOUNDED PRECEDING)', 3)} AS value FROM p""")
def integrate_query(spark, d):
    s = _segmented(spark, d).withColumn("step", integrate(F.col("quantity"), A, "seg", (F.col("discount") > 0.02).cast("double")))
    w = Window.partitionBy("session_id", "seg").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return s.select("session_id", "i", rounded(F.sum("step").over(w), 3).alias("value"))


@query("derivative", f"""WITH {L} SELECT session_id, i, {r('(last(price) OVER w - first(price) OVER w) / ((count(*) OVER w - 1) / 10.0)', 2)} AS value FROM l WINDOW w AS (PARTITION BY session_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def derivative_query(spark, d):
    return from_lineitem(spark, d).select("session_id", "i", rounded(derivative(F.col("price"), A, 5), 2).alias("value"))


@query("smooth", f"""WITH {L}, p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY i) AS k, count(*) OVER (PARTITION BY session_id) AS n, first(price) OVER (PARTITION BY session_id ORDER BY i) AS a, last(price) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM l)
    SELECT session_id, i, {r('(sum(price) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(0, 3 - k) * a + greatest(0, k + 2 - n) * z) / 5', 2)} AS value FROM p""")
def smooth_query(spark, d):
    return from_lineitem(spark, d).select("session_id", "i", rounded(smooth(F.col("price"), A, 5), 2).alias("value"))


@query("flip_flop", f"""WITH {L} SELECT session_id, i, CASE WHEN coalesce(max(CASE WHEN quantity > 45 THEN i END) OVER w, -1) > coalesce(max(CASE WHEN quantity < 5 THEN i END) OVER w, -1) THEN 1.0 ELSE 0.0 END AS value FROM l WINDOW w AS (PARTITION BY session_id ORDER BY i ROWS UNBOUNDED PRECEDING)""".replace("1.0 ELSE 0.0", "1::DOUBLE ELSE 0::DOUBLE"))
def flip_flop_query(spark, d):
    return from_lineitem(spark, d).select("session_id", "i", flip_flop((F.col("quantity") > 45).cast("double"), (F.col("quantity") < 5).cast("double"), A).alias("value"))


@query("time_valid", f"""WITH {L}, p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY i) AS k FROM l), f AS (SELECT *, coalesce(max(CASE WHEN NOT quantity > 10 THEN k END) OVER (PARTITION BY session_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS f FROM p)
    SELECT session_id, i, CASE WHEN (k - f - 1) * 0.1::DOUBLE >= 0.3::DOUBLE THEN 1::DOUBLE ELSE 0::DOUBLE END AS value FROM f""")
def time_valid_query(spark, d):
    return from_lineitem(spark, d).select("session_id", "i", time_valid((F.col("quantity") > 10).cast("double"), A, 0.3).alias("value"))


@query("time_shift", f"WITH {L} SELECT session_id, i, {r('lag(price, 2) OVER w * 0.5 + lag(price, 3) OVER w * 0.5', 3)} AS value FROM l WINDOW w AS (PARTITION BY session_id ORDER BY i)")
def time_shift_query(spark, d):
    return from_lineitem(spark, d).select("session_id", "i", rounded(time_shift(F.col("price"), A, 0.25), 3).alias("value"))


@query("rising_edge", f"""WITH {S}, b AS (SELECT *, t BETWEEN 1704500000 AND 1705500000 AS inside FROM s) SELECT session_id, i, CASE WHEN inside AND NOT coalesce(lag(inside) OVER (PARTITION BY session_id ORDER BY i), false) THEN 1::DOUBLE ELSE 0::DOUBLE END AS value FROM b""")
def rising_edge(spark, d):
    return from_events(spark, d).select("session_id", "i", range_change(F.col("t"), A, 1704500000.0, 1705500000.0).alias("value"))


_EDGE = f"""WITH {L}, e AS (SELECT session_id, i, quantity > 25 AS up, coalesce(lag(quantity > 25) OVER w, false) AS was, coalesce(lag(quantity > 25, 3) OVER w, false) AS late FROM l WINDOW w AS (PARTITION BY session_id ORDER BY i))
    SELECT session_id, i, CAST(late AS INT)::DOUBLE AS value,
        CAST(coalesce(max(i + 3) FILTER (up AND NOT was) OVER u, -1) > coalesce(max(i) FILTER (was AND NOT up) OVER u, -1) AS INT)::DOUBLE AS rise,
        CAST(coalesce(max(i) FILTER (up AND NOT was) OVER u, -1) > coalesce(max(i + 3) FILTER (was AND NOT up) OVER u, -1) AS INT)::DOUBLE AS fall
    FROM e WINDOW u AS (PARTITION BY session_id ORDER BY i ROWS UNBOUNDED PRECEDING)"""


@query("edge_delay", _EDGE)
def edge_delay_query(spark, d):
    up = (F.col("quantity") > 25).cast("double")
    return from_lineitem(spark, d).select("session_id", "i", edge_delay(up, A, 3).alias("value"), edge_delay(up, A, 3, 0).alias("rise"), edge_delay(up, A, 3, 1).alias("fall"))


@query("fill_gaps", f"""WITH {L}, p AS (SELECT session_id, i, CASE WHEN quantity > 20 THEN price END AS v FROM l)
    SELECT session_id, i, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY i ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM p""")
def fill_gaps_query(spark, d):
    return from_lineitem(spark, d).select("session_id", "i", fill_gaps(F.when(F.col("quantity") > 20, F.col("price")), A).alias("value"))


@query("distance_cumsum", f"WITH {L} SELECT session_id, i, {r('sum(greatest(quantity, 0) / 3.6 / 10) OVER (PARTITION BY session_id ORDER BY i ROWS UNBOUNDED PRECEDING)', 3)} AS distance FROM l")
def distance_cumsum(spark, d):
    s = from_lineitem(spark, d).withColumn("step", F.greatest(F.col("quantity"), F.lit(0.0)) / 3.6 / RATE)
    return running_sum(s, "session_id", "i", "step", "distance", block=1000).select("session_id", "i", rc("distance", 3))


@query("run_detect", f"""WITH {S}, m AS (SELECT *, t - lag(t) OVER w AS dt FROM s WHERE v > 3 WINDOW w AS (PARTITION BY session_id ORDER BY t, i)),
n AS (SELECT *, CAST(sum(CASE WHEN dt IS NULL OR dt > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY t, i ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS run FROM m)
SELECT session_id, run, min(t) AS start_t, max(t) AS end_t, count(*) AS n FROM n GROUP BY session_id, run HAVING max(t) - min(t) >= 3600""")
def run_detect(spark, d):
    return seg.runs(from_events(spark, d), F.col("v") > 3, 43200.0, 3600.0)


_DIST = f"{L}, z AS (SELECT session_id, i, i / 10::DOUBLE AS t, floor(sum(greatest(quantity, 0) / 3.6 / 10) OVER (PARTITION BY session_id ORDER BY i ROWS UNBOUNDED PRECEDING) * 1e6 + 0.5001) / 1e6 AS distance, i // 100 AS lap FROM l)"


def _driven(spark, d):
    s = seg.distance(from_lineitem(spark, d).withColumn("t", F.col("i") / F.lit(10.0)), "quantity", RATE)
    return s.withColumn("distance", rounded(F.col("distance"), 6)).withColumn("lap", F.floor(F.col("i") / 100).cast("long"))


@query("rolling_best", f"""WITH {_DIST}, u AS (SELECT session_id, distance AS top, min(t) AS t FROM z GROUP BY ALL), e AS (SELECT a.session_id, a.t, b.t AS e FROM (SELECT session_id, t, top + 100 AS target FROM u) a ASOF JOIN u b ON a.session_id = b.session_id AND a.target <= b.top)
    SELECT session_id, {r('min(e - t)')} AS best FROM e GROUP BY ALL""")
def rolling_best(spark, d):
    return seg.rolling_best(_driven(spark, d), 100.0).select("session_id", rc("best"))


_DUR = f"{_DIST}, k AS (SELECT session_id, lap AS lap_index, CAST((i % 100) // 25 AS BIGINT) AS section, i FROM z), dur AS (SELECT session_id, section, lap_index, CAST(sum(quantity) AS DOUBLE) AS duration, count(*) = 25 AS complete FROM k JOIN l USING (session_id, i) GROUP BY ALL)"


def _durations(spark, d):
    s = _driven(spark, d).withColumn("section", F.floor((F.col("i") % 100) / 25).cast("long")).withColumnRenamed("lap", "lap_index")
    return s.groupBy("session_id", "section", "lap_index").agg(F.sum("quantity").alias("duration"), (F.count("*") == 25).alias("complete"))


@query("time_report", f"""WITH {_DUR} SELECT session_id, section, {', '.join(f'max(duration) FILTER (lap_index = {k}) AS "{k}"' for k in range(4))}, min(duration) FILTER (complete) AS best, arg_min(lap_index, duration * 1000 + lap_index) FILTER (complete) AS best_lap,
    max(duration) FILTER (complete) - min(duration) FILTER (complete) AS spread FROM dur GROUP BY ALL""")
def time_report(spark, d):
    return seg.time_report(_durations(spark, d), [0, 1, 2, 3])


@query("time_report_all", f"""WITH {_DUR}, b AS (SELECT session_id, section, min(duration) FILTER (complete) AS c, min(duration) AS d, arg_min(lap_index, duration * 1000 + lap_index) FILTER (complete) AS lc, arg_min(lap_index, duration * 1000 + lap_index) AS ld,
    max(duration) FILTER (complete) AS mc, max(duration) AS md FROM dur GROUP BY ALL),
o AS (SELECT session_id, section, lap_index, duration, coalesce(c, d) AS best, coalesce(lc, ld) AS best_lap, coalesce(mc, md) - coalesce(c, d) AS spread, duration / nullif(coalesce(c, d), 0) AS q FROM dur JOIN b USING (session_id, section))
SELECT session_id, section, lap_index, duration, best, best_lap, spread, {r('q')} AS ratio, CASE WHEN q IS NULL THEN '' WHEN q <= 1.005 THEN 'best' WHEN q <= 1.03 THEN 'close' WHEN q <= 1.08 THEN 'fair' ELSE '' END AS band FROM o""")
def time_report_all(spark, d):
    """`time_report` of all laps, a row per lap."""
    return seg.time_report_rows(_durations(spark, d)).withColumn("ratio", rounded(F.col("ratio")))


@query("theoretical_best", f"WITH {_DUR}, b AS (SELECT session_id, section, min(duration) AS best FROM dur WHERE complete GROUP BY ALL) SELECT session_id, sum(best) AS theoretical, count(*) AS sections FROM b GROUP BY ALL")
def theoretical_best(spark, d):
    return seg.theoretical_best(_durations(spark, d))


@query("default_pair", f"WITH {LAPS} SELECT session_id, lap_index, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY lap_time, lap_index) AS INTEGER) AS rank FROM lt WHERE complete) WHERE rank <= 2")
def default_pair(spark, d):
    return seg.default_pair(_laps(spark, d)).select("session_id", "lap_index", "rank")


@query("reference_lap", f"WITH {LAPS} SELECT session_id, lap_index FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY complete DESC, CASE WHEN complete THEN lap_time ELSE -lap_time END, lap_index) AS k FROM lt) WHERE k = 1")
def reference_lap(spark, d):
    return seg.reference_lap(_laps(spark, d)).select("session_id", "lap_index")


@query("plausibility", f"""WITH {LAPS}, p AS (SELECT *, quantile_cont(lap_time, 0.5) OVER (PARTITION BY session_id) AS m, count(*) OVER (PARTITION BY session_id) AS k FROM lt)
    SELECT session_id, lap_index, complete AND CASE WHEN k >= 3 THEN lap_time BETWEEN 0.4 * m AND 2.5 * m ELSE true END AS complete FROM p""")
def plausibility(spark, d):
    return seg.plausible(_laps(spark, d)).select("session_id", "lap_index", "complete")


@query("cut_quality", f"WITH {LAPS} SELECT session_id, count(*) FILTER (complete) AS laps, {r('stddev_pop(lap_time) FILTER (complete) / avg(lap_time) FILTER (complete)')} AS variation FROM lt GROUP BY ALL")
def cut_quality(spark, d):
    return seg.cut_quality(_laps(spark, d)).select("session_id", "laps", rc("variation"))


_OVER = f"""{_DIST}, b AS (SELECT session_id, lap, i, distance - first(distance) OVER w AS d, t - first(t) OVER w AS x FROM z WINDOW w AS (PARTITION BY session_id, lap ORDER BY i)),
o AS (SELECT *, lag(d) OVER w AS d0, lag(x) OVER w AS x0 FROM b WINDOW w AS (PARTITION BY session_id, lap ORDER BY i)), h AS (SELECT * FROM o WHERE d0 IS NULL OR d > d0),
e AS (SELECT *, unnest(range(CASE WHEN d0 IS NULL THEN 0 ELSE CAST(floor(d0 / 5) AS BIGINT) + 1 END, CAST(floor(d / 5) AS BIGINT) + 1)) AS k FROM h),
ov AS (SELECT session_id, lap, k, CASE WHEN d0 IS NULL THEN x ELSE x0 + (x - x0) * (k * 5 - d0) / (d - d0) END AS time FROM e)"""


@query("overlay_delta", f"WITH {_OVER} SELECT a.session_id, a.k, {r('b.time - a.time', 4)} AS delta FROM ov a JOIN ov b ON a.session_id = b.session_id AND a.k = b.k AND a.lap = 0 AND b.lap = 1")
def overlay_delta(spark, d):
    s = _driven(spark, d)
    laps = s.groupBy("session_id", F.col("lap").alias("lap_index")).agg(F.min("t").alias("start_t"), (F.max("t") + 0.05).alias("end_t")).where("lap_index < 2")
    o = seg.overlay(s, laps, 5.0)
    both = o.where("lap_index = 0").select("session_id", "k", F.col("time").alias("a")).join(o.where("lap_index = 1").select("session_id", "k", F.col("time").alias("b")), ["session_id", "k"])
    return both.select("session_id", "k", rounded(F.col("b") - F.col("a"), 4).alias("delta"))


@query("overlay_delta_all", f"""WITH {_OVER.replace("ov AS (", "ov AS MATERIALIZED (")}, c AS (SELECT session_id, lap, count(*) AS n FROM z GROUP BY ALL),
ref AS MATERIALIZED (SELECT session_id, lap FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n = 100 DESC, -n, lap) AS k FROM c) WHERE k = 1),
a AS MATERIALIZED (SELECT ov.* FROM ov JOIN ref USING (session_id, lap))
    SELECT b.session_id, b.lap AS lap_index, b.k, {r('b.time - a.time', 4)} AS delta FROM ov b JOIN a ON a.session_id = b.session_id AND a.k = b.k WHERE b.lap <> a.lap""")
def overlay_delta_all(spark, d):
    """Every lap against its session's reference lap; laps of 100 samples are complete."""
    s = _driven(spark, d)
    n = F.count("*")
    laps = s.groupBy("session_id", F.col("lap").alias("lap_index")).agg(F.min("t").alias("start_t"), (F.max("t") + 0.05).alias("end_t"), (n / RATE).alias("lap_time"), (n == 100).alias("complete"))
    reference = seg.reference_lap(laps).select("session_id", F.col("lap_index").alias("reference"))
    o = seg.overlay(s, laps, 5.0).join(reference, "session_id")
    base = o.where("lap_index = reference").select("session_id", "k", F.col("time").alias("a"))
    both = o.where("lap_index <> reference").join(base, ["session_id", "k"])
    return both.select("session_id", "lap_index", "k", rounded(F.col("time") - F.col("a"), 4).alias("delta"))


@query("stitch", f"""WITH {S}, k AS (SELECT *, t - lag(t) OVER (PARTITION BY session_id ORDER BY t, i) AS dt FROM s), m AS (SELECT session_id, session_id // 10 AS stitched, min(t) AS t0, max(t) - min(t) AS span, quantile_cont(dt, 0.5) FILTER (dt > 0) AS step FROM k GROUP BY ALL),
o AS (SELECT *, coalesce(sum(span + coalesce(step, 0) + 60) OVER (PARTITION BY stitched ORDER BY session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - t0 AS off FROM m)
SELECT stitched, session_id, i, {r('t + off', 2)} AS t FROM s JOIN o USING (session_id)""")
def stitch(spark, d):
    s = from_events(spark, d)
    order = s.select("session_id").distinct().select(F.floor(F.col("session_id") / 10).cast("long").alias("stitched"), F.col("session_id").alias("place"), "session_id")
    placed = multi.stitch(s.withColumn("channel", F.col("i")), order, 60.0)
    return placed.select("stitched", "session_id", F.col("channel").alias("i"), rc("t", 2))


@query("merge_gapfill", f"""WITH {S}, a AS (SELECT session_id, i, t, CASE WHEN v > 40 THEN v END AS v FROM s WHERE channel = 'click'), b AS (SELECT * FROM s WHERE channel = 'view'), e AS (SELECT * FROM s WHERE channel = 'error'), xb AS (SELECT session_id, max(t) AS m FROM b GROUP BY ALL), xe AS (SELECT session_id, max(t) AS m FROM e GROUP BY ALL),
p AS (SELECT a.*, b.v AS bv FROM a ASOF LEFT JOIN b ON a.session_id = b.session_id AND a.t >= b.t), q AS (SELECT p.*, e.v AS ev FROM p ASOF LEFT JOIN e ON p.session_id = e.session_id AND p.t >= e.t)
SELECT q.session_id, q.i, coalesce(q.v, CASE WHEN q.t < xb.m THEN bv END, CASE WHEN q.t < xe.m THEN ev END) AS merged FROM q LEFT JOIN xb USING (session_id) LEFT JOIN xe USING (session_id)""")
def merge_gapfill(spark, d):
    s = from_events(spark, d)
    base = s.where("channel = 'click'").select("session_id", "i", "t", F.when(F.col("v") > 40, F.col("v")).alias("v"))
    other = lambda c: s.where(F.col("channel") == c).select("session_id", "t", "v")
    return multi.merge_gapfill(base, [other("view"), other("error")]).select("session_id", "i", "merged")


@query("align_lag", f"""WITH a AS (SELECT l_suppkey AS pair, CAST(date_diff('day', DATE '1992-01-01', l_shipdate) AS BIGINT) AS k, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem WHERE l_suppkey < 20 GROUP BY ALL),
g AS (SELECT a.pair, CAST(lag AS BIGINT) AS lag, count(*) AS n, floor(corr(a.v, b.v) * 1e5 + 0.5001) / 1e5 AS r FROM a, range(-3, 4) q(lag), a b WHERE b.pair = a.pair AND b.k = a.k + lag GROUP BY ALL HAVING count(*) >= 10)
SELECT pair, lag, n, r FROM g""")
def align_lag(spark, d):
    li = table(spark, d, "lineitem").where("l_suppkey < 20")
    days = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    s = li.groupBy(F.col("l_suppkey").alias("pair"), days.alias("k")).agg(F.sum("l_quantity").alias("v"))
    return multi.align(s, s, range(-3, 4), 10).select("pair", F.col("lag").cast("long").alias("lag"), "n", rc("r"))


@query("align_lag_all", """WITH a AS (SELECT l_suppkey AS pair, CAST(date_diff('day', DATE '1992-01-01', l_shipdate) AS BIGINT) AS k, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY ALL),
b AS (SELECT pair, k - lag AS k, CAST(lag AS BIGINT) AS lag, v FROM a, range(-3, 4) q(lag))
SELECT pair, lag, count(*) AS n, floor(corr(a.v, b.v) * 1e5 + 0.5001) / 1e5 AS r FROM a JOIN b USING (pair, k) GROUP BY ALL HAVING count(*) >= 10""")
def align_lag_all(spark, d):
    """`align_lag` of all suppliers."""
    days = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("pair"), days.alias("k")).agg(F.sum("l_quantity").alias("v"))
    return multi.align(s, s, range(-3, 4), 10).select("pair", F.col("lag").cast("long").alias("lag"), "n", rc("r"))


def _frames(spark, d):
    e = table(spark, d, "events")
    payload = F.unhex(F.lpad(F.hex(F.col("event_id") * 2654435761), 16, "0"))
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").cast("double").alias("t"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("frame_id"), payload.alias("payload"))


_P = "f AS (SELECT event_id AS seq, event_id * 2654435761 AS x, event_id % 3 AS frame_id FROM events)"


@query("can_bits_be", f"WITH {_P} SELECT seq, (x >> 32) & 4095 AS raw, CASE WHEN ((x >> 8) & 65535) >= 32768 THEN ((x >> 8) & 65535) - 65536 ELSE (x >> 8) & 65535 END AS signed_raw FROM f")
def can_bits_be(spark, d):
    # bytes are the long's from its highest on: bits 43 to 32 are the low half of byte 2 and byte 3, bits 23 to 8 are bytes 5 and 6
    f, p = _frames(spark, d), F.col("payload")
    return f.select("seq", can.raw_value(p, 2 * 8 + 3, 12, True).alias("raw"), can.raw_value(p, 5 * 8 + 7, 16, True, True).alias("signed_raw"))


@query("can_bits_le", f"WITH {_P} SELECT seq, ((x >> 24) & 255) | (((x >> 16) & 15) << 8) AS raw, ((((x & 255) >> 2) & 7) * 0.5 - 1)::DOUBLE AS value FROM f")
def can_bits_le(spark, d):
    # little endian from byte 4 into the low half of byte 5; three bits of byte 7
    f, p = _frames(spark, d), F.col("payload")
    return f.select("seq", can.raw_value(p, 4 * 8, 12).alias("raw"), can.physical(can.raw_value(p, 7 * 8 + 2, 3), 0.5, -1.0).alias("value"))


_MUX = [
    {"frame_id": 1, "extended": False, "message": "M", "signal": "sel", "start_bit": 56, "length": 1, "big_endian": False, "signed": False, "factor": 1.0, "offset": 0.0, "mux_role": "M", "mux_branch": None},
    {"frame_id": 1, "extended": False, "message": "M", "signal": "even", "start_bit": 48, "length": 8, "big_endian": False, "signed": False, "factor": 0.5, "offset": 0.0, "mux_role": "m", "mux_branch": 0},
    {"frame_id": 1, "extended": False, "message": "M", "signal": "odd", "start_bit": 48, "length": 8, "big_endian": False, "signed": True, "factor": 1.0, "offset": 3.0, "mux_role": "m", "mux_branch": 1},
]


@query("mux_decode", f"""WITH {_P}, g AS (SELECT seq, x & 1 AS sel, (x >> 8) & 255 AS b FROM f WHERE frame_id = 1)
    SELECT seq, 'sel' AS channel, sel::DOUBLE AS v FROM g UNION ALL SELECT seq, 'even', b * 0.5::DOUBLE FROM g WHERE sel = 0 UNION ALL SELECT seq, 'odd', (CASE WHEN b >= 128 THEN b - 256 ELSE b END + 3)::DOUBLE FROM g WHERE sel = 1""")
def mux_decode(spark, d):
    return can.decode(_frames(spark, d), _MUX).select("seq", "channel", "v")


@query("undecoded_frames", f"WITH {_P} SELECT frame_id, count(*) AS frames FROM f WHERE frame_id <> 1 GROUP BY ALL")
def undecoded_frames(spark, d):
    known = spark.createDataFrame([(1,)], "frame_id long")
    return can.undecoded(_frames(spark, d), known).select("frame_id", "frames")


_FN = {
    "sin": "sin(q)", "cos": "cos(q)", "tan": "tan(d)", "asin": "asin(d)", "acos": "acos(d)", "atan": "atan(q)", "sinh": "sinh(d)", "cosh": "cosh(d)", "tanh": "tanh(d)", "asinh": "asinh(d)", "acosh": "acosh(q)", "atanh": "atanh(d)", "ln": "ln(q)", "log": "log10(q)",
    "exp": "exp(d)", "exp10": "pow(10, d)", "sqr": "q * q", "sqrt": "sqrt(q)", "int": "trunc(p)", "round": "round_even(p, 0)", "round_down": "floor(p)", "round_up": "ceil(p)", "frac": "p - trunc(p)", "sgn": "sign(q - 25)", "abs": "abs(q - 25)",
}


@query("scalar_fns", "WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS d, l_extendedprice / 7 AS p FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST({r(e, 4)} AS DOUBLE) AS {n}_" for n, e in _FN.items())
    + ", " + ", ".join(f"CAST({r(e, 4)} AS DOUBLE) AS {n}_" for n, e in {"power": "pow(q, d)", "hypot": "sqrt(q * q + d * d)", "remainder": "(q - 25) - floor((q - 25) / 7) * 7", "min": "least(q, 25)", "max": "greatest(q, 25)", "choose": "CASE WHEN d > 0.05 THEN q ELSE p END", "bit_and": "CAST(q AS BIGINT) & 12", "bit_or": "CAST(q AS BIGINT) | 12", "bit_xor": "xor(CAST(q AS BIGINT), 12)", "bit_not": "-CAST(q AS BIGINT) - 1"}.items()) + " FROM x")
def scalar_fns(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), (F.col("l_extendedprice") / 7).alias("p"))
    q, dd, p, k = F.col("q"), F.col("d"), F.col("p"), F.lit(25.0)
    of = {n: q for n in ("sin", "cos", "atan", "acosh", "ln", "log", "sqr", "sqrt")} | {n: p for n in ("int", "round", "round_down", "round_up", "frac")} | {n: q - 25 for n in ("sgn", "abs")}
    one = [rounded(SCALAR[n](of.get(n, dd)), 4).alias(f"{n}_") for n in _FN]
    two = {"power": (q, dd), "hypot": (q, dd), "remainder": (q - 25, F.lit(7.0)), "min": (q, k), "max": (q, k), "choose": ((dd > 0.05).cast("double"), q, p), "bit_and": (q, F.lit(12.0)), "bit_or": (q, F.lit(12.0)), "bit_xor": (q, F.lit(12.0)), "bit_not": (q,)}
    return x.select("l_orderkey", "l_linenumber", *one, *(rounded(SCALAR[n](*a), 4).alias(f"{n}_") for n, a in two.items()))




@query("operators", "WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount * 100 AS d FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(
    [f"CAST(CASE WHEN {c} THEN 1 ELSE 0 END AS DOUBLE) AS {n}" for n, c in {"or_": "q > 40 OR d > 5", "and_": "q > 40 AND d > 5", "eq": "q = 25", "ne": "q <> 25", "lt": "q < 25", "le": "q <= 25", "gt": "q > 25", "ge": "q >= 25", "not_": "NOT (d <> 0)"}.items()]
    + [f"CAST({r(c, 4)} AS DOUBLE) AS {n}" for n, c in {"add": "q + d", "sub": "q - d", "mul": "q * d", "neg": "-q", "pow": "pow(q, 2)", "mod": "(q - 30) - floor((q - 30) / 7) * 7", "div": "CASE WHEN q = 25 THEN NULL ELSE d / (q - 25) END"}.items()]) + " FROM x")
def operators(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), (F.col("l_discount") * 100).alias("d"))
    q, dd, k, o = F.col("q"), F.col("d"), F.lit(25.0), OPERATORS
    flags = {"or_": o["||"](o[">"](q, F.lit(40.0)), o[">"](dd, F.lit(5.0))), "and_": o["&&"](o[">"](q, F.lit(40.0)), o[">"](dd, F.lit(5.0))), "eq": o["=="](q, k), "ne": o["!="](q, k), "lt": o["<"](q, k), "le": o["<="](q, k), "gt": o[">"](q, k), "ge": o[">="](q, k), "not_": o["!"](dd)}
    quotient = o["/"](dd, q - 25)
    numbers = {"add": o["+"](q, dd), "sub": o["-"](q, dd), "mul": o["*"](q, dd), "neg": o["neg"](q), "pow": o["^"](q, F.lit(2.0)), "mod": o["%"](q - 30, F.lit(7.0)), "div": F.when((F.abs(quotient) != float("inf")) & ~F.isnan(quotient), quotient)}
    return x.select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in flags.items()), *(rounded(c, 4).alias(n) for n, c in numbers.items()))


_TEXT = """SELECT n_name, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""


@query("sql_query", _TEXT)
def sql_query(spark, d):
    from lapwing.sources.tables import run_sql

    return run_sql(spark, _TEXT, {n: f"{d}/{n}.parquet" for n in ("orders", "customer", "nation")})


@query("welch")
def welch(spark, d):
    s = from_lineitem(spark, d).select("session_id", F.lit("price").alias("channel"), "i", F.col("price").alias("v"))
    return aggregate.welch(s, RATE, 128)


_F = scan.Biquad.lowpass(1.0, RATE)
_IIR = f"""WITH RECURSIVE {L}, m AS MATERIALIZED (SELECT session_id, i, price AS v FROM l),
f(session_id, i, v, y, s1, s2) AS (SELECT session_id, i, v, {_F.b!r}::DOUBLE * v, {2 * _F.b!r}::DOUBLE * v - {_F.a1!r}::DOUBLE * ({_F.b!r}::DOUBLE * v), {_F.b!r}::DOUBLE * v - {_F.a2!r}::DOUBLE * ({_F.b!r}::DOUBLE * v) FROM m WHERE i = 0
    UNION ALL SELECT session_id, i, v, y, {2 * _F.b!r}::DOUBLE * v - {_F.a1!r}::DOUBLE * y + s2, {_F.b!r}::DOUBLE * v - {_F.a2!r}::DOUBLE * y
    FROM (SELECT m.session_id, m.i, m.v, {_F.b!r}::DOUBLE * m.v + f.s1 AS y, f.s2 FROM f JOIN m ON m.session_id = f.session_id AND m.i = f.i + 1))
SELECT session_id, 'price' AS channel, i, i / 10::DOUBLE AS t, v, {r('y', 4)} AS filtered FROM f"""


@query("iir_lowpass", _IIR)
def iir_lowpass(spark, d):
    s = from_lineitem(spark, d).select("session_id", F.lit("price").alias("channel"), F.col("i").cast("long"), (F.col("i") / 10.0).alias("t"), F.col("price").alias("v"))
    return seg.lowpass(s, 1.0, RATE).withColumn("filtered", rounded(F.col("filtered"), 4))


def _ring(spark, d):
    """A track on a circle: the angle goes with the distance driven."""
    a = F.col("distance") / 40
    return _driven(spark, d).select("session_id", "i", "t", (100 * F.cos(a)).alias("x"), (100 * F.sin(a)).alias("y"))


@query("gate_laps")
def gate_laps(spark, d):
    return seg.debounce(seg.visits(_ring(spark, d), 100.0, 0.0, 15.0), 8.0)


_LINE = f"""WITH RECURSIVE {_DIST}, k AS (SELECT session_id, i, t, 100 * cos(distance / 40) AS x, 100 * sin(distance / 40) AS y FROM z),
g AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lag(t) OVER w AS t0 FROM k WINDOW w AS (PARTITION BY session_id ORDER BY i)),
c AS (SELECT session_id, t0 + y0 / (y0 - y) * (t - t0) AS t FROM g WHERE y0 < 0 AND y >= 0 AND (x0 + y0 / (y0 - y) * (x - x0) - 80) / 40 BETWEEN 0 AND 1),
o AS MATERIALIZED (SELECT session_id, t, row_number() OVER (PARTITION BY session_id ORDER BY t) AS n FROM c),
e(session_id, n, crossing, t, kept) AS (SELECT session_id, n, 0::BIGINT, t, true FROM o WHERE n = 1
    UNION ALL SELECT o.session_id, o.n, e.crossing + CASE WHEN o.t - e.t > 8 THEN 1 ELSE 0 END, CASE WHEN o.t - e.t > 8 THEN o.t ELSE e.t END, o.t - e.t > 8 FROM e JOIN o ON o.session_id = e.session_id AND o.n = e.n + 1)
SELECT session_id, crossing, {r('t', 4)} AS t FROM e WHERE kept"""


@query("line_laps", _LINE)
def line_laps(spark, d):
    return seg.debounce(seg.line_crossings(_ring(spark, d), 80.0, 0.0, 120.0, 0.0), 8.0).withColumn("t", rounded(F.col("t"), 4))


@query("winding_laps")
def winding_laps(spark, d):
    return seg.winding_laps(_ring(spark, d))


@query("auto_sections")
def auto_sections(spark, d):
    g = from_lineitem(spark, d).select("session_id", F.col("i").alias("d"), (F.col("quantity") * F.when((F.col("i") / 60).cast("long") % 2 == 0, 1).otherwise(4)).alias("v"))
    return seg.sections(g)


def _drive(spark, d):
    """The ring with the speed that drives it."""
    return _ring(spark, d).join(_driven(spark, d).select("session_id", "i", F.col("quantity").alias("speed"), "distance"), ["session_id", "i"])


_RINGED = "ring AS (SELECT z.session_id, z.i, z.t, 100 * cos(distance / 40) AS x, 100 * sin(distance / 40) AS y, quantity AS speed, distance FROM z JOIN l USING (session_id, i))"
_SPANS = "spans AS (SELECT session_id, lap AS lap_index, min(t) AS a, max(t) + 0.05 AS e FROM z GROUP BY ALL)"
_SECTIONS = "sec(section, kind, start_m, end_m) AS (VALUES (0, 'straight', 0.0::DOUBLE, 20.0::DOUBLE), (1, 'corner', 20.0, 35.0), (2, 'straight', 35.0, 70.0))"
_BANDS = f"""{_DIST}, {_SPANS}, {_SECTIONS}, h AS (SELECT session_id, lap AS lap_index, i, t, max(distance) OVER w - first(distance) OVER w AS way FROM z WINDOW w AS (PARTITION BY session_id, lap ORDER BY i ROWS UNBOUNDED PRECEDING)),
f AS (SELECT session_id, lap_index, way, min(t) AS t FROM h GROUP BY ALL), k AS (SELECT s.*, sec.*, end_m / 70 * (SELECT max(way) FROM h WHERE h.session_id = s.session_id AND h.lap_index = s.lap_index) AS target FROM spans s, sec),
r AS (SELECT k.session_id, k.lap_index, section, kind, a, CASE WHEN section = 2 THEN e ELSE f.t END AS until FROM k ASOF JOIN f ON k.session_id = f.session_id AND k.lap_index = f.lap_index AND k.target <= f.way),
bands AS (SELECT session_id, lap_index, CAST(section AS BIGINT) AS section, kind, coalesce(lag(until) OVER (PARTITION BY session_id, lap_index ORDER BY section), a) AS start_t, until AS end_t FROM r)"""


def _spans(spark, d):
    return _driven(spark, d).groupBy("session_id", F.col("lap").alias("lap_index")).agg(F.min("t").alias("start_t"), (F.max("t") + 0.05).alias("end_t"))


def _bands(spark, d):
    s = _driven(spark, d)
    parts = spark.createDataFrame([(0, "straight", 0.0, 20.0), (1, "corner", 20.0, 35.0), (2, "straight", 35.0, 70.0)], "section long, kind string, start_m double, end_m double")
    return laps_.section_bands(s, _spans(spark, d), s.select("session_id").distinct().join(F.broadcast(parts)))  # three rows


@query("gate_candidates", f"""WITH {_DIST}, {_RINGED}, b AS (SELECT *, floor(x / 10) AS bx, floor(y / 10) AS by_ FROM ring WHERE speed > 8), e AS (SELECT *, CASE WHEN lag(bx) OVER w = bx AND lag(by_) OVER w = by_ THEN 0 ELSE 1 END AS enters FROM b WINDOW w AS (PARTITION BY session_id ORDER BY i)),
    g AS (SELECT session_id, bx, by_, min(i) AS first_i, avg(x) AS px, avg(y) AS py, sum(enters) AS entries, sum(count(*)) OVER (PARTITION BY session_id) AS n FROM e GROUP BY session_id, bx, by_)
    SELECT session_id, first_i, {r('px', 3)} AS px, {r('py', 3)} AS py, CAST(entries AS BIGINT) AS entries FROM g WHERE n >= 10""")
def gate_candidates(spark, d):
    return laps_.gate_candidates(_drive(spark, d)).select("session_id", "first_i", rc("px", 3), rc("py", 3), "entries")


@query("detect_laps")
def detect_laps(spark, d):
    track = _drive(spark, d)
    return laps_.detect_laps(track, seg.runs(track, F.col("speed") > 3), RATE).select("session_id", "method", "lap_index", "start_t", "end_t", "complete", "turn")


@query("section_bands", f"WITH {_BANDS} SELECT session_id, lap_index, section, kind, {r('start_t')} AS start_t, {r('end_t')} AS end_t, {r('greatest(0, end_t - start_t)')} AS duration FROM bands")
def section_bands(spark, d):
    return _bands(spark, d).select("session_id", "lap_index", "section", "kind", rc("start_t"), rc("end_t"), rc("duration"))


@query("section_report", f"""WITH {_BANDS}, m AS (SELECT b.session_id, lap_index, section, kind, quantity AS v, i FROM z JOIN l USING (session_id, i) JOIN bands b ON b.session_id = z.session_id AND t >= start_t AND t < end_t)
    SELECT session_id, lap_index, section, kind, min(v) AS min, max(v) AS max, {r('avg(v)')} AS mean, arg_min(v, i) AS start, arg_max(v, i) AS "end", count(*) AS n FROM m GROUP BY ALL""")
def section_report(spark, d):
    s = laps_.band_samples(_driven(spark, d).select("session_id", "i", "t", F.col("quantity").alias("v")), _bands(spark, d))
    return aggregate.stats(s, ["session_id", "lap_index", "section", "kind"]).select("session_id", "lap_index", "section", "kind", "min", "max", rc("mean"), "start", "end", "n")


@query("place_notes", f"""WITH {_DIST}, {_RINGED}, n AS (SELECT o_orderkey % 100 AS session_id, (o_orderkey % 7919) / 16::DOUBLE AS t, o_orderkey AS note FROM orders),
    p AS (SELECT n.*, a.t AS t0, a.distance AS d0, a.x AS x0, a.y AS y0 FROM n ASOF LEFT JOIN ring a ON n.session_id = a.session_id AND n.t >= a.t),
    q AS (SELECT p.*, b.t AS t1, b.distance AS d1, b.x AS x1, b.y AS y1 FROM p ASOF LEFT JOIN ring b ON p.session_id = b.session_id AND p.t <= b.t), k AS (SELECT *, t0 IS NOT NULL AND t1 IS NOT NULL AS ok FROM q)
    SELECT session_id, t, note, {r('CASE WHEN ok THEN CASE WHEN t1 = t0 THEN d0 ELSE d0 + (d1 - d0) * ((t - t0) / (t1 - t0)) END END', 4)} AS distance, {r('CASE WHEN ok THEN CASE WHEN t - t0 <= t1 - t THEN x0 ELSE x1 END END', 3)} AS x, {r('CASE WHEN ok THEN CASE WHEN t - t0 <= t1 - t THEN y0 ELSE y1 END END', 3)} AS y FROM k""")
def place_notes(spark, d):
    """Notes on the track, one per order; times are sixteenths, so that none is halfway between two samples by rounding only."""
    notes = table(spark, d, "orders").select((F.col("o_orderkey") % 100).alias("session_id"), ((F.col("o_orderkey") % 7919) / 16.0).alias("t"), F.col("o_orderkey").alias("note"))
    track = _drive(spark, d)
    return laps_.place_notes(notes, track, track).select("session_id", "t", "note", rc("distance", 4), rc("x", 3), rc("y", 3))


@query("distance_window", f"""WITH {_DIST}, b AS (SELECT session_id, min(i) FILTER (distance >= 50) AS a, max(i) FILTER (distance <= 120) AS e, max(i) AS last FROM z GROUP BY session_id), k AS (SELECT session_id, coalesce(a, last) AS a, greatest(coalesce(e, -1), coalesce(a, last)) AS e FROM b)
    SELECT k.session_id, p.t AS start_t, q.t AS end_t FROM k JOIN z p ON p.session_id = k.session_id AND p.i = a JOIN z q ON q.session_id = k.session_id AND q.i = e""")
def distance_window(spark, d):
    return laps_.distance_window(_driven(spark, d), 50.0, 120.0)


for _name, (_f, _sql) in extra.QUERIES.items():
    query(_name, _sql)(_f)
QUERIES, ORACLES = Q, SQL
