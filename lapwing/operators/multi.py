"""Several sessions together: stitching, merging sources, aligning clocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.missing import finite
from lapwing.operators.resample import hold


def stitch(samples: DataFrame, order: DataFrame, gap: float = 0.0) -> DataFrame:
    """Sessions end to end: each begins a median step and `gap` after the end of the one before.

    `order` has (stitched, place, session_id). Result: (stitched, place, session_id, channel, t, v).
    """
    w = Window.partitionBy("session_id").orderBy("t", "i")
    steps = samples.withColumn("dt", F.col("t") - F.lag("t").over(w))
    spans = steps.groupBy("session_id").agg(F.min("t").alias("t0"), (F.max("t") - F.min("t")).alias("span"), F.percentile(F.when(F.col("dt") > 0, F.col("dt")), 0.5).alias("step"))
    placed = order.join(spans, "session_id")
    before = Window.partitionBy("stitched").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum(F.col("span") + F.coalesce("step", F.lit(0.0)) + gap).over(before), F.lit(0.0)) - F.col("t0"))
    return samples.join(placed.select("stitched", "place", "session_id", "offset"), "session_id").select("stitched", "place", "session_id", "channel", (F.col("t") + F.col("offset")).alias("t"), "v")


def is_placeholder(samples: DataFrame, small: float = 0.01) -> DataFrame:
    """(session_id, channel, placeholder): nothing but missing values and magnitudes under `small`."""
    return samples.groupBy("session_id", "channel").agg((~F.bool_or(finite(F.col("v")) & (F.abs("v") >= small))).alias("placeholder"))


def merge_gapfill(base: DataFrame, sources: Sequence[DataFrame]) -> DataFrame:
    """Base times with the base value, else what the sources, in order, hold there (`merged`)."""
    out = base.withColumn("merged", F.when(finite(F.col("v")), F.col("v")))
    for s in sources:
        out = hold(out, s).withColumn("merged", F.coalesce("merged", "held")).drop("held")
    return out


def align(reference: DataFrame, other: DataFrame, lags: Sequence[int], least: int = 60) -> DataFrame:
    """(pair, lag, n, r): correlation of two series (pair, k, v) on whole seconds, at each lag.

    The lags are few and go to the reference rows; the join is on the pair and the second.
    """
    r = reference.select("pair", "k", F.col("v").alias("a"), F.explode(F.array(*map(F.lit, lags))).alias("lag")).withColumn("at", F.col("k") + F.col("lag"))
    both = r.join(other.select("pair", F.col("k").alias("at"), F.col("v").alias("b")), ["pair", "at"])
    return both.groupBy("pair", "lag").agg(F.count("*").alias("n"), F.corr("a", "b").alias("r")).where(F.col("n") >= least)


def best_lag(correlations: DataFrame) -> DataFrame:
    """Of each pair the lag of the highest correlation, of equal ones the most samples, then the smallest."""
    return correlations.groupBy("pair").agg(F.max_by(F.struct("lag", "r", "n"), F.struct("r", "n", -F.abs("lag"))).alias("b")).select("pair", "b.*")


#: Recordings of a block: nine blocks fill one of Parquet's runs of packed values, so that the same block packs to the same bytes each time.
#: Larger ones take a little less space and more time, as all pairs of two blocks are held at once.
BLOCK = 56


def candidates(a: DataFrame, b: DataFrame, slack: float = 900.0, least: float = 20.0, cell: float = 3600.0, once: bool = False, tasks: int = 0) -> DataFrame:
    """Pairs of recordings (id, start_s, end_s) whose times overlap within the slack.

    Recordings go to the cells of time that they touch, so the join is on cells, not on a range; a pair
    is taken in the first cell that both touch. With `once`, both sides are one set of recordings and
    each pair comes once, a_id < b_id. Sides are merged cell by cell, in as many tasks as there are shuffle
    partitions (or `tasks`, if more) however small they are: what comes out may be a thousand times what goes in. A cell's
    recordings are blocks in the order of their ids, and each recording of a block meets a whole block of the other side: pairs
    come with one side constant and the other side repeating, which files hold in far fewer bytes than pairs in any order.
    """
    n = max(tasks, int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = lambda s: F.floor((F.col("start_s") - s) / cell)
    cells = lambda df, s: df.select("id", "start_s", "end_s", first(s).alias("first"), F.explode(F.sequence(first(s), F.floor((F.col("end_s") + s) / cell))).alias("cell"))
    both = _blocks(cells(a, slack).repartition(n, "cell"), "a").hint("merge").join(_blocks(cells(b, 0.0).repartition(n, "cell"), "b"), "cell")
    if once:
        both = both.where(F.col("a")[0]["id"] < F.element_at("b", -1)["id"])
    both = both.select("cell", "b", F.explode("a").alias("a")).select("cell", "a", F.explode("b").alias("b")).where(F.col("cell") == F.greatest("a.first", "b.first"))
    if once:
        both = both.where("a.id < b.id")
    both = both.select(*(F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "ab" for c in ("id", "start_s", "end_s")))
    overlap = F.least("a_end_s", "b_end_s") - F.greatest("a_start_s", "b_start_s")
    return both.withColumn("overlap", overlap).where(F.col("overlap") + slack >= least)


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """(cell, `name`): the recordings of each cell in arrays of up to BLOCK, in the order of ids; what is dealt by cell stays."""
    place = F.row_number().over(Window.partitionBy("cell").orderBy("id"))
    blocks = rows.withColumn("block", F.floor((place - 1) / BLOCK)).groupBy("cell", "block")
    return blocks.agg(F.sort_array(F.collect_list(F.struct("id", "start_s", "end_s", "first"))).alias(name)).drop("block")


def group_recordings(parts: DataFrame, gap: float = 1.0, drift: float = 0.05) -> DataFrame:
    """Parts (part, day, start_s, end_s, start_rel, end_rel) with the recording they belong to.

    A part goes on where the last one of its day ended: 0 to `gap` seconds later by the wall clock,
    and as much by the relative one within `drift`.
    """
    w = Window.partitionBy("day").orderBy("start_s", "part")
    wall, rel = F.col("start_s") - F.lag("end_s").over(w), F.col("start_rel") - F.lag("end_rel").over(w)
    p = parts.withColumn("new", ~F.coalesce((wall >= 0) & (wall <= gap) & (F.abs(rel - wall) <= drift), F.lit(False)))
    return p.withColumn("recording", F.sum(F.col("new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
