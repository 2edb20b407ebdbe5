"""Sessions, channels and sample frames, and how the test tables map onto them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapwing.functions.missing import finite

SAMPLES = "session_id, channel, i, t, v"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts) / 1e6


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as samples: a user is a session, an event type a channel; i counts a session's samples in order."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("channel"), seconds(F.col("ts")).alias("t"), F.col("value").alias("v"), "event_id")
    return ordered(e, "session_id", ["t", "event_id"]).select("session_id", "channel", "i", "t", "v")


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as wide sessions: a supplier is a session, its lines by date are the samples."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("session_id"), "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag")
    )
    w = Window.partitionBy("session_id").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return li.withColumn("i", (F.row_number().over(w) - 1).cast("long")).drop("l_shipdate", "l_orderkey", "l_linenumber")


def ordered(df: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Adds i, the place of a row in its session from 0."""
    return df.withColumn("i", (F.row_number().over(Window.partitionBy(session).orderBy(*order)) - 1).cast("long"))


def running_sum(df: DataFrame, session: str, order: str, value: str, out: str, block: int = 100_000) -> DataFrame:
    """Cumulative sum along a session in two levels, so that one huge session isn't one task.

    `order` is an integer place. Each block of places sums on its own; the blocks' totals, few rows
    per session, are summed once more and added.
    """
    blocked = df.withColumn("__block", F.floor(F.col(order) / block))
    local = blocked.withColumn("__sum", F.sum(value).over(Window.partitionBy(session, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    totals = blocked.groupBy(session, "__block").agg(F.sum(value).alias("__total"))
    totals = totals.withColumn("__before", F.sum("__total").over(Window.partitionBy(session).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))).drop("__total")
    return local.join(totals, [session, "__block"]).withColumn(out, F.coalesce("__sum", F.lit(0.0)) + F.coalesce("__before", F.lit(0.0))).drop("__block", "__sum", "__before")


def channels(samples: DataFrame) -> DataFrame:
    """Catalogue of channels: samples, valid samples, first and last time, median rate, presence."""
    step = F.col("t") - F.lag("t").over(Window.partitionBy("session_id", "channel").orderBy("t", "i"))
    valid = finite(F.col("v"))
    g = samples.withColumn("dt", step).groupBy("session_id", "channel").agg(
        F.count("*").alias("n"), F.sum(valid.cast("long")).alias("n_valid"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.percentile(F.when(F.col("dt") > 0, F.col("dt")), 0.5).alias("step")
    )
    return g.select("session_id", "channel", "n", "n_valid", "t0", "t1", (1 / F.col("step")).alias("rate"), F.when(F.col("n_valid") > 0, "present").otherwise("empty").alias("state"))


def presence(samples: DataFrame, wanted: list[str]) -> DataFrame:
    """For each session and wanted channel: present, empty (no finite sample) or missing."""
    have = samples.groupBy("session_id", "channel").agg(F.sum(finite(F.col("v")).cast("long")).alias("n_valid"))
    asked = samples.select("session_id").distinct().select("session_id", F.explode(F.array(*map(F.lit, wanted))).alias("channel"))
    return asked.join(have, ["session_id", "channel"], "left").select("session_id", "channel", F.when(F.col("n_valid").isNull(), "missing").when(F.col("n_valid") == 0, "empty").otherwise("present").alias("state"))


def name_key(name: Column) -> Column:
    """Channel names that differ in case and in anything but letters and digits are one."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def merge_key(name: Column) -> Column:
    """The weaker key of merging: without spaces and underscores, lower-cased."""
    return F.lower(F.regexp_replace(name, "[ _]", ""))


def lookup(catalogue: DataFrame, asked: DataFrame, unique: bool = False) -> DataFrame:
    """(session_id, asked, channel): the channel that an asked name means, the first by name; with `unique`, only where it is one."""
    a = asked.select("asked").withColumn("key", name_key(F.col("asked")))
    found = catalogue.select("session_id", "channel", name_key(F.col("channel")).alias("key")).join(a, "key").groupBy("session_id", "asked").agg(F.min("channel").alias("channel"), F.count_distinct("channel").alias("n"))
    return (found.where("n = 1") if unique else found).drop("n")


def land_aliases(catalogue: DataFrame, candidates: DataFrame) -> DataFrame:
    """(session_id, alias, channel): of an alias's candidates (alias, position, name) the first that a session has."""
    c = candidates.select("alias", "position", name_key(F.col("name")).alias("key"))
    return catalogue.select("session_id", "channel", name_key(F.col("channel")).alias("key")).join(c, "key").groupBy("session_id", "alias").agg(F.min_by("channel", F.struct("position", "channel")).alias("channel"))


def settled(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet below `spark.checkpoint.dir` and read again: what several plans read is computed once, and a lost executor costs a reread.

    Without that setting a folder of this machine serves, which only a local master may use. Files stay until the folder is cleared.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = tempfile.mkdtemp(prefix="lapwing-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tuned(spark: SparkSession) -> SparkSession:
    """The session, told to leave out whole-stage code that the JVM wouldn't compile (methods over 8,000 bytes): many derived channels at once run several times as fast."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark
