"""Parquet sessions and SQL over them; exports."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.functions.missing import finite


def view_name(path: str) -> str:
    """Of a file: its stem in lower case, runs of other characters as one underscore, none at the ends."""
    stem = re.sub(r"\.parquet$", "", path.rstrip("/").rsplit("/", 1)[-1])
    return re.sub(r"[^0-9a-z_]+", "_", stem.lower()).strip("_") or "channel"


def run_sql(spark: SparkSession, sql: str, paths: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Spark SQL over Parquet files as views; the first is also `log`."""
    named = dict(paths) if isinstance(paths, Mapping) else {view_name(p): p for p in paths}
    for k, (name, path) in enumerate(named.items()):
        df = spark.read.parquet(path)
        df.createOrReplaceTempView(name)
        if k == 0:
            df.createOrReplaceTempView("log")
    return spark.sql(sql)


def read_series(spark: SparkSession, path: str, names: Sequence[str], start: float | None = None, end: float | None = None) -> DataFrame:
    """time and some channels of a wide session, ends included; columns and range reach the scan."""
    df = spark.read.parquet(path).select("time", *names)
    if start is not None:
        df = df.where(F.col("time") >= start)
    return df.where(F.col("time") <= end) if end is not None else df


def write_session(wide: DataFrame, path: str) -> None:
    """One directory per session, zstd."""
    wide.write.partitionBy("session_id").option("compression", "zstd").mode("errorifexists").parquet(path)


def long_layout(wide: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per finite cell: keys, channel, value."""
    return wide.unpivot(list(keys), list(names), "channel", "value").where(finite(F.col("value")))


def wide_layout(samples: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """A column per channel; the names are given, so no extra job asks for them."""
    return samples.groupBy(*keys).pivot("channel", list(names)).agg(F.first("v", True))


def write_csv(df: DataFrame, path: str, digits: int = 10) -> None:
    """CSV with `digits` significant digits, missing values blank."""
    shown = [F.when(finite(F.col(c)), F.format_string(f"%.{digits}g", F.col(c))).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    df.select(*shown).write.option("header", True).csv(path)


def write_merged(wide: DataFrame, path: str, units: Mapping[str, str] | None = None, index: str = "time") -> None:
    """A merged session as CSV parts: `time_s` first, in the order of time, each part with the names and a row of units.

    Parts are ranges of time, so no task sorts all rows; `read_text` reads one back.
    """
    names = [c for c in wide.columns if c != index]
    shown = [F.when(finite(F.col(c).cast("double")), F.format_string("%.10g", F.col(c).cast("double"))) for c in names]
    number = F.format_string("%.10g", F.col(index).cast("double"))
    ordered = wide.repartitionByRange(F.col(index)).sortWithinPartitions(index)
    line = lambda cells: ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"') else c for c in cells)
    head = line(["time_s", *names]) + "\r\n" + line(["", *((units or {}).get(c, "") for c in names)])
    text = ordered.select(F.concat_ws(",", number, *(F.coalesce(c, F.lit("")) for c in shown)).alias("value"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("n"))
    text.select(F.when(F.col("n") == 0, F.concat(F.lit(head + "\r\n"), "value")).otherwise(F.col("value"))).write.option("lineSep", "\r\n").text(path)


def estimate_csv_bytes(df: DataFrame, rows: int = 200) -> DataFrame:
    """(rows, bytes): an exact row count, and bytes from the text of the first rows."""
    text = F.concat_ws(",", *(F.col(c).cast("string") for c in df.columns))
    head = df.limit(rows).agg((F.avg(F.octet_length(text) + 1)).alias("per_row"))
    return df.agg(F.count("*").alias("rows")).crossJoin(head).select("rows", (F.col("rows") * F.coalesce("per_row", F.lit(0.0))).cast("long").alias("bytes"))
