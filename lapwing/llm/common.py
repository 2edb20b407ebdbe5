"""What the operators share: the shared folder, stored intermediate tables, text helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` of the session.

    Only on one machine (a local master, as in tests) a temporary folder stands in where it is unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(_OWN[app])
        folder = _OWN[app]
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as a table in the shared folder and reads it again.

    Cuts the lineage: lost executors cost a reread, not a recomputation.
    """
    return _written(df, f"{shared_folder(df.sparkSession)}/lapwing/{name}-{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables that are deleted together, once what was made of them is stored elsewhere."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.tables = spark, f"{shared_folder(spark)}/lapwing/scratch-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.tables += 1
        return _written(df, f"{self.folder}/{self.tables}-{name}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_by_hash(df: DataFrame, key: Column, size: int) -> DataFrame:
    """At most `size` rows, those of the smallest hashes of `key`, the same on every run.

    Rows beyond twice the share wanted go before the sort, so no task sends more than its part of it.
    Where rows share hashes and too few lie in that share, it is doubled until there are enough.
    """
    n = df.count()
    hashed = df.withColumn("__hash", F.xxhash64(key))
    share = 2 * size / n if n > 2 * size else 1.0
    while share < 1:
        part = hashed.where(F.col("__hash") < F.lit(-(2**63) + int(2**64 * share)))
        if part.count() >= size:
            return part.orderBy("__hash").limit(size).drop("__hash")
        share *= 2
    return hashed.orderBy("__hash").limit(size).drop("__hash")
