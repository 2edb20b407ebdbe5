"""A training corpus from `documents`: toxic rows out, exact and near copies out, benchmark leaks out, encoded.

Each stage is written and read again before the next. Decisions are by row: what dedup reads gets a
key for each row and decontamination judges texts, so ids may repeat or be null; doc_id only orders
the rows of a group.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm import bpe, decontaminate, exact_dedup, near_dedup, toxicity
from lapwing.llm.common import stored, table

#: Rows' keys that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000
ROW, FILE = "__row", "__file"


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with a key of its own for each row: its place in the stored table, or, of other tables, a number stored with a copy."""
    try:
        placed = docs.withColumns({FILE: F.col("_metadata.file_path"), ROW: F.col("_metadata.row_index")})
    except AnalysisException:  # no plain read of files
        return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    files = sorted(r[0] for r in placed.select(FILE).distinct().collect())  # one of each file of the table
    numbers = docs.sparkSession.createDataFrame([(f, k << 40) for k, f in enumerate(files)], f"{FILE} string, __first long")
    return placed.join(F.broadcast(numbers), FILE).withColumn(ROW, F.col("__first") + F.col(ROW)).drop(FILE, "__first")


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Numbered `docs` without these rows and without the key."""
    gone = stored(rows.select(ROW).distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, ROW, "left_anti").select([c for c in docs.columns if c != ROW])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a lexicon and weights learned from `labels`."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, lexicon)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, one row of those that repeat it."""
    docs = numbered(docs)
    return without(docs, exact_dedup.exact_dedup(docs, row_col=ROW).where(~F.col("kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that five-word shingles link at a similarity of 0.8 or more, the one with the smallest doc_id (null ids last)."""
    docs = numbered(docs)
    found = stored(near_dedup.near_dedup(docs, width=5, threshold="4/5", id_col=ROW).select(ROW, "component_id"), "components")
    shared = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    groups = stored(found.join(shared, "component_id").join(docs.select(ROW, "doc_id"), ROW), "groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW)).alias("first"))
    return without(docs, groups.join(first, "component_id").where(F.col(ROW) != F.col(f"first.{ROW}")))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded_sha256) of what is left."""
    return bpe.encode(docs, decoded=True).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("near-dedup", drop_near_copies), ("decontamination", drop_leaks), ("BPE encoding", encode)]
#: Toxicity, near copies, leaks and BPE have no SQL; brute-force versions in tests/llm stand for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{k}")
    return docs
