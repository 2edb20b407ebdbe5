"""The bounded sample where copies dominate."""

from pyspark.sql import functions as F

from lapwing.llm import common


def test_a_table_of_copies_still_fills_the_sample(spark):
    for text in range(8):  # of one text, whatever its hash
        df = spark.range(1000).select("id", F.lit(text).alias("x"))
        assert common.sample_by_hash(df, F.col("x"), 100).count() == 100
        assert common.sample_by_hash(df, F.struct("id", "x"), 100).count() == 100
