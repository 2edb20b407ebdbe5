"""Pairs grow with the square of a cell, so they are made in more tasks than a small table's one file, cell by cell."""

from pyspark.sql import functions as F

from lapwing.operators import multi


def test_pairs_of_one_file_are_made_in_several_tasks(spark, tmp_path):
    spark.range(600).select("id", ((F.col("id") * 7 % 30) * 86400.0).alias("start_s"), ((F.col("id") * 7 % 30) * 86400.0 + 3600).alias("end_s")).coalesce(1).write.parquet(str(tmp_path / "a"))
    a = spark.read.parquet(str(tmp_path / "a"))
    got = multi.candidates(a, a, cell=86400.0, once=True).withColumns({"task": F.spark_partition_id(), "n": F.monotonically_increasing_id()}).collect()
    assert {(r["a_id"], r["b_id"]) for r in got} == {(x, y) for x in range(600) for y in range(x + 30, 600, 30)} and len(got) == 30 * 190
    assert len({r["task"] for r in got}) > 1
    days = [(r["task"], r["a_start_s"]) for r in sorted(got, key=lambda r: r["n"])]
    assert sum(x != y for x, y in zip(days, days[1:])) == 29  # a day's pairs stay together
