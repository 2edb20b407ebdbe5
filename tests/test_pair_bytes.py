"""Pairs are stored in few bytes: blocks of one side repeat for each recording of the other."""

from pyspark.sql import functions as F

from lapwing.operators import multi


def test_pairs_of_a_large_cell_take_few_bytes(spark, tmp_path):
    spark.range(2500).select((F.col("id") * 7919 % 100_003).alias("id"), F.lit(0.0).alias("start_s"), F.lit(3600.0).alias("end_s")).write.parquet(str(tmp_path / "a"))
    a = spark.read.parquet(str(tmp_path / "a"))
    multi.candidates(a, a, cell=86400.0, once=True).select("a_id", "b_id", "overlap").write.parquet(str(tmp_path / "pairs"))
    got = spark.read.parquet(str(tmp_path / "pairs"))
    assert got.count() == got.distinct().count() == 2500 * 2499 // 2 and got.where("a_id >= b_id OR overlap <> 3600").isEmpty()
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.4 * got.count()


def test_sides_differ(spark):
    kind = "id long, start_s double, end_s double"
    a = [(k, 500.0 * k, 500.0 * k + 1200) for k in range(400)]
    b = [(1000 + k, 733.0 * k, 733.0 * k + 2500) for k in range(300)]
    want = {(x[0], y[0]) for x in a for y in b if min(x[2], y[2]) - max(x[1], y[1]) + 900 >= 20}
    got = multi.candidates(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)).collect()
    assert len(got) == len(want) and {(r["a_id"], r["b_id"]) for r in got} == want
