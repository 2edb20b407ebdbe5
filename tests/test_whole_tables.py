"""Queries over whole tables, against brute force."""

from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from lapwing.plans import catalogue

D = "/root/testdata/sf0.001"


def read(sql):
    return duckdb.connect().execute(sql).fetchall()


def test_sections_reach_the_end_of_every_session(spark, tmp_path):
    lines = spark.range(900).select(F.lit(1).alias("l_suppkey"), F.expr("date_add(DATE '1992-01-01', CAST(id AS INT))").alias("l_shipdate"), F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 50 + 1).cast("double").alias("l_quantity"), F.lit(1.0).alias("l_extendedprice"), F.lit(0.0).alias("l_discount"), F.lit(0.0).alias("l_tax"), F.lit("N").alias("l_returnflag"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    assert catalogue.QUERIES["auto_sections"](spark, str(tmp_path)).agg(F.max("end_m")).first()[0] == 900


def test_all_orders_meet(spark):
    days = defaultdict(list)
    for key, day in read(f"SELECT o_orderkey, CAST(o_orderdate AS DATE) FROM '{D}/orders.parquet'"):
        days[day].append(key)
    want = {(a, b) for keys in days.values() for a in keys for b in keys if a < b}
    got = catalogue.QUERIES["pair_candidates_all"](spark, D).collect()
    assert len(got) == len(want) and {(r["a_id"], r["b_id"]) for r in got} == want


def test_all_sessions_names_and_laps_are_computed(spark):
    q = catalogue.QUERIES
    suppliers = {r[0] for r in read(f"SELECT DISTINCT l_suppkey FROM '{D}/lineitem.parquet'")}
    assert {r[0] for r in q["align_lag_all"](spark, D).select("pair").distinct().collect()} == suppliers
    names = {r[0].upper().replace(" ", "_") for r in read(f"SELECT p_name FROM '{D}/part.parquet'")}
    assert {r[0] for r in q["name_lookup_all"](spark, D).select("asked").distinct().collect()} == names
    laps = {(s, k) for s, n in read(f"SELECT l_suppkey, count(*) FROM '{D}/lineitem.parquet' GROUP BY ALL") for k in range(1, (n + 99) // 100)}
    assert {tuple(r) for r in q["overlay_delta_all"](spark, D).select("session_id", "lap_index").distinct().collect()} == laps
    users = {r[0] for r in read(f"SELECT DISTINCT user_id FROM '{D}/events.parquet' WHERE event_type IN ('click', 'view', 'error')")}
    assert {r[0] for r in q["alias_landing_all"](spark, D).select("session_id").distinct().collect()} == users
