"""The communication matrix: exact sums, the law of its draws; shards of exact sizes; nulls, ties, few rows, no rows, clashing columns."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwing.llm import sharding
from lapwing.llm.common import Scratch


@pytest.mark.parametrize(("total", "good", "draws"), [(20, 7, 9), (12, 12, 5), (30, 1, 30), (50, 30, 40), (9, 4, 0)])
def test_draws_follow_the_law(spark, total, good, draws):
    n = 20_000
    got = spark.range(n).select(F.expr(sharding.hypergeometric(f"{good}L", f"{total}L", f"{draws}L", sharding.uniform("id", "3L"))).alias("h")).groupBy("h").count().collect()
    chance = {h: math.comb(good, h) * math.comb(total - good, draws - h) / math.comb(total, draws) for h in range(max(0, draws + good - total), min(good, draws) + 1)}
    seen = {r["h"]: r["count"] for r in got}
    assert set(seen) <= set(chance)
    common = {h: p for h, p in chance.items() if n * p >= 5}
    chi = sum((seen.get(h, 0) - n * p) ** 2 / (n * p) for h, p in common.items())
    assert chi < len(common) + 5 * math.sqrt(2 * len(common)) + 5


def test_large_draws_have_the_right_moments(spark):
    total, good, draws = 10**9, 10**9 // 24, 10**7
    got = [r["h"] for r in spark.range(400).select(F.expr(sharding.hypergeometric(f"{good}L", f"{total}L", f"{draws}L", sharding.uniform("id", "5L"))).alias("h")).collect()]
    mean, sd = draws * good / total, math.sqrt(draws * (good / total) * (1 - good / total) * (total - draws) / (total - 1))
    assert abs(np.mean(got) - mean) < 5 * sd / 20 and 0.85 < np.std(got) / sd < 1.15


@pytest.mark.parametrize("blocks", [1, 5, 40])
def test_matrix_sums(spark, blocks):
    sizes = [(3 * b, (b * 37) % 101) for b in range(blocks)]  # numbers with gaps, a block without rows
    with Scratch(spark) as keep:
        got = {r["block"]: r["counts"] for r in sharding.communication_matrix(spark.createDataFrame(sizes, "block long, size long"), 7, 1, keep).collect()}
    assert {b: sum(c) for b, c in got.items()} == dict(sizes)
    n = sum(s for _, s in sizes)
    assert [sum(c[k] for c in got.values()) for k in range(7)] == [n // 7 + (k < n % 7) for k in range(7)]
    assert all(x >= 0 for c in got.values() for x in c)


def _held(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    n = len(rows)
    assert {k: len(v) for k, v in by.items()} == {k: n // shards + (k < n % shards) for k in range(shards) if n // shards + (k < n % shards)}
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("n", [0, 1, 5, 24, 1000])
def test_shards_are_exact(spark, n):
    docs = spark.createDataFrame([(k if k % 9 else None, None if k % 4 == 0 else "same text" if k % 3 else f"Ü{k}" * (20_000 if k == 7 else 1), "x", 5) for k in range(n)], "doc_id long, text string, shard string, slot int")
    got = sharding.shuffle_into_shards(docs.repartition(5), 24, 3)
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "shard", "slot"] and len(rows) == n
    _held(rows, 24)
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in docs.collect())


def test_report(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "é"), (3, "é")], "doc_id long, text string")
    rows = sharding.shard_report(docs, 3).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows) == [(1, 8, 0, "rows", None), (2, 8, 0, "rows", None), *[(3, 10, zlib.crc32("é".encode()), "rows", None)] * 2]
    _held(rows, 3)


def test_permutations_are_uniform_and_repeat(spark):
    docs = spark.range(6, numPartitions=3).withColumnRenamed("id", "doc_id")
    orders = Counter()
    for seed in range(60):
        got = sharding.shuffle_into_shards(docs, 2, seed).collect()
        orders[tuple(r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"])))] += 1
    assert len(orders) > 50  # of 720, 60 draws repeat 2.4 times on average
    first = Counter(o[0] for o, k in orders.items() for _ in range(k))
    assert set(first) == set(range(6)) and max(first.values()) < 25
    again = [sorted(map(tuple, sharding.shuffle_into_shards(docs, 2, 9).collect())) for _ in range(2)]
    assert again[0] == again[1]


def test_written_shards(spark, tmp_path):
    docs = spark.range(500).withColumnRenamed("id", "doc_id")
    got = sharding.shuffle_into_shards(docs, 4, 1)
    sharding.write_shards(got, str(tmp_path / "s"), rows_per_file=50)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "s")).select("doc_id", "shard", "slot").collect())) == sorted(map(tuple, got.select("doc_id", "shard", "slot").collect()))
    import pyarrow.parquet as pq

    for f in (tmp_path / "s").rglob("*.parquet"):
        slots = pq.ParquetFile(f).read().column("slot").to_pylist()
        assert slots == list(range(slots[0], slots[0] + len(slots))) and len(slots) <= 50
