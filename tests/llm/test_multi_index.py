"""The multi-index of fingerprints, judged by row, and what it finds at the threshold."""

import numpy as np
from pyspark.sql import functions as F

from lapwing.llm import decontaminate as d


def test_fingerprints_within_the_radius_meet_and_unrelated_ones_seldom(spark):
    rng = np.random.default_rng(6)
    assert sum(n for n, _ in d.BLOCKS) == 128 and sum(t + 1 for _, t in d.BLOCKS) > d.RADIUS
    bits = rng.integers(0, 2, (200, 128))
    near = bits.copy()
    for row, n in zip(near, rng.integers(d.RADIUS - 4, d.RADIUS + 1, 200), strict=True):
        row[rng.choice(128, n, replace=False)] ^= 1
    halves = lambda rows: [[int(np.packbits(r[64 * k : 64 * k + 64], bitorder="little").view(np.int64)[0]) for k in (0, 1)] for r in rows]
    items = spark.createDataFrame([(k, 1, fp) for k, fp in enumerate(halves(bits))], "item int, length int, fp array<long>")
    own = spark.createDataFrame([(k, 1, fp) for k, fp in enumerate(halves(near))], "own int, length int, own_fp array<long>")
    met = {(r["own"], r["item"]) for r in d.meeting(own, items, ["length"]).collect()}
    assert all((k, k) in met for k in range(200))
    print("unrelated pairs that pass the blocks", (len(met) - 200) / (200 * 199))
    assert len(met) - 200 < 0.1 * 200 * 199


def test_recall_at_the_threshold(spark):
    """Windows whose similarity to their item is between 0.8 and 0.82: at least 9 of 10 are within the radius."""
    rng = np.random.default_rng(9)
    pairs = []
    while len(pairs) < 600:
        n = int(rng.integers(6, 120))
        item = rng.integers(-(2**62), 2**62, n)
        common = rng.random(n) < 0.3
        weight = np.where(common, 1 / rng.integers(2, 30, n), 1.0)
        keep = rng.random(n) > rng.uniform(0.0, 0.2)
        extra = rng.integers(-(2**62), 2**62, int(rng.integers(0, max(2, n // 6))))
        shared = weight[keep].sum()
        if 0.8 <= shared / (weight.sum() + len(extra)) <= 0.82:
            pairs.append((item.tolist(), weight.tolist(), [*item[keep].tolist(), *extra.tolist()], [*weight[keep].tolist(), *[1.0] * len(extra)]))
    rows = [(k, side, h, x) for k, (a, w, b, y) in enumerate(pairs) for side, hs, xs in (("a", a, w), ("b", b, y)) for h, x in zip(hs, xs, strict=True)]
    prints = d.simhash(spark.createDataFrame(rows, "pair int, side string, h long, weight double"), ["pair", "side"])
    a, b = (prints.where(F.col("side") == x).select("pair", F.col("fp").alias(x)) for x in "ab")
    far = [r["far"] for r in a.join(b, "pair").select(d.distance(F.col("a"), F.col("b")).alias("far")).collect()]
    print("recall at the threshold", np.mean(np.array(far) <= d.RADIUS), "mean distance", np.mean(far))
    assert len(far) == 600 and np.mean(np.array(far) <= d.RADIUS) >= 0.9


def test_rows_are_judged_one_by_one(spark):
    item = " ".join(f"i{k}" for k in range(12))
    bench = spark.createDataFrame([(5, item), (6, " ".join(f"j{k}" for k in range(30)))], "item_id long, text string")
    rows = [(None, f"a b {item} c {k % 3}") for k in range(60)] + [(None, "a clean row of its own"), (1, f"x {item}"), (1, "another clean row"), (2, None), (2, ""), (3, item.upper()), (3, item.upper())]
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, item_ids int, key string")
    got = sorted(repr((r["doc_id"], r["contaminated"], r["item_ids"])) for r in d.decontaminate(docs, bench).collect())
    want = sorted(repr((i, item in (t or "").lower(), [5] if item in (t or "").lower() else [])) for i, t in rows)
    assert got == want
    left = d.drop_leaks(docs, bench)
    assert left.columns == docs.columns
    assert sorted(repr((r["doc_id"], r["text"])) for r in left.collect()) == sorted(repr((i, t)) for i, t in rows if item not in (t or "").lower())
    assert d.find_leaks(docs, bench).count() == sum(item in (t or "").lower() for _, t in rows)
    assert d.decontaminate(docs.limit(0), bench).count() == 0 and d.drop_leaks(docs, bench.limit(0)).count() == len(rows)
