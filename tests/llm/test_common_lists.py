"""Lists that are long because a value is common: who has no partner there leaves before full sets are made."""

import numpy as np

from lapwing.llm import near_dedup


def test_classes_without_a_partner_need_no_full_set(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(400):  # each of 60 phrases is in about 67 texts
        texts.append([f"p{k}{c}" for k in rng.choice(60, 10, replace=False) for c in "abcde"])
    for k in range(0, 40, 2):
        texts.append([*texts[k][:-1], "z"])
    asked, full_sets = [], near_dedup._full_sets
    monkeypatch.setattr(near_dedup, "_full_sets", lambda ids, *rest: asked.append(ids.count()) or full_sets(ids, *rest))
    monkeypatch.setattr(near_dedup, "SMALL", 20)
    monkeypatch.setattr(near_dedup, "ROWS", 50)  # partners stand in different blocks
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(df, 2, "4/5").collect()}
    assert got == {k: (k - 400) * 2 if k >= 400 else k for k in range(420)}
    assert len(asked) == 1 and asked[0] < 120


def test_bitmap_holds_its_ids(spark):
    ids = spark.range(3000).selectExpr("id * 7 AS id")
    bitmap = near_dedup._bitmap_of(ids, "id")
    rows = spark.range(21000).selectExpr("id", "CAST(id AS STRING) AS text")
    got = {r["id"] for r in near_dedup._sets(rows, 2, False, bitmap).select("id").collect()}
    assert got >= set(range(0, 21000, 7)) and len(got) < 3000 + 18000 * 0.1
