"""Stages and near-dedup decide by row where ids repeat or are null."""

import corpus_pipeline as p
from lapwing.llm import near_dedup

D = "/root/testdata/sf0.001"


def words(tag, n=40, changed=0):
    return " ".join(f"{tag}{k}" if k >= changed else f"{tag}x{k}" for k in range(n))


def left(df):
    return sorted(map(repr, ((r["doc_id"], r["text"]) for r in df.collect())))


def test_one_row_of_each_group_stays(spark):
    clean, leak = words("c"), " ".join(r["text"] for r in spark.read.parquet(f"{D}/benchmark.parquet").where("item_id = 0").collect())
    rows = [(1, words("a")), (1, words("a")), (2, words("a")), (2, words("a")), (1, clean), (None, words("n")), (None, words("n")), (None, words("a")), (None, clean + " z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    exact = p.drop_exact_copies(spark, df, D)
    assert left(exact) == sorted(map(repr, [(2, words("a")), (1, clean), (None, words("n")), (None, clean + " z")]))
    near = p.drop_near_copies(spark, df, D)
    assert left(near) == sorted(map(repr, [(1, words("a")), (1, clean), (None, words("n"))]))
    leaks = spark.createDataFrame([(7, leak), (7, clean), (None, leak), (None, clean)], "doc_id long, text string")
    assert left(p.drop_leaks(spark, leaks, D)) == sorted(map(repr, [(7, clean), (None, clean)]))


def test_an_id_with_two_texts_links_by_both(spark):
    df = spark.createDataFrame([(1, words("a")), (1, words("b")), (2, words("a", changed=1)), (3, words("b", changed=1)), (4, words("d"))], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_dedup(df).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
