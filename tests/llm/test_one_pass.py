"""Encoded and decoded in one Python worker per task, with the results of the two steps."""

import corpus_pipeline
from lapwing.llm import bpe, registry

TEXTS = ["", None, "Plain words, plain words", "  two  spaces \n\n", "日本語 é́ 🙂", "<|endoftext|>x</s> [INST]", "a" * 3000, "\x00\x1c tab\t"]


def test_one_pass_equals_two(spark):
    docs = spark.createDataFrame([(k if k % 5 else None, t, "z", "c") for k, t in enumerate(TEXTS * 3)], "doc_id long, text string, decoded string, ids string").repartition(2)
    rows = lambda df: sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in df.collect())
    once = bpe.encode(docs, decoded=True)
    assert once.columns == ["doc_id", "ids", "decoded"] and bpe.encode(docs).columns == ["doc_id", "ids"]
    assert rows(once) == rows(bpe.decode(bpe.encode(docs))) and once.count() == len(TEXTS) * 3
    assert all(r["decoded"] == (r["text"] or "") for r in bpe.encode(docs.dropna(subset="doc_id"), decoded=True).join(docs.select("doc_id", "text").where("doc_id IS NOT NULL").distinct(), "doc_id").collect())


def test_one_python_worker_per_task(spark):
    """A second Python step would hold a vocabulary and batches of its own in each running task."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for df in (registry.op2_bpe(spark, d), corpus_pipeline.encode(spark, docs, d)):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
