"""Counts handed on to be added up don't multiply with the parts that a table is stored in."""

from lapwing.llm import collocations as c


def test_parts_do_not_multiply_counts(spark):
    text = "new york city, new york city hall and more of it"
    cores = spark.sparkContext.defaultParallelism
    docs = spark.range(40 * cores).selectExpr("id AS doc_id", f"'{text}' AS text", "'en' AS lang").repartition(8 * cores)
    handed, summed = c.task_counts(docs, least=100, bits=14).count(), c.phrase_counts(docs, least=100, bits=14)
    assert handed <= cores * summed.count()
    assert {r["phrase"]: r["f"] for r in summed.where("width = 3").collect()}["new york city"] == 80 * cores
