"""Connected components of a table of links, by labels that spread and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import Scratch, stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) of each id in links (a, b): the smallest id that it reaches.

    Each round takes the smallest label among neighbours and then the label of that label, so the
    distance covered doubles. Rounds are stored; only whether any label changed reaches the driver.
    """
    with Scratch(links.sparkSession) as store:
        both = store(links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select("b", "a")).distinct(), "links")
        labels = store(both.groupBy("id").agg(F.min("other").alias("low")).select("id", F.least("id", "low").alias("component")), "labels")
        while True:
            near = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("low"))
            spread = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "low").alias("component"))
            jump = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
            after = store(spread.join(jump, "component").select("id", "old", F.least("component", "root").alias("component")), "labels")
            labels = after.select("id", "component")
            if after.where(F.col("old") != F.col("component")).isEmpty():
                return stored(labels, "components")
