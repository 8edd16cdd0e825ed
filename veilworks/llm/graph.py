"""Connected components of a table of links, by label passing with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilworks.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (id, component): for each end of a link the smallest id that it reaches.

    In each round every node takes the least label among its neighbours' and its own, then its
    label's label; rounds go on until no label changes. Each round's labels are kept in the shared
    folder, so the plan doesn't grow and lost executors cost one round. Only counts reach the driver.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("l")).select("id", F.least("id", "l").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        least = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("further"))
        moved = cut(least.join(jump, "to", "left").select("id", "old", F.least("to", F.coalesce("further", "to")).alias("component")))
        changed = moved.where("old <> component").limit(1).count()
        labels = moved.select("id", "component")
        if not changed:
            return labels
