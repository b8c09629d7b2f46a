"""Connected components of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, comp): every linked node with the smallest node of its component.

    Each round hooks every remaining root to its smallest linked root, follows the hooks to their ends, and replaces the links by those between
    different roots. Rounds are tables in the shared folder; only counts reach the driver. Links to oneself and repeated links make no difference.
    """
    edges = staged(links.select("a", "b").filter("a <> b").distinct(), "links")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("comp", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("root"), F.least("a", "to").alias("to"))
        hooks = staged(hooks, "hooks")
        while True:
            above = hooks.select(F.col("root").alias("to"), F.col("to").alias("top"))
            jumped = staged(hooks.join(above, "to", "left").select("root", F.coalesce("top", "to").alias("to"), (F.col("top") < F.col("to")).alias("moved")), "hooks")
            hooks = jumped.select("root", "to")
            if jumped.filter("moved").isEmpty():
                break
        moved = hooks.withColumnRenamed("root", "comp")
        labels = staged(labels.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        ends = edges.join(hooks.select(F.col("root").alias("a"), F.col("to").alias("ta")), "a").join(hooks.select(F.col("root").alias("b"), F.col("to").alias("tb")), "b")
        edges = staged(ends.select(F.col("ta").alias("a"), F.col("tb").alias("b")).filter("a <> b").distinct(), "links")
    return labels
