"""Property graph: degrees, neighbourhoods, components, maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.session import staged


def incident(edges: DataFrame, node: str) -> DataFrame:
    """Edges that start or end at a node, a loop once."""
    return edges.filter((F.col("src_id") == node) | (F.col("tgt_id") == node))


def incident_to(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch one of many nodes: two equi joins, as a join on either end would compare all with all. Nodes may be many: see ``detach``."""
    ids = lambda end: nodes.select(F.col("id").alias(end)).hint("merge")
    out = edges.join(ids("src_id"), "src_id", "left_semi").unionByName(edges.join(ids("tgt_id"), "tgt_id", "left_semi"))
    return out.dropDuplicates(["rel_id"])


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at each node that has one, a loop once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src_id", "tgt_id"))).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def edge_degrees(edges: DataFrame, of: DataFrame | None = None, degree: DataFrame | None = None) -> DataFrame:
    """The edges (or those in ``of``) with the degrees of both ends added up. ``degree``: the nodes' degrees, where they are known."""
    d = degrees(edges) if degree is None else degree
    side = lambda c, n: d.select(F.col("id").alias(c), F.col("degree").alias(n))
    out = (edges if of is None else of).join(side("src_id", "_a"), "src_id", "left").join(side("tgt_id", "_b"), "tgt_id", "left")
    return out.withColumn("edge_degree", F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))).drop("_a", "_b")


def popular(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    out = nodes.join(degrees(edges), "id", "left").select("id", "entity_name", F.coalesce("degree", F.lit(0)).alias("degree"))
    return out.orderBy(F.desc("degree"), "id").limit(n)


def search_labels(nodes: DataFrame, needle: str) -> DataFrame:
    return nodes.filter(F.lower("entity_name").contains(needle.lower())).select("entity_name").distinct()


def detach(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose ends are both among the nodes.

    Joins are merged: ids look small in a shuffle, where they are packed, and a table of all of them in every task's memory grows with the graph.
    """
    out = edges
    for end in ("src_id", "tgt_id"):
        out = out.join(nodes.select(F.col("id").alias(end)).distinct().hint("merge"), end, "left_semi")
    return out.select(*edges.columns)


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes and without the edges at them."""
    gone = ids.select("id").distinct()
    left = edges
    for end in ("src_id", "tgt_id"):
        left = left.join(gone.withColumnRenamed("id", end).hint("merge"), end, "left_anti")
    return nodes.join(gone.hint("merge"), "id", "left_anti"), left.select(*edges.columns)


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, hop): nodes within ``hops`` edges of the seeds in either direction, with the least number of edges."""
    both = edges.select(F.col("src_id").alias("id"), F.col("tgt_id").alias("to")).union(edges.select("tgt_id", "src_id"))
    seen = frontier = seeds.select("id", F.lit(0).alias("hop")).distinct()
    for hop in range(1, hops + 1):
        reached = frontier.join(both, "id").select(F.col("to").alias("id")).distinct()
        frontier = staged(reached.join(seen, "id", "left_anti").select("id", F.lit(hop).alias("hop")), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def communities(edges: DataFrame) -> DataFrame:
    """(id, community): nodes with the least node id of their component.

    In each round every node that has a lesser neighbour points to the least, pointers jump to their roots, and the edges are contracted to the roots, so that
    the rounds get smaller. Joins are merged, as ids of one component or hub may be most of a table that looks small on disk.
    """
    a, b = F.least("src_id", "tgt_id"), F.greatest("src_id", "tgt_id")
    links = staged(edges.select(a.alias("a"), b.alias("b")).distinct(), "links")
    names = staged(links.select(F.col("a").alias("id")).union(links.select("b")).distinct().withColumn("community", F.col("id")), "names")
    links = links.filter("a <> b")
    while not links.isEmpty():
        up = staged(links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to")), "up")
        while True:
            far = up.select(F.col("id").alias("to"), F.col("to").alias("far")).hint("merge")
            up = staged(up.join(far, "to", "left").select("id", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "up")
            if up.filter("moved").isEmpty():
                break
        root = lambda c: up.select(F.col("id").alias(c), F.col("to").alias(f"to_{c}")).hint("merge")  # noqa: B023, E731
        names = staged(names.join(root("community"), "community", "left").select("id", F.coalesce("to_community", "community").alias("community")), "names")
        ends = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"))
        links = staged(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return names.select("id", "community")
