"""Communities by modularity: neighbours merge where that raises it, and merged ones are contracted to a node, until nothing does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.session import staged

#: Gains below this are rounding, not gains.
LEAST = 1e-12
#: Rows of numbers that the driver sends to all tasks at once; the joins of more are merged.
SENT = 1 << 19


def contracted(edges: DataFrame) -> DataFrame:
    """(a <= b, w): the weights between each two nodes in either direction added up. Null weights and such of 0 or less count as no edge."""
    a, b = F.least("src_id", "tgt_id"), F.greatest("src_id", "tgt_id")
    return edges.filter("weight > 0").select(a.alias("a"), b.alias("b"), "weight").groupBy("a", "b").agg(F.sum("weight").alias("w"))


def strengths(links: DataFrame) -> DataFrame:
    """(id, k): the weights at each node; a loop counts twice, once for each end."""
    return links.select(F.col("a").alias("id"), "w").union(links.select("b", "w")).groupBy("id").agg(F.sum("w").alias("k"))


def communities(edges: DataFrame) -> DataFrame:
    """(id, community) of every node of the weighted edges (src_id, tgt_id, weight): no two communities would raise the modularity if they merged.

    In each round every community finds the neighbour with which it gains most, of equal gains the one of least id. Where two choose each other, the one of
    greater strength stays and takes the other in, and with it all that chose it and still gain if all the others come along: so the modularity rises with
    every round, and a hub takes many in at once. Then the merged are contracted to one node. A community is named by its least node. Nodes without an edge
    of positive weight are in none. Names are numbered in their order once, and the rounds see numbers alone: links (a < b, w) with the strengths of both ends.
    """
    links = staged(contracted(edges), "links")
    names = staged(strengths(links).orderBy("id").withColumn("at", F.monotonically_increasing_id()), "names")
    twice = names.agg(F.sum("k")).first()[0] or 0.0
    end = lambda c: names.select(F.col("id").alias(c), F.col("at").alias(f"at_{c}"), F.col("k").alias(f"k{c}")).hint("merge")
    links = links.filter("a <> b").join(end("a"), "a").join(end("b"), "b")
    links = staged(links.select(F.col("at_a").alias("a"), F.col("at_b").alias("b"), "w", "ka", "kb"), "links")
    names = names.select("id", F.col("at").alias("community"))
    gain = lambda w, x, y: 2 * (w / F.lit(twice) - x / F.lit(twice) * y / F.lit(twice))
    few, turn, label, count = False, 0, None, names.count()
    while True:
        few = few or count <= SENT
        sent = lambda df: F.broadcast(df) if few else df.hint("merge")  # noqa: B023, E731
        if few and label is None:
            label = staged(names.select(F.col("community").alias("id"), F.col("community").alias("to")).distinct(), "label")
        pairs = links.withColumn("gain", gain(F.col("w"), F.col("ka"), F.col("kb"))).filter(F.col("gain") > LEAST)
        both = pairs.select(F.col("a").alias("id"), F.col("b").alias("to"), "w", F.col("ka").alias("k"), F.col("kb").alias("kto"), "gain")
        both = both.union(pairs.select("b", "a", "w", "kb", "ka", "gain"))
        if few:  # a maximum needs no sort, and little is left for the rest
            both = both.join(sent(both.groupBy("id").agg(F.max("gain").alias("most"))), "id").filter("gain = most")
        best = both.groupBy("id").agg(F.min(F.struct((-F.col("gain")).alias("g"), "to", "w", "k", "kto")).alias("x")).select("id", "x.to", "x.w", "x.k", "x.kto")
        best = staged(best, "best")
        count = best.count()
        if not count:
            break
        mutual = best.join(sent(best.select(F.col("id").alias("to"), F.col("to").alias("id"))), ["id", "to"])
        roots = mutual.filter((F.col("k") > F.col("kto")) | ((F.col("k") == F.col("kto")) & (F.col("id") < F.col("to")))).select(F.col("id").alias("to"), F.col("to").alias("first"))
        asking = best.join(sent(roots), "to").join(sent(roots.select(F.col("to").alias("id"))), "id", "left_anti")
        crowd = asking.groupBy("to").agg(F.sum("k").alias("crowd"))
        after = gain(F.col("w"), F.col("k"), F.col("kto") + F.col("crowd") - F.col("k"))
        merged = staged(asking.join(sent(crowd), "to").filter((F.col("id") == F.col("first")) | (after > LEAST)).select("id", "to", "k", "kto"), "merged")
        grown = merged.groupBy("to").agg((F.max("kto") + F.sum("k")).alias("k"))
        moved = staged(merged.select("id", "to").join(sent(grown), "to").select("id", "to", "k").union(grown.select("to", "to", "k")), "moved")
        new = lambda c: sent(moved.select(F.col("id").alias(c), F.col("to").alias(f"to_{c}"), F.col("k").alias(f"new_{c}")))  # noqa: B023, E731
        ends = links.join(new("a"), "a", "left").join(new("b"), "b", "left")
        ends = ends.select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"), "w", F.coalesce("new_a", "ka").alias("kx"), F.coalesce("new_b", "kb").alias("ky")).filter("x <> y")
        ordered = lambda x, y: F.when(F.col("x") < F.col("y"), F.col(x)).otherwise(F.col(y))
        ends = ends.select(ordered("x", "y").alias("a"), ordered("y", "x").alias("b"), "w", ordered("kx", "ky").alias("ka"), ordered("ky", "kx").alias("kb"))
        links = staged(ends.groupBy("a", "b").agg(F.sum("w").alias("w"), F.max("ka").alias("ka"), F.max("kb").alias("kb")), "links")
        step = lambda c: sent(moved.select(F.col("id").alias(c), F.col("to").alias("far")))  # noqa: B023, E731
        if label is None:
            names = staged(names.join(step("community"), "community", "left").select("id", F.coalesce("far", "community").alias("community")), "names")
            continue
        label, turn = label.join(step("to"), "to", "left").select("id", F.coalesce("far", "to").alias("to")), turn + 1
        if turn % 8 == 0:
            label = staged(label, "label")
    first = names.groupBy(F.col("community").alias("id")).agg(F.min("id").alias("first"))
    if label is None:
        return names.join(first.withColumnRenamed("id", "community").hint("merge"), "community").select("id", F.col("first").alias("community"))
    ends = staged(label.join(first.hint("merge"), "id"), "ends")
    named = ends.join(ends.groupBy("to").agg(F.min("first").alias("least")).hint("merge"), "to").select(F.col("id").alias("community"), "least")
    return names.join(named.hint("merge"), "community").select("id", F.col("least").alias("community"))


def parts(edges: DataFrame, label: DataFrame) -> DataFrame:
    """(community, nodes, inner, strength, part): of each community the nodes, the weight inside, the strength of its nodes, and its part of the modularity.

    Edges are added up by the communities of their ends, which are few, and not by the ends.
    """
    own = lambda c, end: label.select(F.col("id").alias(end), F.col("community").alias(c)).hint("merge")
    ends = edges.filter("weight > 0").select("src_id", "tgt_id", "weight").join(own("a", "src_id"), "src_id", "left").join(own("b", "tgt_id"), "tgt_id", "left")
    between = staged(ends.groupBy("a", "b").agg(F.sum("weight").alias("w")), "between")
    twice = F.lit(2 * (between.agg(F.sum("w")).first()[0] or 0.0))
    inner = between.filter("a = b").select(F.col("a").alias("community"), F.col("w").alias("inner"))
    strength = strengths(between).filter("id is not null").select(F.col("id").alias("community"), F.col("k").alias("strength"))
    sums = label.groupBy("community").agg(F.count("*").alias("nodes")).join(strength.hint("merge"), "community")
    out = sums.join(inner.hint("merge"), "community", "left").withColumn("inner", F.coalesce("inner", F.lit(0.0)))
    return out.select("community", "nodes", "inner", "strength", (2 * F.col("inner") / twice - (F.col("strength") / twice) * (F.col("strength") / twice)).alias("part"))
