"""Components of a graph: the least node of each, and edges that get fewer with each round."""

from __future__ import annotations

import random

from folio.operators import graph


def test_edges_are_contracted(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [(f"s{i:03}", "hub") for i in range(30)] + [("loop", "loop")]
    pairs += [(f"r{rng.randrange(40):03}", f"r{rng.randrange(40):03}") for _ in range(30)]
    pairs += [("y2", "x1"), ("x3", "y2"), ("x3", "y1")]
    rng.shuffle(pairs)
    root: dict[str, str] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    sizes, plain = [], graph.staged

    def counted(df, name):
        out = plain(df, name)
        sizes.extend([out.count()] if name == "links" else [])
        return out

    monkeypatch.setattr(graph, "staged", counted)
    got = {r.id: r.community for r in graph.communities(spark.createDataFrame(pairs, "src_id string, tgt_id string")).collect()}
    assert got == {x: find(x) for x in root}
    assert sizes == sorted(sizes, reverse=True) and len(sizes) > 1 and sizes[-1] == 0 and sizes[1] < sizes[0] / 2
    assert graph.communities(spark.createDataFrame([], "src_id string, tgt_id string")).count() == 0


def test_nodes_are_not_sent_to_all_tasks(spark):
    """Edges are held against nodes by merged joins, however small the nodes look; the results are those of plain loops."""
    names = ["a", "b", "c", "a"]
    pairs = [("a", "b"), ("b", "z"), ("z", "y"), ("c", "c"), ("y", "a")]
    nodes = spark.createDataFrame([(n,) for n in names], "id string")
    edges = spark.createDataFrame([(f"{a}_{b}", a, b) for a, b in pairs], "rel_id string, src_id string, tgt_id string")
    touched = {(a, b) for a, b in pairs if a in names or b in names}
    left_nodes, left = graph.delete_nodes(spark.createDataFrame([(n,) for n in "abcyz"], "id string"), edges, nodes)
    assert sorted(r.id for r in left_nodes.collect()) == ["y", "z"]
    for got, want in ((graph.detach(edges, nodes), {(a, b) for a, b in pairs if a in names and b in names}), (graph.incident_to(edges, nodes), touched), (left, set(pairs) - touched)):
        assert sorted((r.src_id, r.tgt_id) for r in got.collect()) == sorted(want)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
