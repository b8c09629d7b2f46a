"""Communities by modularity against plain loops."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from folio.operators import modularity
from folio.plans import catalog
from tests.comparing import TABLES


def plain(edges, label):
    """(modularity, gains of merging each two communities with an edge between them) by plain loops."""
    twice, k, between = 0.0, Counter(), Counter()
    for a, b, w in edges:
        twice += 2 * w
        k[label[a]] += w
        k[label[b]] += w
        between[min(label[a], label[b]), max(label[a], label[b])] += w
    q = sum(2 * between[c, c] / twice - (k[c] / twice) ** 2 for c in k)
    return q, {p: 2 * (w / twice - k[p[0]] * k[p[1]] / twice**2) for p, w in between.items() if p[0] != p[1]}


def checked(spark, edges):
    frame = spark.createDataFrame([(a, b, w) for a, b, w in edges], "src_id string, tgt_id string, weight double")
    out = modularity.communities(frame)
    label = {r.id: r.community for r in out.collect()}
    held = [(a, b, w) for a, b, w in edges if w and w > 0]
    assert set(label) == {x for a, b, _ in held for x in (a, b)}
    members = defaultdict(list)
    for i, c in label.items():
        members[c].append(i)
    assert all(min(m) == c for c, m in members.items())
    q, gains = plain(held, label)
    assert sum(r.part for r in modularity.parts(frame, out).collect()) == pytest.approx(q)
    assert not gains or max(gains.values()) < 1e-9
    return label, q


def test_planted_groups_are_found(spark):
    rng = random.Random(2)
    group = {f"n{i:02d}": i % 4 for i in range(40)}
    names = sorted(group)
    edges = [(a, b, 1.0) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < (0.8 if group[a] == group[b] else 0.03)]
    label, q = checked(spark, edges)
    assert q > 0.55
    pairs = [(label[a] == label[b], group[a] == group[b]) for i, a in enumerate(names) for b in names[i + 1 :]]
    assert sum(x == y for x, y in pairs) > 0.9 * len(pairs)


def test_stars_chains_loops_and_ties(spark):
    star = [("hub", f"leaf{i:03d}", 1.0) for i in range(60)] + [("hub2", f"twig{i:03d}", 2.0) for i in range(40)] + [("hub", "hub2", 1.0)]
    label, _ = checked(spark, star)
    assert len(set(label.values())) == 2
    checked(spark, [(f"c{i:02d}", f"c{i + 1:02d}", 1.0) for i in range(30)])
    checked(spark, [("a", "a", 3.0), ("a", "b", 1.0), ("b", "a", 1.0), ("c", "d", 1.0), ("e", "f", None), ("g", "h", 0.0), ("g", "c", -1.0)])
    assert checked(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("d", "a", 1.0)])[1] == pytest.approx(0.0)


def test_nothing(spark):
    assert modularity.communities(spark.createDataFrame([], "src_id string, tgt_id string, weight double")).count() == 0


def test_graph_of_the_tables(spark):
    parts = catalog.QUERIES["modularity_parts"](spark, f"{TABLES}/sf0.001").collect()
    assert len(parts) > 3 and sum(r.part for r in parts) > 0.1


def _graph(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60)}", f"m{rng.randrange(12)}", float(rng.randrange(1, 9))) for _ in range(300)] + [(f"m{i}", "hub", 1.0) for i in range(12)]
    return spark.createDataFrame(edges, "src_id string, tgt_id string, weight double")


def test_rounds_see_numbers_not_names(spark, monkeypatch):
    """Names are joined once, when they are numbered; no round sorts, shuffles or writes a string."""
    kinds, staged = [], modularity.staged
    monkeypatch.setattr(modularity, "staged", lambda df, name: kinds.append((name, {t for _, t in df.dtypes})) or staged(df, name))
    modularity.communities(_graph(spark)).count()
    links = [t for name, t in kinds if name == "links"]
    assert len(links) > 3 and all("string" not in t for t in links[1:])
    assert all("string" not in t for name, t in kinds if name in ("best", "merged", "moved", "label"))


def test_merged_and_sent_joins_agree(spark, monkeypatch):
    frame = _graph(spark)
    rows = lambda: sorted((r.id, r.community) for r in modularity.communities(frame).collect())
    want = rows()
    for most in (0, 20):  # never, and from some round on
        monkeypatch.setattr(modularity, "SENT", most)
        assert rows() == want


def test_parts_shuffle_no_table_of_pairs_of_nodes(spark, monkeypatch):
    """Edges are added up by the communities of their ends; ends without a community count for the whole only."""
    sizes, staged = [], modularity.staged
    monkeypatch.setattr(modularity, "staged", lambda df, name: sizes.append((out := staged(df, name)).count()) or out)
    edges = [("a", "b", 2.0), ("b", "a", 1.0), ("a", "a", 1.0), ("b", "c", 1.0), ("c", "d", 4.0), ("d", "x", 2.0), ("x", "y", 1.0), ("e", "f", None)]
    label = [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")]
    frame = spark.createDataFrame(edges, "src_id string, tgt_id string, weight double")
    out = {r.community: (r.nodes, r.inner, r.strength, r.part) for r in modularity.parts(frame, spark.createDataFrame(label, "id string, community string")).collect()}
    twice = 24.0
    assert out == {"a": (2, 4.0, 9.0, pytest.approx(8 / twice - (9 / twice) ** 2)), "c": (2, 4.0, 11.0, pytest.approx(8 / twice - (11 / twice) ** 2))}
    assert max(sizes) <= 5
