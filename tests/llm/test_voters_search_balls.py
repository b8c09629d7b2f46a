"""Weak supervision, ranked search and ball k-means against SQL, brute force, held-out labels and odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folio.llm import ball_kmeans, lexical_search, registry, toxicity
from tests.comparing import TABLES, both, oracle
from tests.llm.test_operators import SCHEMA, empty, odd, texts_of

SF = f"{TABLES}/sf0.001"


# --- 11 ----------------------------------------------------------------------------------------------------------
def test_toxicity_on_held_out_labels(spark):
    got = registry.QUERIES["op11_weak_supervision"](spark, f"{TABLES}/sf0.1").toPandas()
    labels = spark.read.parquet(f"{TABLES}/sf0.1/labels.parquet").toPandas()
    both_ = got.merge(labels, on="doc_id")
    held = both_[both_.held_out]
    assert len(got) == 10_000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (held.predicted == held.toxic).mean() > 0.97
    assert held[held.toxic == 1].predicted.mean() > 0.9 and held[held.toxic == 0].predicted.mean() < 0.03


def made_texts(n, rng, bad=("lurx", "smoggle", "twarn")):
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 80))]
        toxic = int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "en", "s", "ish"])
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_learns_beginnings_of_words(spark):
    rows = made_texts(900, random.Random(2))
    docs = texts_of(spark, [(i, t, "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 600], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert sum(got[i] == y for i, _, y in rows if i >= 600) >= 297
    assert all(any(w.startswith(t) for t in model["terms"]) for w in (b"lurx", b"smoggle", b"twarn"))
    # a text of 60,000 words in which the words come at the end is judged as a whole
    long_ = texts_of(spark, [(1, "fine " * 60_000 + "lurx smoggle twarn " * 200, "s"), (2, "fine " * 60_000, "s")])
    assert [r.predicted for r in toxicity.score(long_, model).orderBy("doc_id").collect()] == [1, 0]


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(4)
    y = rng.random(6000) < 0.2
    hit, chance = np.array([0.7, 0.5, 0.4, 0.6]), np.array([0.02, 0.01, 0.05, 0.1])
    votes = rng.random((6000, 4)) < np.where(y[:, None], hit, chance)
    copy = votes[:, :1] ^ (rng.random((6000, 1)) < 0.02)  # a fifth voter that nearly repeats the first
    votes = np.column_stack([votes, copy])
    prior = np.stack([np.append(chance, 0.04), np.append(hit, 0.69)])
    got = toxicity.label_model(votes, 5, prior)
    assert got["parent"][4] == 0 or got["parent"][0] == 4
    assert ((got["posterior"] > 0.5) == y).mean() > 0.94
    weighed = [(got["posterior"] @ votes[:, j]) / got["posterior"].sum() for j in range(4)]
    assert np.abs(np.array(weighed) - hit).max() < 0.08


def test_forest_leaves_independent_voters_alone():
    rng = np.random.default_rng(1)
    votes = (rng.random((4000, 6)) < 0.3).astype(float)
    votes[:, 5] = votes[:, 2]
    parent = toxicity.forest(votes, np.full(4000, 0.5))
    assert sorted(np.flatnonzero(parent >= 0)) in ([5], [2]) and parent.max() in (2, 5)


def test_toxicity_odd_inputs(spark):
    labels = spark.createDataFrame([(1, 0), (4, 1), (6, 1), (9, 0), (9, 1), (7, None)], "doc_id long, toxic int")
    docs = odd(spark)
    for some in (labels, labels.filter("toxic = 0"), labels.filter("toxic = 1"), labels.limit(0)):
        model = toxicity.train(docs, some)
        rows = toxicity.score(docs, model).collect()
        assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
        assert rows[-1].score == rows[-2].score
        assert toxicity.score(empty(spark), model, ["doc_id", "score", "size"]).columns == ["doc_id", "size", "score", "predicted"]
    assert all(r.predicted == 0 for r in toxicity.score(docs, toxicity.train(docs, labels.filter("toxic = 0"))).collect())


@pytest.mark.parametrize("text,want", [("Élan idiot", {"Élan", "Éla", "idiot", "idi", "idio"}), ("ab a1b", {"a1b"}), ("", set()), ("漢字文 x", {"漢字文"})])
def test_text_terms(text, want):
    raw = np.frombuffer(text.encode(), np.uint8)
    row, h, s, e, n = toxicity.text_terms(raw, np.array([0, len(raw)]))
    got = {raw[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)}
    assert got == want and len(set(h)) == len(h) and n[0] == len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text))


# --- 12 ----------------------------------------------------------------------------------------------------------
def test_search_equals_sql(spark):
    got, want = both(spark, oracle(SF), lexical_search.op12_sorted_accumulation, lexical_search.OP12_SQL, SF)
    assert got == want and len(got[1]) > 100


def plain_search(docs, items, top=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    terms = [(i, Counter(find(t))) for i, t in docs]
    n_docs, n_words = sum(bool(c) for _, c in terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(w for _, c in terms for w in c)
    out = []
    for item, text in items:
        asked, scored = set(find(text)), []
        for i, c in terms:
            m = 10 + 90 * sum(c.values()) * n_docs // max(n_words, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in asked if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("impacts,block", [(1 << 21, 4000), (16, 3)])
def test_search_brute_force(spark, monkeypatch, impacts, block):
    monkeypatch.setattr(lexical_search, "IMPACTS", impacts)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("alpha Beta gamma2 δέλτα the a of-x é".split()) for _ in range(rng.choice([0, 1, 5, 40])))) for i in range(80)]
    docs += [(100, None), (101, ""), (7, docs[7][1]), (None, "alpha Beta"), (None, "alpha Beta"), (102, "rare " * 30_000)]
    items = [(1, "Alpha BETA"), (2, "the"), (3, None), (4, ""), (5, "rare of x δέλτα"), (5, "rare of x δέλτα"), (6, "nowhere"), (7, "the the a É")]
    frame = texts_of(spark, [(i, t, "s") for i, t in docs]).withColumn("score", F.lit("x")).withColumn("rank", F.lit(0)).repartition(3)
    found = lexical_search.search(frame, spark.createDataFrame(items, "item_id long, text string"), block=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_search(docs, items)


def test_search_odd_inputs(spark):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert lexical_search.search(empty(spark), items).count() == 0
    assert lexical_search.search(odd(spark), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical_search.search(odd(spark), items.limit(0)).count() == 0
    assert lexical_search.search(spark.createDataFrame([(1, None, None, None, 0)], SCHEMA), items).count() == 0


def test_radix_order():
    keys = np.random.default_rng(1).integers(0, 1 << 60, 5000, dtype=np.uint64)
    for k in (keys, keys % np.uint64(70_000), keys[:0], np.zeros(3, np.uint64)):
        assert (lexical_search.radix_order(k) == np.argsort(k, kind="stable")).all()


# --- 13 ----------------------------------------------------------------------------------------------------------
def test_balls_equal_sql(spark):
    got, want = both(spark, oracle(SF), ball_kmeans.op13_ball_kmeans, ball_kmeans.OP13_SQL, SF)
    assert got == want and len(got[1]) == 500


def plain_kmeans(rows, k, rounds, seed=3):
    vectors = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    order = sorted(vectors, key=lambda r: hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest())
    centroids = [v for _, v in order[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in vectors]

    for _ in range(rounds):
        near = assigned()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(vectors, near, strict=True) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    near = assigned()
    inertia = Counter()
    for d, c in near:
        inertia[c] += d
    return sorted((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(vectors, near, strict=True))


@pytest.mark.parametrize("spread,k", [(0.3, 5), (5.0, 4), (0.0, 3)])
def test_balls_brute_force(spark, spread, k):
    rng = np.random.default_rng(8)
    middles = rng.normal(0, 4, (5, 6))
    rows = [(int(i), [float(x) for x in middles[i % 5] + rng.normal(0, spread, 6)]) for i in range(150)]
    rows += [rows[3], rows[3]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).repartition(3)
    got = ball_kmeans.ball_kmeans(frame, k=k, rounds=7, dim=6)
    assert sorted(map(tuple, got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())) == plain_kmeans(rows, k, 7)


def test_settle_compares_only_what_reaches():
    rng = np.random.default_rng(2)
    c = rng.integers(-50, 50, (9, 3)) * 100
    c[8] = c[2]  # two centroids at one place: the smaller number wins
    x = (c[rng.integers(0, 9, 400)] + rng.integers(-60, 60, (400, 3))).astype(np.int32)
    every = ((x[:, None].astype(np.int64) - c[None]) ** 2).sum(-1)
    for own in (np.zeros(400, np.int32), every.argmin(1).astype(np.int32), rng.integers(0, 9, 400).astype(np.int32)):
        cluster, dist = ball_kmeans.settle(x, own, c)
        assert (cluster == every.argmin(1)).all() and (dist == every.min(1)).all()


def test_balls_odd_inputs(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1e30, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [1.0, 2.0]), (None, [5.0, -2.5]), (8, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit(1)).withColumn("v", F.lit(1))
    got = ball_kmeans.ball_kmeans(frame, k=8, rounds=3, dim=2).toPandas()
    assert len(got) == 3 and (got.distance == 0).all() and (got.inertia == 0).all()
    assert ball_kmeans.ball_kmeans(frame.limit(0), dim=2).count() == 0
    assert isinstance(got, pd.DataFrame) and list(got.columns) == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
