"""Indexes against brute force: vectors by cells, BM25, synonyms."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import lexical, retrieval, vector_index, vectors
from folio.plans import catalog
from folio.session import table
from tests.comparing import TABLES


def nearest(rows, queries, k):
    out = {}
    for i, q in queries:
        nq = np.linalg.norm(q)
        scored = [(-round(float(np.dot(v, q) / np.linalg.norm(v) / nq), 9), j) for j, v in rows if len(v) == len(q) and np.linalg.norm(v) > 0]
        out[i] = [j for _, j in sorted(scored)[:k]]
    return out


def made_vectors(n=400, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (15, dim))
    return [(i, [float(x) for x in middles[i % 15] + rng.normal(0, 0.4, dim)]) for i in range(n)]


@pytest.fixture(scope="module")
def built(spark):
    rows = made_vectors()
    odd = [(1000, None), (1001, []), (1002, [0.0] * 12), (1003, [1.0, 2.0]), (1004, rows[5][1]), (1005, [x * 50 for x in rows[5][1]])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3)
    return rows + odd[4:], frame, vector_index.build(frame, 12)


def test_exact_search_finds_the_nearest(spark, built, monkeypatch):
    rows, frame, index = built
    queries = [(i, v) for i, v in rows if i % 7 == 0] + [(-1, [3.0] * 12)]
    asked = spark.createDataFrame(queries, "query_id long, q array<double>")
    want = nearest(rows, queries, 6)
    for asked_at_once in (1024, 9):
        monkeypatch.setattr(vector_index, "ASKED", asked_at_once)
        got: dict = {}
        for r in vector_index.search_exact(index, frame, asked, 6).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == want


def test_index_in_parts_written_and_read(spark, built, monkeypatch, tmp_path):
    rows, frame, _ = built
    monkeypatch.setattr(vector_index, "PART", 7)
    vector_index.build(frame, 12, cells=6).write(f"file://{tmp_path}/index")
    index = vector_index.Index.read(spark, f"file://{tmp_path}/index")
    assert index.rows.select("part").distinct().count() > 5 and index.rows.count() == len(rows)
    asked = spark.createDataFrame([(0, rows[0][1]), (1, [0.0] * 12), (2, None)], "query_id long, q array<double>")
    got = [r.vec_id for r in vector_index.search_exact(index, frame, asked, 5).orderBy("rank").collect()]
    assert got == nearest(rows, [(0, rows[0][1])], 5)[0]


def test_index_recall(spark):
    """At least nine in ten of the true neighbours of every vector of the table are found."""
    sf = f"{TABLES}/sf0.001"
    found = {(r.query_id, r.vec_id) for r in catalog.QUERIES["vector_index_topk"](spark, sf).collect()}
    v = table(spark, sf, "embeddings").toPandas()
    m = np.array(v["embedding"].tolist(), np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    score = np.round(m @ m.T, 9)
    ids = v["vec_id"].to_numpy()
    true = {(int(ids[i]), int(j)) for i in range(len(ids)) for j in ids[np.lexsort((ids, -score[i]))[:10]]}
    assert len(found & true) >= 0.9 * len(true)


def test_index_searches_few_cells_where_vectors_lie_in_clusters(spark, built):
    rows, frame, index = built
    probes = vector_index.tuned_probes(index, frame, 10)
    assert probes <= len(index.centroids) // 2
    asked = frame.filter("vec_id < 400").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    want = nearest(rows, rows[:400], 10)
    got = {(r.query_id, r.vec_id) for r in vector_index.search(index, frame, asked, 10, probes).collect()}
    assert len(got & {(i, j) for i, js in want.items() for j in js}) >= 0.9 * 4000


def test_few_candidates_leave_the_tasks_where_vectors_lie_anywhere(spark, monkeypatch):
    """What is shuffled for a query must not grow with the cells that it asks for."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 12)]) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame(rows[:50], "query_id long, q array<double>")
    index = vector_index.build(frame, 12)
    seen = {}

    def counted(name, f):
        def run(found, *rest):
            seen[name] = found.count()
            return f(found, *rest)

        monkeypatch.setattr(vector_index, name, run)

    counted("_best", vector_index._best)
    counted("_scored", vector_index._scored)
    vector_index.search(index, frame, asked, 5, 20)
    assert seen["_best"] <= 50 * 5 * vector_index.REFINE
    vector_index.search_exact(index, frame, asked, 5)
    assert seen["_scored"] <= 50 * 15


def test_index_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, q array<double>")
    index = vector_index.build(empty, 2)
    assert vector_index.search(index, empty, asked, 3, 2).count() == 0
    assert vector_index.search_exact(index, empty, asked, 3).count() == 0


def test_blocks_of_queries_and_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "VECTORS", 50)
    monkeypatch.setattr(vectors, "QUERIES", 7)
    rows = made_vectors(180)
    frame = spark.createDataFrame([*rows, (500, None), (501, [0.0] * 12), (502, [1.0])], "vec_id long, embedding array<double>")
    queries = [*rows[:20], (90, [1.0])]
    asked = spark.createDataFrame([*queries, (91, None), (92, [])], "query_id long, q array<double>")
    got: dict = {}
    for r in vectors.top_k_each(frame, asked, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == nearest([*rows, (502, [1.0])], queries, 4)


# --- words -------------------------------------------------------------------------------------------------------
def find(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def made_docs(n=60):
    rng = random.Random(6)
    return [(i, " ".join(rng.choice("Alpha beta GAMMA delta eps é1 the the a_b x".split()) for _ in range(rng.choice([0, 3, 20])))) for i in range(n)] + [(900, None), (901, "")]


def plain_bm25(docs, text):
    terms = {i: Counter(find(t)) for i, t in docs if find(t)}
    mean = sum(sum(c.values()) for c in terms.values()) / len(terms)
    df = Counter(w for c in terms.values() for w in c)
    out = {}
    for i, c in terms.items():
        s = sum(math.log(1 + (len(terms) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in set(find(text)) if c[w])
        if s:
            out[i] = round(s, 9)
    return out


@pytest.mark.parametrize("part", [100_000, 4])
def test_bm25_and_rerank(spark, monkeypatch, part, tmp_path):
    monkeypatch.setattr(lexical, "PART", part)
    docs = made_docs()
    lexical.index(spark.createDataFrame(docs, "doc_id long, text string")).write(f"file://{tmp_path}/words")
    index = lexical.InvertedIndex.read(spark, f"file://{tmp_path}/words")
    texts = [(1, "The alpha É1"), (2, "nowhere"), (3, None), (4, "beta beta x")]
    queries = spark.createDataFrame(texts, "query_id int, text string")
    got = {(r.query_id, r.rank): (r.id, pytest.approx(r.score)) for r in lexical.bm25(index, queries, 7).collect()}
    want = {}
    for q, t in texts:
        for rank, (i, s) in enumerate(sorted(plain_bm25(docs, t).items(), key=lambda x: (-x[1], x[0]))[:7], 1):
            want[q, rank] = (i, s)
    assert got == want
    candidates = spark.createDataFrame([(1, 5), (1, 6), (1, 900), (1, 7), (1, 7)], "query_id int, id long")
    best = plain_bm25(docs, "The alpha É1")
    ranked = [r.id for r in lexical.rerank(index, queries, candidates, 9).orderBy("rank").collect()]
    assert ranked == sorted([5, 6, 7, 900], key=lambda i: (-best.get(i, 0), i))


def test_a_text_is_counted_and_scored_in_one_place(spark, monkeypatch, tmp_path):
    """Postings lie with their texts, and only the best of each task are ranked."""
    monkeypatch.setattr(lexical, "TEXTS", 200, raising=False)
    docs = made_docs()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lexical.index(spark.createDataFrame(docs, "doc_id long, text string")).write(f"file://{tmp_path}/words")
        index = lexical.InvertedIndex.read(spark, f"file://{tmp_path}/words")
        places = index.postings.withColumn("file", F.input_file_name()).groupBy("id").agg(F.countDistinct("file").alias("n"))
        assert places.agg(F.max("n")).first()[0] == 1 and index.postings.select(F.input_file_name()).distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    ranked, seen = lexical._ranked, []
    monkeypatch.setattr(lexical, "_ranked", lambda scores, k: seen.append(scores.count()) or ranked(scores, k))
    lexical.bm25(index, spark.createDataFrame([(1, "the alpha"), (2, "beta")], "query_id int, text string"), 3)
    assert seen == [6]


def test_synonyms(spark):
    docs = made_docs()
    counts, pairs, total = Counter(), Counter(), 0
    for _, t in docs:
        ws = find(t)
        usable = [(i, w) for i, w in enumerate(ws) if len(w) >= 3 and w != "the"]
        counts.update(w for _, w in usable)
        total += len(usable)
        pairs.update(tuple(sorted((a, b))) for x, (i, a) in enumerate(usable) for j, b in usable[x + 1 :] if j - i <= 2 and a != b)
    want = {}
    for (a, b), n in pairs.items():
        if n >= 3 and counts[a] >= 3 and counts[b] >= 3:
            want[a, b] = want[b, a] = (n, round(math.log(n * total / (counts[a] * counts[b] * 4)), 6))
    got = {(r.word, r.synonym): (r.pairs, pytest.approx(r.pmi, abs=2e-6)) for r in lexical.synonyms(spark.createDataFrame(docs, "doc_id long, text string"), window=2, least=3, k=50, least_pmi=-9.0, stop=["the"]).collect()}
    assert got == want and got
    table_ = spark.createDataFrame([("a", "b"), ("a", "c"), ("x", "y")], "word string, synonym string")
    assert lexical.expanded(["a", "c"], table_) == ["a", "c", "b"]


def test_synonyms_of_rows_of_one_key_and_of_none(spark):
    """Rows of one key share their places, as they meet in SQL's join; rows without a key meet nothing."""
    docs = [(1, "abc def"), (1, "ghi jkl"), (2, "abc def"), (None, "abc def"), (None, "mno pqr")]
    got = {(r.word, r.synonym): r.pairs for r in lexical.synonyms(spark.createDataFrame(docs, "doc_id long, text string"), window=1, least=1, least_pmi=-9.0).collect()}
    want = {("abc", "def"): 2, ("abc", "jkl"): 1, ("ghi", "def"): 1, ("ghi", "jkl"): 1}
    assert got == want | {(b, a): n for (a, b), n in want.items()}


def test_communities_join_no_texts(spark, monkeypatch):
    """An edge's words are looked at once, where it is read; what is written and joined with communities is a flag."""
    columns, staged = [], retrieval.staged
    monkeypatch.setattr(retrieval, "staged", lambda df, name: columns.append(df.columns) or staged(df, name))
    edges = [("r1", "a", "b", "USES", 2.0, "tool word"), ("r2", "b", "c", None, 1.0, None), ("r3", "d", "e", "WORD", 5.0, ""), ("r4", "f", "f", "none", 9.0, "none"), (None, "e", "d", "x", 1.0, "word word")]
    frame = spark.createDataFrame(edges, "rel_id string, src_id string, tgt_id string, label string, weight double, keywords string")
    out = [tuple(r) for r in retrieval.global_communities(frame, ["word"], 10).collect()]
    assert out == [("community:d", 1, 2, 2, 6.0), ("community:a", 2, 3, 2, 3.0)]
    assert columns == [["src_id", "tgt_id", "weight", "hit"]]
