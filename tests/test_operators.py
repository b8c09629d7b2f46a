"""Operators against plain loops and small hand-made cases."""

from __future__ import annotations

import json
import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from folio.functions.text import human_time, stem, ustrip
from folio.operators import chunking, dedup, extract, graph, nodes, notes, stats, tables, vectors
from folio.sources import config, files
from folio.streaming import ingest


def _shingles(t, k=5):
    t = t.lower()
    return {t[i : i + k] for i in range(len(t) - k + 1)}


def _texts():
    rng, out = random.Random(4), []
    for _ in range(40):
        base = rng.choice(out) if out and rng.random() < 0.6 else "".join(rng.choice("abc é🙂d") for _ in range(60))
        at = rng.randrange(max(1, len(base)))
        out.append(base[:at] + rng.choice(["", "x", "yy"]) + base[at + 1 :])
    return [*out, "", "abc", "ABC", "abcd", "same text here", "Same Text HERE"]


def test_near_duplicates_and_greedy_walk(spark, monkeypatch):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t.lower(), i)
    assert {(r.id, r.class_id) for r in dedup.text_classes(docs).collect()} == {(i, first[t.lower()]) for i, t in enumerate(texts)}
    want = set()
    for i in sorted(first.values()):
        for j in sorted(first.values()):
            x, y = _shingles(texts[i]), _shingles(texts[j])
            if i < j and x and y and len(x & y) >= 0.85 * len(x | y):
                want.add((i, j))
    monkeypatch.setattr(dedup, "BUCKET", 3)
    assert {(r.id_a, r.id_b) for r in dedup.near_dup_pairs(docs).collect()} == want
    kept: list[int] = []
    for j, t in enumerate(texts):
        if first[t.lower()] == j and not any((i, j) in want for i in kept):
            kept.append(j)
    stays = dedup.greedy(docs)
    assert sorted(r.id for r in stays.collect()) == kept
    assert dedup.dedup_stats(docs.select(F.col("doc_id").alias("id")), stays).first().n_removed == len(texts) - len(kept)


def test_minhash_is_the_least_of_each_map(spark):
    texts = ["some text here", "some text here!", "abc", "", "é🙂bcdé🙂bcd"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashed = {r.id: r.s for r in dedup.shingle_sets(docs).collect()}
    rng = np.random.default_rng(1)
    a, b = [int(x) | 1 for x in rng.integers(1, 1 << 61, dedup.PERMS, dtype=np.uint64)], [int(x) for x in rng.integers(0, 1 << 61, dedup.PERMS, dtype=np.uint64)]
    for r in dedup.minhash(docs).collect():
        want = [min((((h % 2**64) * x + y) % 2**64) >> 1 for h in hashed[r.id]) for x, y in zip(a, b, strict=True)] if hashed[r.id] else []
        assert (r.n, r.signature) == (len(hashed[r.id]), want)


def test_first_of_each_text(spark):
    rows = [(3, "a", None), (1, "a", 2), (2, None, 1), (5, None, 1), (4, "", 0)]
    got = dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, x int")).collect()
    assert sorted(tuple(r) for r in got) == [(1, "a", 2), (2, None, 1), (4, "", 0)]


def test_shingles_of_any_signs(spark):
    texts = ["aé🙂bcd🙂🙂e", "", "abcd", "\n\n\n\n\n\n", "ABCDEF"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", dedup.shingles(F.col("t")).alias("s")).collect()
    for r in rows:
        assert set(r.s) == _shingles(r.t) and len(r.s) == len(set(r.s))


def test_chain_keeps_both_ends(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "id_a long, id_b long")
    assert sorted(r.id for r in dedup.keep_first(ids, pairs).collect()) == [1, 3]


def test_split_text_keeps_everything():
    text = "One. Two three!\n\nFour " * 200 + "x" * 4000
    parts = chunking.split_text(text, 500)
    assert "".join(parts) == text and max(map(len, parts)) <= 500


def test_software_chunks_take_back_their_code():
    out = chunking._software("before\n```python\na = 1\n```\nafter\n    b = 2\n", 1500)
    assert [c["code_blocks"] for c in out] == [["a = 1", "b = 2"]] and "[CODE" not in out[0]["text"]


def test_text_functions(spark):
    row = spark.createDataFrame([("C:\\x\\b.c.pdf", "\u2003 a \n")], "p string, t string").select(stem(F.col("p")).alias("s"), ustrip(F.col("t")).alias("t")).first()
    assert (row.s, row.t) == ("b.c", "a")


def test_communities(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("z", "z")], "src_id string, tgt_id string")
    assert {r.id: r.community for r in graph.communities(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}


def test_note_rebuild_leaves_no_stale_link(spark):
    kind = "path string, content string"
    one = notes.relations(notes.parse(spark.createDataFrame([("x.md", "# Concept X\n[[ALPHA]]")], kind)))
    two = notes.relations(notes.parse(spark.createDataFrame([("x.md", "# Concept X\n[[BETA]]")], kind)))
    book = one.withColumn("source_type", F.lit("book"))
    out = notes.rebuild(one.unionByName(book), two).collect()
    assert sorted((r.source_type, r.tgt_id) for r in out) == [("book", "ALPHA"), ("note", "BETA")]


def test_merge_keeps_old_fields(spark):
    kind = "doc_id long, status string, n int"
    out = tables.merge(spark.createDataFrame([(1, "pending", 3)], kind), spark.createDataFrame([(1, "done", None), (2, "new", 1)], kind), ["doc_id"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, "done", 3), (2, "new", 1)]


def test_files(spark, tmp_path):
    for name in ("a.pdf", "b.EPUB", "c.txt", "sub/d.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"bad" if name == "a.pdf" else b"text")
    found = files.discover(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["a.pdf", "b.EPUB", "d.pdf"]

    def pdf(content):
        if content == b"bad":
            raise ValueError("broken")
        return content.decode()

    out = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.extract(files.contents(spark, str(tmp_path)), {"pdf": pdf}).collect()}
    assert out["d.pdf"] == ("text", None) and out["a.pdf"] == ("", "ValueError: broken") and out["b.EPUB"][0] == ""


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("max_chars: 900 # short\nother: 1\n")
    got = config.load(str(tmp_path / "c.yaml"), {"FOLIO_NUM_PERM": "64"}, shingle_k=7)
    assert (got.max_chars, got.num_perm, got.shingle_k, got.dedup_threshold) == (900, 64, 7, 0.85)


def test_streaming_ingest_is_incremental(spark, tmp_path):
    kind = "doc_id long, text string, source_path string, ts timestamp"
    add = lambda i: spark.createDataFrame([(i, "some prose text", f"x/{i}.pdf", None)], kind).withColumn("ts", F.current_timestamp()).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for i in (1, 2):
        add(i)
        ingest.ingest(ingest.documents_stream(spark, str(tmp_path / "in")), out, str(tmp_path / "cp")).awaitTermination()
        assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == list(range(1, i + 1))


def test_minhash_of_parts_is_that_of_the_whole(spark):
    """Shingles are mapped a part at a time: texts of just under, just as many and more shingles than a part have the least of all maps."""
    sizes = [dedup.MAPPED - 1, dedup.MAPPED, dedup.MAPPED + 1, 3 * dedup.MAPPED + 7]
    docs = spark.createDataFrame([(i, "".join(chr(0x4E00 + j) for j in range(n + dedup.K - 1))) for i, n in enumerate(sizes)], "doc_id long, text string")
    sets = {r.id: np.array(r.s, np.int64).view(np.uint64) for r in dedup.shingle_sets(docs).collect()}
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 1 << 61, dedup.PERMS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 61, dedup.PERMS, dtype=np.uint64)
    for r in dedup.minhash(docs).collect():
        assert r.n == len(sets[r.id]) == sizes[r.id]
        with np.errstate(over="ignore"):
            assert r.signature == ((sets[r.id][:, None] * a + b) >> np.uint64(1)).min(0).astype(np.int64).tolist()


def test_lsh_candidates_are_all_band_collisions(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BUCKET", 3, raising=False)
    rng, width = np.random.default_rng(2), dedup.PERMS // dedup.BANDS
    # each band has one of few values, so buckets are large and a bucket's head is not alike to all of its members in other bands
    bands = {i: rng.integers(0, 6, dedup.BANDS).tolist() for i in range(40)} | {50: [7] * dedup.BANDS, 51: [7] * dedup.BANDS, 52: [7] * dedup.BANDS}
    rows = [(i, 1, [v for v in b for _ in range(width)]) for i, b in bands.items()] + [(60, 0, [])]
    got = [tuple(r) for r in dedup.lsh_candidates(spark.createDataFrame(rows, "id long, n int, signature array<long>")).collect()]
    want = {(i, j) for i in bands for j in bands if i < j and any(x == y for x, y in zip(bands[i], bands[j], strict=True))}
    assert len(got) == len(set(got)) and set(got) == want


def test_rounding_is_that_of_the_binary_number(spark):
    rng = random.Random(3)
    values = [36.535, 0.125, 0.375, 2.675, 1.005, 0.0, 0.005, 0.015, 490.02, 1e-9, *(rng.randrange(100_000) / 1000 for _ in range(3000)), *(rng.random() * 500 for _ in range(1000))]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", stats.rounded(F.col("x")).alias("r")).collect()
    assert [(r.x, r.r) for r in got if r.r != round(r.x, 2)] == []


def test_summary_of_conditions(spark):
    rng = random.Random(5)
    rows = [(c, rng.choice([rng.random() * 9, 2.5, 7.0]), rng.randrange(99), rng.randrange(9), rng.randrange(5), c != "none" and rng.random() < 0.9) for c in ("a", "b", "none") for _ in range(rng.choice([40, 41]))]
    calls = spark.createDataFrame(rows, "condition string, seconds double, gen_tokens int, entities int, relations int, ok boolean")
    for r in stats.condition_summary(calls).collect():
        good = [x for x in rows if x[0] == r.condition and x[5]]
        s = sorted(x[1] for x in good)
        assert (r.n, r.failures) == (len(s), sum(x[0] == r.condition for x in rows) - len(s))
        if s:
            assert (r.median_s, r.p90_s, r.min_s, r.max_s) == tuple(round(x, 2) for x in (statistics.median(s), s[int(len(s) * 0.9) - 1], s[0], s[-1]))
            assert (r.median_tokens, r.median_entities, r.median_relations) == tuple(int(statistics.median(x[i] for x in good)) for i in (2, 3, 4)) and r.note is None
        else:
            assert r.note == "no successful calls" and r.median_s is None


def test_human_time(spark):
    got = spark.createDataFrame([(3600.0,), (47.9 * 3600,), (48.0 * 3600,), (86400 * 13.47,)], "s double").select(human_time(F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == ["1.0 hours", "47.9 hours", "2.0 days", "13.5 days"]


def test_upsert_takes_the_latest_of_repeated_keys(spark):
    kind = "k long, v string, at int"
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], kind)
    new = spark.createDataFrame([(2, "x", 5), (2, "y", 3), (3, "z", 1), (3, "z", 1)], kind)
    assert sorted(tuple(r) for r in tables.upsert(old, new, ["k"], "at").collect()) == [(1, "a", 0), (2, "x", 5), (3, "z", 1)]
    assert tables.merge(old, new, ["k"], "at").count() == 3
    assert tables.is_empty(tables.reset(old)).first().is_empty and not tables.is_empty(old).first().is_empty


def test_gleaning_keeps_what_only_one_pass_found(spark):
    kind = "id long, entities array<struct<name: string, type: string>>, relations array<struct<source: string, target: string, type: string>>"
    one = spark.createDataFrame([(1, [("A", "t")], []), (2, [("B", "t")], [])], kind)
    two = spark.createDataFrame([(1, [("A", "t"), ("C", "t")], [("A", "C", "r")]), (3, [("D", "t")], [])], kind)
    got = {r.id: ([e.name for e in r.entities], len(r.relations)) for r in extract.glean(one, two).collect()}
    assert got == {1: (["A", "C"], 1), 2: (["B"], 0), 3: (["D"], 0)}
    assert extract.no_triples(one.select("id")).count() == 0


def test_nearest_vectors_of_each_query(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES", 2)  # several blocks
    monkeypatch.setattr(vectors, "VECTORS", 9)
    rng = np.random.default_rng(1)
    held = {i: rng.normal(size=4).round(1).tolist() for i in range(30)} | {40: None, 41: [0.0] * 4, 42: [1.0, 2.0]} | {50: [1.0, 0.0, 0.0, 0.0], 51: [2.0, 0.0, 0.0, 0.0]}
    asked = {1: [1.0, 0.0, 0.0, 0.0], 2: [0.3, -1.0, 2.0, 0.1], 3: [2.0, 1.0], 4: [0.0] * 4, 5: [0.1, 0.2, 0.3, 0.4]}
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = set()
    for q, v in asked.items():
        scored = sorted((-round(cos(x, v), 9), i) for i, x in held.items() if x and len(x) == len(v) and any(x) and any(v))
        want |= {(q, i, r) for r, (_, i) in enumerate(scored[:3], 1)}
    got = vectors.top_k_each(spark.createDataFrame(list(held.items()), "vec_id long, embedding array<float>"), spark.createDataFrame(list(asked.items()), "query_id long, q array<double>"), 3)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got.collect()} == want


def test_chunks_that_are_alike_are_merged(spark):
    chunks = spark.createDataFrame([("a", i, f"t{i}") for i in range(4)], "ref string, chunk_idx int, text string")
    held = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [1.0, 0.1]), ("a", 2, [0.0, 1.0]), ("a", 3, [0.1, 1.0])], "ref string, chunk_idx int, embedding array<float>")
    assert sorted((r.chunk_idx, r.text) for r in chunking.merge_similar(chunks, held).collect()) == [(0, "t0\nt1"), (2, "t2\nt3")]


def test_chapters_make_a_book(spark):
    rows = [("b", 2, "two"), ("b", 1, "one"), ("b", 3, "  "), ("c", 1, "")]
    assert [tuple(r) for r in files.join_chapters(spark.createDataFrame(rows, "path string, ord int, text string")).collect()] == [("b", "one\n\ntwo")]


def test_checkpoints_reports_and_graphs(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("c1", "b1", "p", 0, "math", "t", [], False)], files.CHUNKS)

    for _ in range(2):
        assert files.checkpoint_or(spark, str(tmp_path / "cp"), build).first().chunk_id == "c1"
    assert len(calls) == 1
    (tmp_path / "old.json").write_text(json.dumps([{"text": "t", "source_path": "p", "content_type": "math", "metadata": {"has_code": True}, "code_blocks": ["x"]}, {"text": "u", "source_path": "p", "content_type": "math", "code_blocks": []}]))
    got = files.read_json_checkpoint(spark, str(tmp_path / "old.json")).collect()
    assert [(r.text, r.metadata and r.metadata.has_code, r.code_blocks) for r in got] == [("t", True, ["x"]), ("u", None, [])]
    files.write_report(spark.createDataFrame([("a", 1)], "name string, n int"), str(tmp_path / "report"))
    assert [json.loads(line) for f in (tmp_path / "report").glob("part*") for line in f.read_text().splitlines()] == [{"name": "a", "n": 1}]


def test_notes_and_nodes_from_files(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.md").write_text("# Concept A\n[[B]]\n")
    assert [r.title for r in notes.parse(files.read_notes(spark, str(tmp_path / "n"))).collect()] == ["Concept A"]
    rows = lambda kind, text: spark.createDataFrame([(f"{kind}1", text, kind)], "node_id string, text string, source_type string")
    nodes.write_nodes(rows("book", "x").unionByName(rows("note", "y")), str(tmp_path / "nodes"))
    nodes.write_nodes(rows("note", "z"), str(tmp_path / "nodes"))  # only its own namespace is written anew
    assert sorted((r.source_type, r.text) for r in spark.read.parquet(str(tmp_path / "nodes")).collect()) == [("book", "x"), ("note", "z")]


def test_local_retrieval_asks_for_few_degrees(spark, monkeypatch):
    """Degrees are joined to the edges that can be among the best alone."""
    from folio.operators import retrieval

    nodes = spark.createDataFrame([(f"n{i}", f"Thing {i}") for i in range(40)], "id string, entity_name string")
    rows = [(f"n{i}___n{j}", f"n{i}", f"n{j}", float((7 * i + j) % 10)) for i in range(40) for j in range(i, 40)]
    edges = spark.createDataFrame(rows, "rel_id string, src_id string, tgt_id string, weight double")
    join, seen = retrieval.edge_degrees, []
    monkeypatch.setattr(retrieval, "edge_degrees", lambda e, of, d: seen.append(of.count()) or join(e, of, d))
    got = [r.item for r in retrieval.local(nodes, edges, ["thing"], 5).orderBy("rank").collect()]
    degree = {f"n{i}": 40 for i in range(40)}  # each node meets all and itself, a loop once
    best = sorted(rows, key=lambda r: (-2, -r[3], -degree[r[1]] - degree[r[2]], r[0]))[:5]
    assert got == ["edge:" + r[0] for r in best]
    assert seen[0] == sum(r[3] == 9 for r in rows)
