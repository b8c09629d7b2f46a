"""Tables and indexes that change by batches: bucketed upserts, streams into them, near duplicates held against an index."""

from __future__ import annotations

import hashlib
from pathlib import Path

from folio.operators import dedup
from folio.operators.band_index import BandIndex
from folio.operators.bucketed import BucketedTable
from folio.streaming.upserts import batch_upsert, upsert_stream
from tests.test_operators import _shingles, _texts

KIND = "k long, v string, at long"


def files_of(path):
    return {str(f): hashlib.md5(f.read_bytes()).hexdigest() for f in Path(path).rglob("*.parquet") if "/data/" in str(f)}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    held = BucketedTable(spark, f"file://{tmp_path}/t", KIND, ["k"], 8)
    assert held.read().count() == 0 and held.versions() == []
    held.upsert(spark.range(200).selectExpr("id k", "'a' v", "0L at"))
    before = files_of(tmp_path)
    new = spark.createDataFrame([(3, "b", 1), (3, "c", 2), (1000, "d", 1), (None, "n", 1)], KIND)
    assert held.upsert(new, "at") == 1
    after = files_of(tmp_path)
    assert all(after[f] == h for f, h in before.items())
    touched = {int(f.split("bucket=")[1].split("/")[0]) for f in set(after) - set(before)}
    assert touched == {r.b for r in new.select(held.bucket().alias("b")).distinct().collect()} and len(touched) < 8
    want = {i: "a" for i in range(200)} | {3: "c", 1000: "d", None: "n"}
    assert {r.k: r.v for r in held.read().collect()} == want and held.read().count() == 202
    assert held.read(0).count() == 200
    # the same change again, and a null key that is replaced
    assert held.upsert(new.limit(0), version=1) == 1 and held.read().count() == 202
    held.upsert(spark.createDataFrame([(None, "m", 2)], KIND))
    assert {r.k: r.v for r in held.read().collect()} == want | {None: "m"}
    held.delete(spark.range(100).selectExpr("id k"))
    assert sorted(r.k for r in held.read().filter("k is not null").collect()) == [*range(100, 200), 1000]
    held.upsert(spark.createDataFrame([], KIND))
    rows = sorted(map(tuple, held.read().filter("k is not null").collect()))
    held.vacuum(1)
    assert sorted(map(tuple, held.read().filter("k is not null").collect())) == rows and len(held.versions()) == 1
    held.drop()
    assert held.read().count() == 0
    held.upsert(new, "at")
    assert held.read().count() == 3


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    held = BucketedTable(spark, f"file://{tmp_path}/t", KIND, ["k"], 4)
    source = str(tmp_path / "in")
    for i, rows in enumerate(([(1, "a", 1), (2, "a", 1)], [(2, "b", 2), (3, "a", 2)], [(1, "c", 0), (1, "d", 3)])):
        spark.createDataFrame(rows, KIND).write.mode("append").parquet(source)
        upsert_stream(spark.readStream.schema(KIND).parquet(source), held, str(tmp_path / "cp"), "at").awaitTermination()
        assert held.versions() == list(range(i + 1))
    want = {1: "d", 2: "b", 3: "a"}
    assert {r.k: r.v for r in held.read().collect()} == want
    files = files_of(tmp_path)
    batch_upsert(held, "at")(spark.createDataFrame([(9, "late", 9)], KIND), 2)
    assert {r.k: r.v for r in held.read().collect()} == want and files_of(tmp_path) == files
    # a batch that failed before its list of buckets was written is done anew
    (tmp_path / "t/manifest/version=2/_SUCCESS").unlink()
    assert {r.k: r.v for r in held.read().collect()} == {1: "a", 2: "b", 3: "a"}
    batch_upsert(held, "at")(spark.createDataFrame([(1, "c", 0), (1, "d", 3)], KIND), 2)
    assert {r.k: r.v for r in held.read().collect()} == want


def test_batches_keep_what_one_walk_keeps(spark, tmp_path):
    texts = _texts()
    seen: dict[str, int] = {}
    kept: list[int] = []
    for i, t in enumerate(texts):
        if t.lower() in seen:
            continue
        seen[t.lower()] = i
        x = _shingles(t)
        if not any((y := _shingles(texts[j])) and x and len(x & y) >= 0.85 * len(x | y) for j in kept):
            kept.append(i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = BandIndex(spark, f"file://{tmp_path}/bands", bands=32)
    for batch, (a, b) in enumerate(((0, 15), (15, 16), (16, 99))):
        index.add(docs.filter(f"doc_id >= {a} and doc_id < {b}"), batch)
    assert sorted(r.id for r in index.kept().collect()) == kept
    again = sorted(r.id for r in index.add(docs.filter("doc_id >= 15 and doc_id < 16"), 1).collect())
    assert again == [i for i in kept if i == 15] and sorted(r.id for r in index.kept().collect()) == kept
    index.add(spark.createDataFrame([(None, "x"), (500, None)], "doc_id long, text string"), 3)
    assert 500 not in {r.id for r in index.kept().collect()}  # an empty text was kept before


def test_candidates_hold_nine_in_ten_similar_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = {(r.id_a, r.id_b) for r in dedup.lsh_candidates(dedup.minhash(docs), dedup.text_classes(docs)).collect()}
    true = {(r.id_a, r.id_b) for r in dedup.near_dup_pairs(docs).collect()}
    assert true and len(found & true) >= 0.9 * len(true)
    copies = spark.createDataFrame([(i, "the same text of some length") for i in range(300)], "doc_id long, text string")
    assert dedup.lsh_candidates(dedup.minhash(copies), dedup.text_classes(copies)).count() == 0
