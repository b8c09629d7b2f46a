"""Fuzzy names, cheapest chunks and transitions as a stream, against plain loops."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import numpy as np
import pytest

from folio.operators import chunking, extract, tables
from folio.plans import views
from folio.streaming.transitions import invalid_transitions_stream
from tests.comparing import TABLES


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def resolved(names):
    """Components of similar names by all pairs."""
    names = sorted(set(names))
    at = {n: n for n in names}

    def top(n):
        while at[n] != n:
            n = at[n]
        return n

    digits = {n: "".join(c for c in n if c in "0123456789") for n in names}
    for a, b in itertools.combinations(names, 2):
        most = min(len(a), len(b)) // 5
        if most and digits[a] == digits[b] and abs(len(a) - len(b)) <= most and edits(a, b) <= most:
            x, y = sorted((top(a), top(b)))
            at[y] = x
    return {n: top(n) for n in names}


def test_names_of_the_tables(spark):
    nodes = views.graph_nodes(spark, f"{TABLES}/sf0.001")
    got = {r.name: r.entity for r in extract.resolve_fuzzy(nodes).collect()}
    assert got == resolved(got) and any(a != b for a, b in got.items())


def test_misspelt_names(spark, monkeypatch):
    monkeypatch.setattr(extract, "BUCKET", 3)
    rng = random.Random(1)
    base = ["apache spark", "jean-françois", "new york city", "abcabcabcabcabc", "aaaaaaaaaa", "node 12345", "node 12346", "tiny", "é🙂x"]
    names = list(base)
    for n in base * 6:
        i = rng.randrange(len(n))
        names.append(rng.choice([n[:i] + n[i + 1 :], n[:i] + rng.choice("xyz") + n[i:], n[:i] + rng.choice("xyz") + n[i + 1 :]]))
    frame = spark.createDataFrame([(str(i), f" {n.upper() if i % 2 else n} ") for i, n in enumerate(names)] + [("null", None), ("empty", "")], "id string, entity_name string")
    rows = extract.resolve_fuzzy(frame).collect()
    want = resolved([r.name for r in rows])
    assert {r.name: r.entity for r in rows} == want
    held = {}
    for i, n in enumerate(names):
        held.setdefault(want[n.upper().lower().strip() if i % 2 else n.strip()], []).append(str(i))
    assert all((r.n, r.id) == (len(held[r.entity]), min(held[r.entity])) for r in rows if r.name)


def cost_of(v, ends, cost):
    out, a = 0.0, 0
    for b in ends:
        seg = v[a:b]
        out += cost + ((seg - seg.mean(0)) ** 2).sum()
        a = b
    return out


@pytest.mark.parametrize("seed", range(6))
def test_cheapest_division(seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 1, (9, 3)) + np.repeat(rng.normal(0, 2, (3, 3)), 3, 0)
    v[4] = 0
    size = rng.integers(5, 60, 9)
    ends, cost = chunking.segmented(v, size, 120, 1.5)
    best = min(
        cost_of(v, (*cut, 9), 1.5)
        for k in range(9)
        for cut in itertools.combinations(range(1, 9), k)
        if all(b - a == 1 or size[a:b].sum() <= 120 for a, b in zip((0, *cut), (*cut, 9), strict=True))
    )
    assert cost == pytest.approx(best) and cost_of(v, ends, 1.5) == pytest.approx(best) and ends[-1] == 9
    assert all(b - a == 1 or size[a:b].sum() <= 120 for a, b in zip([0, *ends], ends, strict=False))


def test_chunks_by_vectors(spark):
    one, two = "Cats purr and cats sleep. Cats eat. ", "Rust owns memory. Rust borrows memory. Rust is fast.\n"
    texts = [one + two, "", None, "word " * 2000, "  \n\n ", "no end"]
    rows = chunking.chunk_vectors(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 300).orderBy("doc_id", "chunk_idx").collect()
    held = {i: [r.text for r in rows if r.doc_id == i] for i in range(6)}
    assert held[1] == held[2] == held[4] == [] and held[5] == ["no end"]
    assert all(0 < len(r.text) <= 300 for r in rows)
    assert all("".join(held[i]).replace(" ", "") == texts[i].replace(" ", "").replace("\n", "") for i in (0, 3, 5))
    assert any("Cats" in c and "Rust" not in c for c in held[0])


START = dt.datetime(2024, 1, 1)
KIND = "doc_id long, seq long, status string, ts timestamp"


def history(n=120):
    rng = random.Random(5)
    return [(rng.randrange(6), i, rng.choice(["pending", "processing", "processed", "failed"]), START + dt.timedelta(seconds=10 * i)) for i in range(n)]


@pytest.mark.parametrize("cuts,mixed", [([120], False), ([30, 31, 90, 120], False), ([40, 80, 120], True)])
def test_transitions_in_any_split(spark, tmp_path, cuts, mixed):
    rows = history()
    want = sorted(map(tuple, tables.invalid_transitions(spark.createDataFrame(rows, KIND)).select("doc_id", "seq", "before", "status").collect()))
    sent = list(rows)
    if mixed:  # neighbours within a minute change places, across batches as well
        rng = random.Random(3)
        sent.sort(key=lambda r: r[1] + rng.uniform(0, 5))
    a = 0
    for i, b in enumerate([*cuts, None]):
        part = sent[a:b] if b is not None else [(99, 999, "pending", START + dt.timedelta(days=9))]  # the watermark passes all others
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = invalid_transitions_stream(spark.readStream.schema(KIND).parquet(f"{tmp_path}/in"), "2 minutes" if mixed else "0 seconds")
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        a = b
        assert i >= 0
    got = sorted(map(tuple, spark.read.schema("doc_id long, seq long, before string, status string").parquet(f"{tmp_path}/out").collect()))
    assert got == want and want


def test_rows_of_a_document_are_kept_in_one_call():
    """The state store is asked once for a document's rows, however many there are."""
    from types import SimpleNamespace

    import pandas as pd

    from folio.streaming.transitions import Transitions

    calls = []
    p = Transitions()
    p.handle = SimpleNamespace(registerTimer=lambda t: calls.append(("timer", t)))
    p.waiting = SimpleNamespace(appendList=lambda rows: calls.append(("list", len(rows))), appendValue=lambda r: calls.append(("value", r)))
    rows = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:00:02", "2024-01-01 00:00:01", "2024-01-01 00:00:03"]), "seq": [2, 1, 3], "status": ["a", "b", "c"]})
    list(p.handleInputRows((1,), iter([rows, rows]), None))
    assert calls == [("list", 6), ("timer", 1704067201000)]
