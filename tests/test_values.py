"""Values of queries that have no SQL, against plain loops over the fixture."""

from __future__ import annotations

import re
import zlib

import numpy as np

from folio.operators import classify
from folio.plans import catalog
from folio.plans.views import documents
from folio.session import table
from tests.comparing import TABLES

SF = f"{TABLES}/sf0.001"


def test_triples_are_neighbouring_names(spark):
    want = set()
    for r in table(spark, SF, "documents").select("doc_id", "text").collect():
        found = []
        for sentence in re.split(r"(?<=[.!?])\s+", r.text or ""):
            names = [w for w in re.findall(r"\w+", sentence) if w[0].isalpha() and w[0].isupper()]
            found += [(a, b) for a, b in zip(names, names[1:], strict=False) if a != b]
        want |= {(str(r.doc_id), a, "RELATES_TO", b, i) for i, (a, b) in enumerate(found[:10])}
    got = {tuple(r) for r in catalog.QUERIES["extract_triples"](spark, SF).select("id", "source", "label", "target", "pos").collect()}
    assert got == want and len(got) > 50


def test_embeddings_are_signed_word_counts(spark):
    texts = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    for r in catalog.QUERIES["embed_texts"](spark, SF).collect():
        v = np.zeros(384)
        for w in texts[r.item_id].lower().split():
            h = zlib.crc32(w.encode())
            v[h % 384] += 1 if h >= 1 << 31 else -1
        assert np.allclose(r.embedding, v / np.linalg.norm(v), atol=1e-6)


def test_each_document_has_its_routes_chunks(spark):
    """What one pass gives is what the chunker of each document's route gives."""
    route = {r.doc_id: r.route for r in classify.route(documents(spark, SF)).select("doc_id", "route").collect()}
    by_route = {"software": "chunk_software", "math": "chunk_math", "selfhelp": "chunk_prose"}
    want = set()
    for name, query in by_route.items():
        want |= {(r.doc_id, r.chunk_idx, r.text, tuple(r.code_blocks), name) for r in catalog.QUERIES[query](spark, SF).collect() if route[r.doc_id] == name}
    got = {(r.doc_id, r.chunk_idx, r.text, tuple(r.code_blocks), r.route) for r in catalog.QUERIES["chunk_all"](spark, SF).collect()}
    assert got == want and {x[4] for x in got} == set(by_route)
