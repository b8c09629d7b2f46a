"""Functions of one row's values: few rows are Python objects at once, and all rows come back."""

from __future__ import annotations

import pyarrow as pa
import pytest

from folio import session
from folio.operators import chunking
from folio.sources import files


@pytest.mark.parametrize("made", [lambda: files.html_text, lambda: chunking._chunk_udf(chunking._prose, 500), lambda: chunking._chunk_udf(chunking._by_vectors, 500)])
def test_few_rows_are_objects_at_once(made):
    texts = ["<p>One sentence. </p>" * (i % 7) for i in range(1000)] + [None]
    out = list(made().func(iter([pa.array(texts), pa.array(texts[:3])])))
    assert sum(map(len, out)) == 1004 and max(map(len, out)) <= session.SLICE
    assert pa.concat_arrays(out)[1000:1001].to_pylist() in ([""], [[]])
