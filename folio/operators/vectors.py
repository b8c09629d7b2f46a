"""Vector store: embedding, top-k by cosine, filters and lookups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import cosine

DIM = 384
#: Vectors and queries of one group of ``top_k_each``.
VECTORS, QUERIES = 8192, 1024


def hashing_embedder(dim: int = DIM):
    """An offline stand-in for an embedding model: signed hashed word counts of unit length. Any pandas UDF of the same type can take its place."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        import zlib

        def one(t):
            v = np.zeros(dim, np.float32)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1 if h >> 31 else -1
            n = float(np.linalg.norm(v))
            return v / n if n else v

        return texts.map(one)

    return embed


def scored(vectors: DataFrame, query: Column) -> DataFrame:
    return vectors.withColumn("score", cosine(F.col("embedding"), query))


def top_k(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, at_least: float | None = None, key: str = "vec_id") -> DataFrame:
    """The k vectors nearest to the query, filtered before they are scored; ties by key."""
    rows = vectors if where is None else vectors.filter(where)
    out = scored(rows, F.array(*(F.lit(float(x)) for x in query))).filter(F.col("score").isNotNull())
    if at_least is not None:
        out = out.filter(F.col("score") >= at_least)
    return out.orderBy(F.desc(F.round("score", 9)), key).limit(k)


def at_least(vectors: DataFrame, query: list[float], least: float) -> DataFrame:
    """All vectors whose score reaches a cut-off."""
    return scored(vectors, F.array(*(F.lit(float(x)) for x in query))).filter(F.col("score") >= least)


def _unit_rows(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of an Arrow list column's rows of ``dim`` numbers that are no null and no zero vector."""
    import pyarrow as pa

    size = column.value_lengths().fill_null(-1).to_numpy()
    rows = np.flatnonzero(size == dim)
    flat = column.take(pa.array(rows)).flatten()
    v = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt((v * v).sum(1))
    good = norm > 0
    return rows[good], v[good] / norm[good, None]


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """(query_id, q) x vectors -> (query_id, key, score, rank): the k nearest vectors of each query, ties by key.

    Both sides are dealt into blocks by hash, and each pair of blocks is one group that is multiplied as matrices and keeps its k best a query before the
    shuffle; nothing passes through the driver. The work is queries times vectors, so a large set of queries goes through ``vector_index.search_exact``
    instead. Null and zero vectors and those of another size than the query match nothing.
    """
    kinds = {c: vectors.schema[key].dataType.simpleString() if c == key else queries.schema["query_id"].dataType.simpleString() for c in ("query_id", key)}
    asked = queries.select("query_id", "q").filter("size(q) > 0")
    parts, blocks = (max(1, -(-n // most)) for n, most in ((vectors.count(), VECTORS), (asked.count(), QUERIES)))
    deal = lambda c, n, name: F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias(name)
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = vectors.select(key, "embedding", deal(key, parts, "part"), each(blocks, "block"))
    right = asked.select("query_id", "q", deal("query_id", blocks, "block"), each(parts, "part"))

    def run(vs, qs):
        import pyarrow as pa

        out = []
        sizes = np.unique(qs.column("q").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)) if qs.num_rows else []
        for dim in sizes:
            rows, v = _unit_rows(vs.column("embedding").combine_chunks(), int(dim)) if vs.num_rows else (np.zeros(0, np.int64), np.zeros((0, int(dim))))
            asked, q = _unit_rows(qs.column("q").combine_chunks(), int(dim))
            keys = vs.column(key).combine_chunks().take(pa.array(rows)) if vs.num_rows else vs.column(key).slice(0, 0)
            order = np.argsort(keys.to_numpy(zero_copy_only=False), kind="stable")
            rows, v = rows[order], v[order]
            for a in range(0, len(q), 256):
                score = np.round(v @ q[a : a + 256].T, 9)
                top = np.argsort(-score, axis=0, kind="stable")[:k]  # of equal scores the least keys come first
                ids = qs.column("query_id").take(pa.array(np.repeat(asked[a : a + 256], len(top))))
                out.append(pa.table({"query_id": ids, key: vs.column(key).take(pa.array(rows[top.T.ravel()])), "score": pa.array(np.take_along_axis(score, top, 0).T.ravel())}))
        return pa.concat_tables(out) if out else pa.table({"query_id": qs.column("query_id").slice(0, 0), key: vs.column(key).slice(0, 0), "score": pa.array([], pa.float64())})

    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(run, f"query_id {kinds['query_id']}, {key} {kinds[key]}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", key, "score", "rank")
