"""Centroid clustering: ball k-means over integer vectors, exact at every step.

A cluster is the ball around its centroid that holds its members. A centroid that is further away than twice the ball's radius can't be nearer to any
member, so only the others are neighbours; half the distances to them divide the ball into a stable core, whose members stay without a comparison, and
annuli, whose members are compared with the neighbours that reach them. All distances are squares of integers: nothing is rounded.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.session import shared_dir

DIM, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Components stay below this after scaling, so that four times a squared distance is a long.
REACH = 1 << 26
#: Vectors that are compared at once.
BLOCK = 4096


def kept_rows(column, dim: int = DIM, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, integer vectors as int32) of an Arrow list column: the rows of ``dim`` finite components, each floor(scale * x)."""
    import pyarrow as pa

    rows = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy() == dim)
    flat = column.take(pa.array(rows)).flatten()
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy().reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * x)
        good = (np.abs(x) < REACH).all(1)  # false for what is no number
    return rows[good], x[good].astype(np.int32)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows from one centroid, or from a centroid each."""
    d = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


def settle(x: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each row, of equally near ones the smaller number; ``own`` says in whose ball each row starts."""
    gap = np.stack([squares(centroids, c) for c in centroids])
    cluster, dist = own.copy(), np.zeros(len(x), np.int64)
    for i in np.unique(own):
        members = np.flatnonzero(own == i)
        d = squares(x[members], centroids[i])
        near = np.argsort(gap[i], kind="stable")
        near = near[(near != i) & (gap[i][near] <= 4 * d.max())]  # the ball's neighbours, from the nearest on
        ring = np.searchsorted(gap[i][near], 4 * d, "right")  # 0: the stable core
        best, at = d.copy(), np.full(len(members), i, own.dtype)
        for n, j in enumerate(near):
            reached = np.flatnonzero(ring > n)
            dj = squares(x[members[reached]], centroids[j])
            won = (dj < best[reached]) | ((dj == best[reached]) & (j < at[reached]))
            best[reached[won]], at[reached[won]] = dj[won], j
        cluster[members], dist[members] = at, best
    return cluster, dist


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, key: str = "vec_id") -> DataFrame:
    """(key, v, cluster, distance, n, total, inertia): the kept vectors as bytes of 32-bit integers; all start in the ball of centroid 0."""
    schema = vectors.select(key).schema.add("v", "binary").add("cluster", "integer").add("distance", "long").add("n", "long").add("total", T.ArrayType(T.LongType())).add("inertia", "long")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, x = kept_rows(batch.column(1), dim, scale)
            n = len(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), _bytes(x), pa.array(np.zeros(n, np.int32)), *_nulls(n, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())], [key, "v", "cluster", "distance", "n", "total", "inertia"])

    return vectors.select(key, "embedding").mapInArrow(run, schema)


def _bytes(x: np.ndarray):
    import pyarrow as pa

    at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 4))
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, at.buffers()[1], pa.py_buffer(np.ascontiguousarray(x))])


def _nulls(n: int, *types):
    import pyarrow as pa

    return [pa.nulls(n, t) for t in types]


def _matrix(column, dim: int) -> np.ndarray:
    """The vectors of an Arrow binary column without nulls."""
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(data, np.int32, len(column) * dim, int(first)).reshape(-1, dim) if len(column) else np.zeros((0, dim), np.int32)


def step(state: DataFrame, centroids: np.ndarray, last: bool, key: str = "vec_id") -> DataFrame:
    """Every vector in its ball, and one more row for each cluster of a batch: how many members, their sum by component and their distances' sum. The last step
    leaves the vectors away."""
    shared = state.sparkSession.sparkContext.broadcast(centroids)
    dim = centroids.shape[1]

    def run(batches):
        import pyarrow as pa

        c = shared.value
        for batch in batches:
            x, own = _matrix(batch.column(1), dim), batch.column(2).to_numpy()
            parts = [settle(x[a : a + BLOCK], own[a : a + BLOCK], c) for a in range(0, len(x), BLOCK)]
            if not parts:
                continue
            cluster, dist = (np.concatenate(p) for p in zip(*parts, strict=True))
            n = len(x)
            v = pa.nulls(n, pa.binary()) if last else _bytes(x)
            names = [key, "v", "cluster", "distance", "n", "total", "inertia"]
            yield pa.RecordBatch.from_arrays([batch.column(0), v, pa.array(cluster), pa.array(dist), *_nulls(n, pa.int64(), pa.list_(pa.int64()), pa.int64())], names)
            found = np.unique(cluster)
            total = [x[cluster == i].sum(0, dtype=np.int64).tolist() for i in found]
            sums = [pa.array([int((cluster == i).sum()) for i in found], pa.int64()), pa.array(total, pa.list_(pa.int64())), pa.array([int(dist[cluster == i].sum()) for i in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*_nulls(len(found), batch.column(0).type, pa.binary()), pa.array(found), pa.nulls(len(found), pa.int64()), *sums], names)

    return state.filter("n is null").select(key, "v", "cluster").mapInArrow(run, state.schema)


def totals(state: DataFrame, dim: int) -> dict[int, tuple[int, list[int], int]]:
    """Members, their sum and their inertia by cluster: as many rows as there are clusters reach the driver."""
    rows = state.filter("n is not null").groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(dim))).alias("total"), F.try_sum("inertia").alias("inertia"))
    return {r["cluster"]: (r["n"], r["total"], r["inertia"]) for r in rows.collect()}


def first_centroids(vectors: DataFrame, k: int, seed: int, key: str = "vec_id") -> np.ndarray:
    """The k vectors of least hash of seed and key, in that order; equal keys by their bytes."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = vectors.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([np.frombuffer(r["v"], np.int32) for r in rows], np.int64)


class _Tables:
    """State tables of the shared folder, of which only the newest two are kept: the rounds' disk doesn't add up."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/folio-balls-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        for old in self.paths:
            gone = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)
        self.paths = [path]
        return self.spark.read.schema(df.schema).parquet(path)


def ball_kmeans(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3, dim: int = DIM, scale: int = SCALE, key: str = "vec_id") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row of (key, embedding).

    Each round reads and writes the vectors once and shuffles nothing but sums of members; the vectors never meet by cluster, so a cluster of nearly all
    of them is no hot key. A round that moves no centroid ends the rounds, as all further ones would change nothing. Rows whose vector is null, of another size
    or has a null, non-finite or too large component (``REACH``) are left out; repeated rows are clustered one by one; a null key counts as an empty one; with
    fewer than k rows there are fewer centroids; an empty table gives an empty result; further columns are ignored.
    """
    spark = vectors.sparkSession
    tables = _Tables(spark)
    state = tables.write(integer_vectors(vectors, dim, scale, key))
    centroids = first_centroids(state, k, seed, key)
    names = vectors.select(key).schema.add("cluster", "integer").add("distance", "long").add("cluster_inertia", "long").add("inertia", "long").add("centroid_sha256", "string")
    if not len(centroids):
        return spark.createDataFrame([], names)
    for _ in range(rounds):
        state = tables.write(step(state, centroids, False, key))
        moved = centroids.copy()
        for i, (n, total, _) in totals(state, dim).items():
            moved[i] = [t // n for t in total]
        if (moved == centroids).all():
            break
        centroids = moved
    state = tables.write(step(state, centroids, True, key))
    found = totals(state, dim)
    whole = sum(x[2] for x in found.values()) if all(x[2] is not None for x in found.values()) else None
    digest = lambda c: hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()
    about = spark.createDataFrame([(int(i), x[2], whole if whole is not None and whole < 1 << 63 else None, digest(centroids[i])) for i, x in found.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = state.filter("n is null").select(key, "cluster", "distance").join(F.broadcast(about), "cluster")  # about has k rows
    return out.select(*names.names)


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    near = "SELECT rid, vec_id, v, arg_min(c, d * 8 + c) AS c, min(d) AS d FROM (SELECT k.rid, k.vec_id, k.v, m.c, list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT AS d FROM kept k, c{n} m) GROUP BY ALL"
    mean = """SELECT o.c, coalesce(f.v, o.v) AS v FROM c{o} o LEFT JOIN (
      SELECT c, list(q ORDER BY i) AS v FROM (SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS q FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{o}) GROUP BY c, i)) GROUP BY c
    ) f USING (c)"""
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < {CLUSTERS})",
    ]
    for r in range(ROUNDS):
        parts += [f"a{r} AS MATERIALIZED ({near.format(n=r).replace(' GROUP BY ALL', ' GROUP BY rid, vec_id, v')})", f"c{r + 1} AS MATERIALIZED ({mean.format(o=r)})"]
    parts.append(f"a{ROUNDS} AS MATERIALIZED ({near.format(n=ROUNDS).replace(' GROUP BY ALL', ' GROUP BY rid, vec_id, v')})")
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT a.vec_id, a.c::INT AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,"
        f" sha256(array_to_string(m.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} m ON m.c = a.c"
    )


OP13_SQL = _sql()
