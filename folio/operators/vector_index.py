"""Nearest vectors through an inverted-file index: k-means cells, residuals of one byte a number, approximate and exact search.

A cell holds the vectors nearest to its centroid. Of each the index keeps the residual to the centroid, each number rounded to one of 256 steps, how
long the residual is and how much the rounding took off. An approximate search looks into the cells nearest to a query; an exact one looks into every cell that
could still hold a better vector than those found there, as its centroid and radius tell. Both score what they find again with the vectors themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.text import cosine
from folio.operators.vectors import _unit_rows
from folio.session import staged

#: Numbers of the vectors on which cells are learned, cells at most, and rounds of learning.
SAMPLE_NUMBERS, MAX_CELLS, ROUNDS = 1 << 22, 4096, 8
#: Vectors of a part of a cell; vectors and queries that one task compares.
PART, SHARE, ASKED = 4096, 65536, 8192
#: A score that any vector reaches; scores that differ by less may be equal to nine digits.
ANY, TIE = -2.0, 1e-8
#: Candidates of a query that are scored again, for each one that is asked for.
REFINE = 4
STEPS = 255


@dataclass
class Index:
    """``rows``: (key, cell, part, code, norm, err), written; ``cells``: (cell, n, parts, radius, err) of all cells with vectors, ``MAX_CELLS`` rows at most."""

    centroids: np.ndarray
    low: np.ndarray
    step: np.ndarray
    rows: DataFrame
    cells: DataFrame
    key: str

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def write(self, path: str) -> None:
        """Two tables at ``path``: the codes, in files by cell so that a search reads few, and the cells with the centroids and steps."""
        spark = self.rows.sparkSession
        about = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(self.centroids)], "cell int, centroid array<double>")
        about = about.join(self.cells, "cell", "left").withColumn("low", F.array(*(F.lit(float(x)) for x in self.low))).withColumn("step", F.array(*(F.lit(float(x)) for x in self.step)))
        about.coalesce(1).write.parquet(f"{path}/cells")
        self.rows.repartitionByRange("cell").sortWithinPartitions("cell", "part").write.parquet(f"{path}/rows")

    @classmethod
    def read(cls, spark: SparkSession, path: str, key: str = "vec_id") -> Index:
        cells = spark.read.parquet(f"{path}/cells")
        about = cells.orderBy("cell").select("centroid", "low", "step").collect()  # MAX_CELLS rows at most
        low, step = (np.array(about[0][c]) for c in ("low", "step"))
        return cls(np.array([r.centroid for r in about]), low, step, spark.read.parquet(f"{path}/rows"), cells.filter("n is not null").select("cell", "n", "parts", "radius", "err"), key)


def _units(column, dim: int):
    import pyarrow as pa

    rows, v = _unit_rows(column, dim)
    return pa.array(rows), v


def learn_cells(vectors: DataFrame, dim: int, cells: int, key: str, rounds: int = ROUNDS, seed: int = 1) -> tuple[np.ndarray, DataFrame]:
    """Centroids of ``cells`` cells and the sample they are learned on: the vectors of least key hash, SAMPLE_NUMBERS numbers at most.

    Each round's tasks add their vectors up by nearest centroid; only the sums reach the driver. A cell without vectors keeps its centroid.
    """
    spark = vectors.sparkSession
    chosen = vectors.select(key, "embedding").orderBy(F.xxhash64(key, F.lit(seed)), key).limit(max(1, SAMPLE_NUMBERS // dim))
    sample = staged(chosen, "cells-sample")

    first = sample.orderBy(F.xxhash64(F.lit(seed), key), key).limit(4 * cells).select("embedding").toArrow()
    v = np.unique(_units(first.column(0).combine_chunks() if first.num_rows else first.column(0), dim)[1], axis=0) if first.num_rows else np.zeros((0, dim))
    centroids = v[np.linspace(0, len(v) - 1, min(cells, len(v))).astype(int)] if len(v) else np.zeros((0, dim))
    for _ in range(rounds if len(centroids) else 0):
        shared = spark.sparkContext.broadcast(centroids)

        def run(batches, shared=shared):
            import pyarrow as pa

            c = shared.value
            total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
            for batch in batches:
                _, v = _units(batch.column(0), dim)
                near = nearest(v, c)
                np.add.at(total, near, v)
                n += np.bincount(near, minlength=len(c))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.float64()))], ["cell", "n", "total"])

        sums = sample.select("embedding").mapInArrow(run, "cell int, n long, total array<double>").groupBy("cell").agg(*(F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dim)))
        centroids = centroids.copy()
        for r in sums.collect():
            c = np.array(r[1:])
            length = np.linalg.norm(c)
            if length > 0:
                centroids[r["cell"]] = c / length
    return centroids, sample


def nearest(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(v @ centroids.T, 1).astype(np.int64) if len(v) else np.zeros(0, np.int64)


def build(vectors: DataFrame, dim: int, key: str = "vec_id", cells: int | None = None) -> Index:
    """The index of (key, embedding). Null and zero vectors and those of another size are left out; by default there are as many cells as the square root of the rows."""
    spark = vectors.sparkSession
    if cells is None:
        cells = min(MAX_CELLS, int(np.ceil(np.sqrt(max(1, vectors.count())))))
    centroids, sample = learn_cells(vectors, dim, cells, key)
    if not len(centroids):
        centroids = np.zeros((1, dim))
    shared = spark.sparkContext.broadcast(centroids)

    def ranges(batches):
        import pyarrow as pa

        low, high = np.full(dim, np.inf), np.full(dim, -np.inf)
        for batch in batches:
            _, v = _units(batch.column(0), dim)
            if len(v):
                r = v - shared.value[nearest(v, shared.value)]
                low, high = np.minimum(low, r.min(0)), np.maximum(high, r.max(0))
        if np.isfinite(low).all():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(low), pa.array(high)], ["d", "low", "high"])

    bounds = sample.select("embedding").mapInArrow(ranges, "d long, low double, high double").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
    low = np.array([b.low for b in bounds]) if bounds else np.zeros(dim)
    step = np.maximum(np.array([b.high for b in bounds]) - low, 1e-9) / STEPS if bounds else np.full(dim, 1e-9)
    kind = vectors.schema[key].dataType.simpleString()

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            rows, v = _units(batch.column(1), dim)
            cell = nearest(v, shared.value)
            r = v - shared.value[cell]
            code = np.clip(np.rint((r - low) / step), 0, STEPS).astype(np.uint8)
            err = np.sqrt(((r - (low + code * step)) ** 2).sum(1))  # also what a residual outside the sample's range loses
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(np.sqrt((r * r).sum(1))), pa.array(err)], [key, "cell", "code", "norm", "err"])

    coded = staged(vectors.select(key, "embedding").mapInArrow(encode, f"{key} {kind}, cell int, code binary, norm double, err double"), "codes")
    found = coded.groupBy("cell").agg(F.count("*").alias("n"), F.ceil(F.count("*") / PART).alias("parts"), F.max("norm").alias("radius"), F.max("err").alias("err"))
    found = staged(found, "cells")
    rows = coded.join(F.broadcast(found.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64(key), "parts").cast("int")).drop("parts")  # MAX_CELLS rows at most
    return Index(centroids, low, step, rows, found, key)


def _cell_table(index: Index) -> dict:
    """Radius and error of each cell on the driver: MAX_CELLS rows at most."""
    n, radius, err = np.zeros(len(index.centroids), np.int64), np.zeros(len(index.centroids)), np.zeros(len(index.centroids))
    for r in index.cells.collect():
        n[r.cell], radius[r.cell], err[r.cell] = r.n, r.radius, r.err
    return {"centroids": index.centroids, "n": n, "radius": radius, "err": err}


def _placed(index: Index, queries: DataFrame, probes: int | None) -> DataFrame:
    """(query_id, q, least, reach, block) of queries (query_id, q, least): q of unit length, ``reach`` what its ``probes``-th nearest cell's centroid scores (any if None).

    Queries are put into blocks by their nearest cells, so that a block asks for few others; only the cells' counts reach the driver.
    """
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(_cell_table(index))
    dim, kind = index.dim, queries.schema["query_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        m = shared.value
        live = np.flatnonzero(m["n"] > 0)
        for batch in batches:
            rows, q = _units(batch.column(1), dim)
            least = batch.column(2).take(rows).fill_null(ANY).to_numpy(zero_copy_only=False)
            for a in range(0, len(q) if len(live) else 0, 512):
                part = q[a : a + 512].astype(np.float32)
                score = part.astype(np.float64) @ m["centroids"][live].T
                n = min(probes or len(live), len(live))
                reach = np.full(len(part), ANY) if probes is None else -np.partition(-score, n - 1, 1)[:, n - 1]
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * dim, pa.int32()), pa.array(part.ravel()))
                ids = batch.column(0).take(rows).slice(a, len(part))
                yield pa.RecordBatch.from_arrays([ids, vectors, pa.array(least[a : a + 512]), pa.array(reach), pa.array(live[np.argmax(score, 1)])], ["query_id", "q", "least", "reach", "home"])

    placed = staged(queries.select("query_id", "q", "least").mapInArrow(run, f"query_id {kind}, q array<float>, least double, reach double, home long"), "placed")
    homes = _counted(placed.groupBy("home").agg(F.count("*").alias("n")), "home")
    block = F.floor((F.col("before") + F.pmod(F.xxhash64("query_id"), "n")) / ASKED)
    return placed.join(F.broadcast(homes), "home").select("query_id", "q", "least", "reach", block.alias("block"))  # a row a cell


def _counted(cells: DataFrame, cell: str) -> DataFrame:
    """With ``before``, the rows of all lesser cells: MAX_CELLS rows at most, in one task."""
    return cells.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _asks(near, radius, least, reach):
    """Which cells (columns) a query (row) looks into: those as near as its last probe, of which a vector can score what it must."""
    return (near >= reach[:, None] - 1e-9) & (near + radius >= least[:, None] - 1e-6)


def _tightened(row, at, score, err, cut, most):
    """What can still be one of the ``most`` best of its row, and the rows' new cuts: what their ``most`` best score for sure."""
    order = np.lexsort((err - score, row))
    row, at, score, err = row[order], at[order], score[order], err[order]
    first = np.searchsorted(row, np.arange(len(cut)))
    last = first + most - 1
    full = np.append(first[1:], len(row)) > last
    cut[full] = np.maximum(cut[full], (score - err)[last[full]])
    keep = score + err >= cut[row] - TIE
    return row[keep], at[keep], score[keep], err[keep]


def _best_of(q, v, err, cells, ask, least, most):
    """(row of q, row of v, score, err) of all that can be one of a query's ``most`` best here and can score its ``least``; v lies in order of cells."""
    cut = np.where(least > ANY, least, -np.inf)
    row, at, score, off = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64), np.zeros(0, np.float64)
    held, waiting = [], 0
    ends = np.append(np.flatnonzero(np.diff(cells)) + 1, len(cells))
    start = 0
    for j, end in enumerate(ends.tolist()):
        rows = np.flatnonzero(ask[:, j])
        e = err[start:end]
        for a in range(0, len(rows), 1024):
            r = rows[a : a + 1024]
            s = q[r] @ v[start:end].T
            fresh = np.flatnonzero(np.isneginf(cut[r])) if end - start >= most else ()
            if len(fresh):
                cut[r[fresh]] = -np.partition((e - s[fresh]), most - 1, 1)[:, most - 1]
            i, c = np.nonzero(s + e >= (cut[r] - TIE)[:, None])
            held.append((r[i], start + c, s[i, c].astype(np.float64), err[start + c]))
            waiting += len(i)
        start = end
        if waiting > 4 * most * len(q) + (1 << 16) or end == len(cells):
            row, at, score, off = _tightened(*map(np.concatenate, zip((row, at, score, off), *held, strict=True)), cut, most)
            held, waiting = [], 0
    return row, at, score, off


def _compared(index: Index, placed: DataFrame, most: int, exact: bool) -> DataFrame:
    """(query_id, key, approx, err): of each query in each share of the vectors those that can be among its ``most`` best and score its ``least`` (``exact``: for
    sure, whatever rounding took off).

    Parts of cells are put together into shares. A share goes to the blocks of queries that ask for one of its cells; the task that compares the two keeps the best of
    all these cells, so that what is shuffled grows with the shares and not with the cells that a query asks for.
    """
    key, low, step, centroids = index.key, index.low, index.step, index.centroids
    shared = placed.sparkSession.sparkContext.broadcast((_cell_table(index), low, step))
    kinds = index.rows.schema[key].dataType.simpleString(), placed.schema["query_id"].dataType.simpleString()
    slack = (index.dim + 8) * 2.4e-7  # of scores in single precision
    cells = _counted(index.cells.select("cell", "n", "parts"), "cell")
    share = lambda part: F.floor((F.col("before") + part * F.col("n") / F.col("parts")) / SHARE)
    reached = cells.select("cell", share(F.lit(0)).alias("low"), share(F.col("parts") - 1).alias("high"))

    def needed(batches):
        import pyarrow as pa

        m = shared.value[0]
        for batch in batches:
            block, least, reach = (batch.column(c).to_numpy() for c in (0, 2, 3))
            q = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(len(block), -1)
            pairs = set()
            for a in range(0, len(block), 512):
                ask = _asks(q[a : a + 512] @ m["centroids"].T, m["radius"], least[a : a + 512], reach[a : a + 512]) & (m["n"] > 0)
                for b in np.unique(block[a : a + 512]).tolist():
                    pairs.update((b, c) for c in np.flatnonzero(ask[block[a : a + 512] == b].any(0)).tolist())
            made = sorted(pairs)
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int64()), pa.array([c for _, c in made], pa.int32())], ["block", "cell"])

    asked = placed.select("block", "q", "least", "reach").mapInArrow(needed, "block long, cell int").distinct()
    pairs = asked.join(F.broadcast(reached), "cell").select("block", F.explode(F.sequence("low", "high")).alias("share")).distinct()
    pairs = F.broadcast(staged(pairs, "pairs"))  # a row for SHARE vectors and ASKED queries
    left = index.rows.join(F.broadcast(cells), "cell").select(key, "cell", "code", "err", share(F.col("part")).alias("share")).join(pairs, "share")
    right = placed.join(pairs, "block")

    def run(vectors, queries):
        import pyarrow as pa

        empty = pa.table({"query_id": queries.column("query_id").slice(0, 0), key: vectors.column(key).slice(0, 0), "approx": pa.array([], pa.float64()), "err": pa.array([], pa.float64())})
        if not (vectors.num_rows and queries.num_rows):
            return empty
        m, low, step = shared.value
        order = np.argsort(vectors.column("cell").to_numpy(), kind="stable")
        cell = vectors.column("cell").to_numpy()[order]
        code = np.frombuffer(b"".join(vectors.column("code").to_pylist()), np.uint8).reshape(len(cell), -1)[order]
        v = (m["centroids"][cell] + low + code * step).astype(np.float32)
        err = vectors.column("err").to_numpy()[order] + slack if exact else np.zeros(len(cell))
        q = queries.column("q").combine_chunks().flatten().to_numpy().reshape(queries.num_rows, -1)
        least, reach = queries.column("least").to_numpy(), queries.column("reach").to_numpy()
        here = np.unique(cell)
        ask = _asks(q.astype(np.float64) @ m["centroids"][here].T, m["radius"][here], least, reach)
        row, at, score, err = _best_of(q, v, err, cell, ask, least, most)
        keys, ids = vectors.column(key).take(pa.array(order[at])), queries.column("query_id").take(pa.array(row))
        return pa.table({"query_id": ids, key: keys, "approx": pa.array(score), "err": pa.array(err)}) if len(row) else empty

    by = ("block", "share")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, f"query_id {kinds[1]}, {key} {kinds[0]}, approx double, err double")


def _scored(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, key: str) -> DataFrame:
    """(query_id, key, score, rank): what was found, scored with the vectors themselves; equal scores (to nine digits) by key."""
    pairs = found.select("query_id", key).distinct()
    both = pairs.join(vectors.select(key, "embedding"), key).join(queries.select("query_id", "q"), "query_id")
    out = both.select("query_id", key, cosine(F.col("embedding"), F.col("q")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def _best(found: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("approx")))
    return found.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def _sure(found: DataFrame, k: int) -> DataFrame:
    """(query_id, least): what the k best of each query score at least; queries with fewer than k have none."""
    sure = found.withColumn("sure", F.col("approx") - F.col("err"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sure")))
    # scores that agree in nine digits go by key: what is that near must be found as well
    return sure.withColumn("_r", rank).filter(F.col("_r") == k).select("query_id", (F.col("sure") - TIE).alias("least"))


def search(index: Index, vectors: DataFrame, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, key, score, rank): approximately the k nearest vectors of each query (query_id, q), from its ``probes`` nearest cells."""
    placed = _placed(index, queries.withColumn("least", F.lit(None).cast("double")), probes)
    return _scored(_best(_compared(index, placed, REFINE * k, False), REFINE * k), vectors, queries, k, index.key)


def search_exact(index: Index, vectors: DataFrame, queries: DataFrame, k: int, probes: int = 2) -> DataFrame:
    """As ``search``, but the k nearest vectors of all.

    The nearest cells give each query k vectors that score a certain value at least. Then every cell in which a vector can score that much is looked
    into, and what may be one of the k best, rounding allowed for, is scored with the vectors themselves. A query that finds fewer than k vectors at first asks all cells.
    """
    first = _compared(index, _placed(index, queries.withColumn("least", F.lit(None).cast("double")), probes), k, True)
    ready = staged(queries.select("query_id", "q").join(_sure(first, k), "query_id", "left"), "least")
    found = staged(_compared(index, _placed(index, ready, None), k, True), "found")
    least = _sure(found, k)  # each share has told what can be best in it
    found = found.join(least, "query_id", "left").filter("least is null or approx + err >= least")
    return _scored(found, vectors, queries, k, index.key)


def tuned_probes(index: Index, vectors: DataFrame, k: int, recall: float = 0.95, sample: int = 64) -> int:
    """The least number of cells to look into for so large a part of the k nearest, told by the exact neighbours of ``sample`` vectors, those of least key hash."""
    key = index.key
    some = vectors.select(F.col(key).alias("query_id"), F.col("embedding").alias("q")).orderBy(F.xxhash64("query_id", F.lit(7)), "query_id").limit(sample)
    some = staged(some, "tuning")
    true = search_exact(index, vectors, some, k)
    cell = true.join(index.rows.select(key, "cell"), key).select("query_id", "cell").join(some, "query_id")
    m = _cell_table(index)
    places = []
    for r in cell.collect():  # sample * k rows
        q = np.array(r.q, np.float64)
        score = np.where(m["n"] > 0, m["centroids"] @ q, -np.inf)
        places.append(int((score > score[r.cell]).sum()))
    return int(np.quantile(places, recall, method="higher")) + 1 if places else 1
