"""Quality classifier: Bradley-Terry scores learned from preference pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import grams, mix, text_blocks, words

#: Bound of the training sample: labelled rows, and preference pairs drawn from them.
SAMPLE_ROWS = 8_000
PAIRS = 40_000
#: The score at which a document is taken for good.
LIMIT = 0.3
#: Quantiles of the training scores that are tried as the threshold.
QUANTILES = 400

_CLASSES = [
    [i for i in range(128) if chr(i) in "#*$%&|<>{}[]\\^~=_@+/"],
    [i for i in range(128) if chr(i) in "!?"],
    list(range(65, 91)),
    list(range(97, 123)),
    list(range(48, 58)),
    [ord(c) for c in ".,;:'\"()-"],
    [10],
    [9, 11, 12, 13, 32],
    list(range(128, 256)),
]
N_HASHED = 32


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Features of each row of a block of texts, all from the whole text: shares of byte classes, word and line shape, repetition, word endings."""
    rows = len(off) - 1
    size = np.diff(off).astype(float)
    count = lambda owner, w=None: np.bincount(owner, w, rows)
    owner = np.repeat(np.arange(rows), np.diff(off))
    kind = np.zeros(256, np.int64)
    for i, members in enumerate(_CLASSES):
        kind[members] = i + 1
    shares = np.bincount(owner * (len(_CLASSES) + 1) + kind[raw], minlength=rows * (len(_CLASSES) + 1)).reshape(rows, -1) / np.maximum(size, 1)[:, None]
    s, e, h, row = words(raw, off)
    n = count(row)
    per = np.maximum(n, 1)
    length = (e - s).astype(float)
    mean = count(row, length) / per

    def distinct(value, own):
        key = mix(value + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return count(own[np.unique(key, return_index=True)[1]])

    g = grams(h, 3)
    inner = row[: len(g)] == row[2:] if len(g) else np.zeros(0, bool)
    runs = row[: len(g)][inner]
    last = raw[e - 1] if len(e) else np.zeros(0, np.uint8)
    sign = np.isin(last, _CLASSES[0] + _CLASSES[1])
    alone = (length == 1) & sign
    upper = (raw[s] >= 65) & (raw[s] <= 90) & (raw[np.maximum(e - 1, 0)] >= 65) & (raw[np.maximum(e - 1, 0)] <= 90) & (length > 1) if len(s) else np.zeros(0, bool)
    lines = count(owner[raw == 10]) + 1
    dense = np.column_stack([
        shares[:, 1:], np.log1p(size), np.log1p(n), mean / 10, np.sqrt(np.maximum(count(row, length**2) / per - mean**2, 0)) / 10,
        np.log1p(n / lines), distinct(h, row) / per, distinct(g[inner], runs) / np.maximum(count(runs), 1), count(row, sign) / per, count(row, alone) / per,
        count(row, upper) / per, count(row, last == 46) / per, n < 20,
    ])
    hashed = np.bincount(row * N_HASHED + (h % np.uint64(N_HASHED)).astype(np.int64), minlength=rows * N_HASHED).reshape(rows, -1) / per[:, None]
    return np.column_stack([dense, hashed])


N_FEATURES = len(_CLASSES) + 12 + N_HASHED


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, x): feature vectors."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            parts = [features(raw, off) for _, raw, off in text_blocks(batch.column(1))]
            x = np.concatenate(parts) if parts else np.zeros((0, N_FEATURES))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def fit(x: np.ndarray, y: np.ndarray, seed: int = 1) -> dict:
    """Bradley-Terry weights and the threshold.

    Each pair has one document of label 1 and one of label 0; the loss is the logistic loss of the difference of their scores, a linear function of the
    features' difference, minimised by Newton steps with a small ridge. The threshold is the quantile of the sample's scores that gives the best
    mean of both labels' hit rates, half way to the next score. Without both labels every document scores 0.5.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return {"mean": np.zeros(x.shape[1]), "scale": np.ones(x.shape[1]), "w": np.zeros(x.shape[1]), "limit": 0.0, "flat": True}
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w, ridge = np.zeros(x.shape[1]), 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = -(d * p[:, None]).mean(0) + ridge * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    cuts = np.quantile(raw, np.arange(1, QUANTILES) / QUANTILES)
    rate = [(raw[good] >= c).mean() + (raw[bad] < c).mean() for c in cuts]
    at = cuts[int(np.argmax(rate))]
    below, above = raw[raw < at], raw[raw >= at]
    limit = (below.max() + above.min()) / 2 if len(below) and len(above) else at
    return {"mean": mean, "scale": scale, "w": w, "limit": float(limit), "flat": False}


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Fit on at most ``sample_rows`` labelled documents, those of lowest hash; labels are (doc_id, quality)."""
    chosen = labels.filter(F.col("quality").isNotNull()).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = featured(docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi"))
    rows = rows.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "quality").limit(2 * sample_rows).toPandas()
    x = np.array(rows["x"].tolist()).reshape(len(rows), N_FEATURES)
    return fit(x, rows["quality"].to_numpy())


def score(docs: DataFrame, model: dict, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of ``docs`` (doc_id alone by default) plus ``score`` (0 to 1) and ``predicted`` (1: score at or over LIMIT).

    The score is the logistic function of the distance to the threshold, moved so that the threshold scores LIMIT. Null and empty texts are scored by
    their features like others; repeated rows score alike; an empty table gives an empty result; columns named score or predicted are replaced.
    """
    keep = [c for c in carry or ["doc_id"] if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shift = float(np.log(LIMIT / (1 - LIMIT)))

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            out = [np.zeros(0)]
            for _, raw, off in text_blocks(batch.column(0)):
                z = np.clip((features(raw, off) - m["mean"]) / m["scale"], -8, 8)
                out.append(np.full(len(z), 0.5) if m["flat"] else 1 / (1 + np.exp(-np.clip(z @ m["w"] - m["limit"] + shift, -40, 40))))
            value = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(value), pa.array((value >= LIMIT).astype(np.int32))], schema=pa.schema([*list(batch.schema)[1:], ("score", pa.float64()), ("predicted", pa.int32())]))

    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    return docs.select(F.col("text").alias("_text"), *keep).mapInArrow(run, schema)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, train(docs, training_labels(labels)))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
