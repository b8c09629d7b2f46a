"""Toxicity by weak supervision: many lexicon and pattern voters, a generative model of their accuracies and correlations, a linear classifier.

Voters are fixed lexicon words, words and word beginnings mined from labelled rows, and patterns of shape; each fires or is silent on a text. The
label model takes the class of a text as unknown: given the class, each voter depends on at most one other, along a forest of the strongest correlations,
and expectation maximisation finds how often each voter fires in either class. The classifier is fitted to the posterior classes that it gives.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import _BYTE, _LOWER, _powers, mix, staged, text_blocks, words

#: Bounds of what the model is fitted on: labelled rows, mined terms that are counted, such that are compared on the driver, and voters among them.
SAMPLE_ROWS = 8_000
TERMS = 200_000
CANDIDATES = 512
VOTERS = 72
#: Mined terms are in so many labelled toxic texts at least; a text counts a term so often at most when terms are weighed.
LEAST_TEXTS, MOST = 3, 3
#: Code points of the word beginnings.
SHORTEST, LONGEST = 3, 8
#: A voter fires at so many times the rate of clean texts at least.
OVER = 3.0
# fixed values: words of insult in four languages, the lexicon voters
LEXICON = """
idiot moron stupid dumb imbecile loser scum trash garbage worthless pathetic disgusting clown filthy vermin ugly fool jerk pig freak
dummkopf trottel abschaum müll wertlos ekelhaft dreck versager widerlich blöd
crétin imbécile ordure déchet minable dégoûtant salaud abruti débile nul
idiota imbécil estúpido basura escoria asqueroso inútil payaso cerdo tonto
""".split()
#: Patterns: shouted words, words with !!, words with a sign among letters, the same letter four times, words said twice in a row; each fires at its own quantile.
PATTERNS = 5
QUANTILE = 0.97
LIMIT = 0.5
#: What a clean text that is left alone is worth against a toxic one that is found, when the threshold is chosen.
CLEAN = 3.0
#: Weight of the voters' known rates in the label model, as a part of the sample.
PRIOR = 0.1
#: How often a label is right, as the label model takes it.
TRUST = 0.98
_DOUBLES = T.ArrayType(T.DoubleType())


def _sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[_LOWER[raw]] * up[: len(raw)], out=total[1:])
    return total, down


def _beginning(total, down, s, end):
    """Hash of the bytes from s to end as a word's beginning; it differs from that of the same bytes as a whole word."""
    with np.errstate(over="ignore"):
        return mix(mix((total[end] - total[s]) * down[s]) + np.uint64(77))


def text_terms(raw: np.ndarray, off: np.ndarray, lengths=range(SHORTEST, LONGEST + 1), first: np.ndarray | None = None):
    """(row, hash, start, end) of the words of a block and of their beginnings of each length, and the words of each row.

    Words are runs of anything but ASCII signs, A-Z as a-z; shorter ones than SHORTEST code points have no term. ``first``: a table of 16-bit hashes; words
    whose beginning of SHORTEST code points isn't in it are passed over.
    """
    s, e, h, row = words(raw, off, lower=True, alnum=True)
    n = np.bincount(row, minlength=len(off) - 1)
    total, down = _sums(raw)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    last = len(lead)
    lead = np.append(lead, np.full(LONGEST + 1, len(raw)))
    at = np.searchsorted(lead, s)
    long_ = np.flatnonzero((lead[at + SHORTEST - 1] < e) & (lead[at] == s)) if len(s) else np.zeros(0, np.int64)
    if first is not None and len(long_):
        head = _beginning(total, down, s[long_], np.minimum(lead[at[long_] + SHORTEST], e[long_]))
        long_ = long_[first[(head & np.uint64(0xFFFF)).astype(np.int64)]]
    s, e, h, row, at = s[long_], e[long_], h[long_], row[long_], at[long_]
    out = [(row, h, s, e)]
    for k in lengths:
        end = lead[at + k]
        ok = (end <= e) & (at + k <= last)
        out.append((row[ok], _beginning(total, down, s[ok], end[ok]), s[ok], end[ok]))
    return (*(np.concatenate(x) for x in zip(*out, strict=True)), n)


def _per_text(row: np.ndarray, h: np.ndarray):
    """(row, hash, occurrences, place of the first) of each distinct term of each row."""
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (x[1:] != x[:-1])])) if len(r) else np.zeros(0, np.int64)
    return r[first], x[first], np.diff(np.append(first, len(r))), order[first]


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(text, toxic) of at most ``sample_rows`` labelled rows, those of least hash of id and text; equal texts count once, toxic if one of them is."""
    chosen = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("h", F.md5("text"))  # chosen has sample_rows rows at most
    return staged(rows.groupBy("h").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("h").limit(sample_rows).select("text", "toxic"), "toxic-sample")


def mined_terms(sample: DataFrame) -> list[dict]:
    """The terms that set toxic texts of the sample apart, best first: hash, bytes, whether a beginning, and the log likelihood ratio of its (bounded) counts."""

    def toxic(batches):
        import pyarrow as pa

        for batch in batches:
            for _, raw, off in text_blocks(batch.column(0)):
                row, h, s, e, _ = text_terms(raw, off)
                _, x, _, at = _per_text(row, h)
                u, place, n = np.unique(x, return_index=True, return_counts=True)
                where = at[place]
                names = [_LOWER[raw[s[i] : e[i]]].tobytes() for i in where]
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n), pa.array(names, pa.binary())], ["term", "n", "name"])

    found = sample.filter("toxic = 1").select("text").mapInArrow(toxic, "term long, n long, name binary").groupBy("term").agg(F.sum("n").alias("n"), F.min("name").alias("name"))
    found = staged(found.filter(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "term").limit(TERMS), "toxic-terms")
    keys = np.sort(np.array([r["term"] for r in found.select("term").collect()], np.int64).view(np.uint64))
    if not len(keys):
        return []
    shared = sample.sparkSession.sparkContext.broadcast(keys)

    def counted(batches):
        import pyarrow as pa

        keys = shared.value
        for batch in batches:
            toxic = batch.column(1).to_numpy() == 1
            for start, raw, off in text_blocks(batch.column(0)):
                row, h, s, e, _ = text_terms(raw, off)
                row, x, n, _ = _per_text(row, h)
                at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                same = keys[at] == x
                row, at, n = row[same], at[same], np.minimum(n[same], MOST)
                y = toxic[start + row]
                mark = mix(row.astype(np.uint64) + np.uint64(_stamp(raw, off)))
                sums = [np.bincount(at, w, len(keys)).astype(np.int64) for w in (y * n, ~y * n)]
                with np.errstate(over="ignore"):
                    support = np.zeros(len(keys), np.uint64)
                    np.add.at(support, at, mark)
                some = np.flatnonzero(sums[0] + sums[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(sums[0][some]), pa.array(sums[1][some]), pa.array((support[some] >> np.uint64(24)).view(np.int64))], ["term", "bad", "good", "support"])

    counts = sample.select("text", "toxic").mapInArrow(counted, "term long, bad long, good long, support long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("bad", "good", "support")))
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = float(max(size.get(1, 0), 1)), float(max(size.get(0, 0), 1))
    p = (F.col("bad") + F.col("good")) / F.lit(n1 + n0)
    gain = F.col("bad") * F.log(F.col("bad") / n1 / p) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / n0 / p)).otherwise(0.0)
    least = float(np.log(len(keys)) + 4)  # so that chance among so many terms gives hardly any
    best = counts.filter(F.col("bad") / n1 > F.col("good") / n0).withColumn("gain", gain).filter(F.col("gain") > least)
    # terms of the same texts and counts are one: the longest stands for them
    named = best.join(found.select("term", "name"), "term").groupBy("bad", "good", "support").agg(F.max_by(F.struct("term", "name", "gain"), F.struct(F.length("name"), "name", "term")).alias("r")).select("r.*")
    rows = named.orderBy(F.desc("gain"), "term").limit(CANDIDATES).collect()
    return [{"hash": int(np.int64(r["term"]).view(np.uint64)), "name": bytes(r["name"]), "gain": r["gain"]} for r in rows]


def _stamp(raw: np.ndarray, off: np.ndarray) -> int:
    """A number that tells a block of texts from others."""
    import zlib

    return zlib.crc32(raw.tobytes()) << 24 | len(off) << 4


def _lexicon() -> list[dict]:
    import pyarrow as pa

    out = []
    for _, raw, off in text_blocks(pa.array(LEXICON)):
        s, e, h, _ = words(raw, off, lower=True, alnum=True)
        out += [{"hash": int(x), "name": raw[a:b].tobytes(), "gain": 0.0} for x, a, b in zip(h, s, e, strict=True)]
    return out


def _tables(terms: list[dict]) -> dict:
    """What the tasks need to find terms: their sorted hashes and places, the lengths of beginnings, and the 16-bit table of first code points."""
    keys = np.array([t["hash"] for t in terms], np.uint64)
    order = np.argsort(keys, kind="stable")
    first = np.zeros(1 << 16, bool)
    for t in terms:
        raw = np.frombuffer(t["name"], np.uint8)
        lead = np.append(np.flatnonzero((raw & 0xC0) != 0x80), [len(raw)] * (SHORTEST + 1))
        total, down = _sums(raw)
        head = _beginning(total, down, np.array([0]), np.array([min(lead[SHORTEST], len(raw))]))
        first[int(head[0]) & 0xFFFF] = True
    sizes = {len(t["name"].decode("utf-8", "replace")) for t in terms}
    return {"keys": keys[order], "place": order, "lengths": [k for k in range(SHORTEST, LONGEST + 1) if k in sizes], "first": first}


def counts_of(raw: np.ndarray, off: np.ndarray, tables: dict) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences of each term, words and pattern counts) of each text of a block, all from the whole text."""
    rows, m = len(off) - 1, len(tables["keys"])
    row, h, s, e, n = text_terms(raw, off, tables["lengths"], tables["first"])
    at = np.minimum(np.searchsorted(tables["keys"], h), max(m - 1, 0))
    same = tables["keys"][at] == h if m else np.zeros(len(h), bool)
    count = np.bincount(row[same] * m + tables["place"][at[same]], minlength=rows * m).reshape(rows, m) if m else np.zeros((rows, 0), np.int64)
    ws, we, wh, wrow = words(raw, off, lower=True)
    upper = np.cumsum(np.append(0, (raw >= 65) & (raw <= 90)))
    letters = np.cumsum(np.append(0, ((raw >= 65) & (raw <= 90)) | ((raw >= 97) & (raw <= 122))))
    up, any_ = upper[we] - upper[ws], letters[we] - letters[ws]
    bang = np.zeros(len(raw) + 1, np.int64)
    bang[1:] = np.cumsum(np.append(False, (raw[1:] == 33) & (raw[:-1] == 33)) if len(raw) else np.zeros(0, bool))
    same4 = np.zeros(len(raw) + 1, np.int64)
    if len(raw) > 3:
        same4[4:] = np.cumsum((raw[3:] == raw[2:-1]) & (raw[2:-1] == raw[1:-2]) & (raw[1:-2] == raw[:-3]) & (raw[3:] > 64))
    inner = np.isin(raw, np.frombuffer(b"@$*#01345", np.uint8))
    mixed = np.cumsum(np.append(0, inner))
    twice = np.append(False, (wh[1:] == wh[:-1]) & (wrow[1:] == wrow[:-1])) if len(wh) else np.zeros(0, bool)
    shapes = [(up == any_) & (any_ > 2), bang[we] > bang[ws], (any_ > 1) & (mixed[we] > mixed[ws]), same4[we] > same4[np.minimum(ws + 3, we)], twice]
    patterns = np.column_stack([np.bincount(wrow, x, rows) for x in shapes]) if len(wrow) else np.zeros((rows, PATTERNS))
    return count, np.column_stack([n, patterns])


def counted(df: DataFrame, tables: dict, carry: list[str]) -> DataFrame:
    """Columns ``carry`` with ``hits`` and ``shape`` of each text."""
    shared = df.sparkSession.sparkContext.broadcast(tables)
    m = len(tables["keys"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            parts = [counts_of(raw, off, shared.value) for _, raw, off in text_blocks(batch.column(0))]
            hits = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, m), np.int64)
            shape = np.concatenate([p[1] for p in parts]) if parts else np.zeros((0, PATTERNS + 1))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel().astype(np.float64))) for x in (hits, shape)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *lists], [*carry, "hits", "shape"])

    schema = df.select(*carry).schema.add("hits", _DOUBLES).add("shape", _DOUBLES)
    return df.select(F.col("text").alias("_text"), *carry).mapInArrow(run, schema)


def forest(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Each voter's parent (-1: none) in the forest of the greatest correlations between voters within the classes.

    An edge's weight is the mutual information of two voters given the class; it stays if it is worth the two parameters that it costs (half log n each).
    """
    n, m = votes.shape
    info = np.zeros((m, m))
    for w in (q, 1 - q):
        size = max(w.sum(), 1e-9)
        one, joint = w @ votes / size, (votes.T * w) @ votes / size
        for a in (0, 1):
            for b in (0, 1):
                p = joint if a and b else one[:, None] - joint if a else one[None, :] - joint if b else 1 - one[:, None] - one[None, :] + joint
                pa, pb = (one if a else 1 - one)[:, None], (one if b else 1 - one)[None, :]
                p = np.clip(p, 1e-12, 1)
                info += size * p * np.log(p / np.clip(pa * pb, 1e-12, 1))
    parent, tree = np.full(m, -1), np.arange(m)
    near: list[list[int]] = [[] for _ in range(m)]
    i, j = np.triu_indices(m, 1)
    for k in np.argsort(-info[i, j], kind="stable"):
        a, b = i[k], j[k]
        if info[a, b] <= np.log(max(n, 2)):
            break
        if tree[a] != tree[b]:
            near[a].append(b)
            near[b].append(a)
            tree[tree == tree[b]] = tree[a]
    seen = np.zeros(m, bool)
    for root in range(m):
        stack = [] if seen[root] else [root]
        seen[root] = True
        while stack:
            v = stack.pop()
            for w in near[v]:
                if not seen[w]:
                    seen[w], parent[w] = True, v
                    stack.append(w)
    return parent


def label_model(votes: np.ndarray, terms: int, prior: np.ndarray, said: np.ndarray | None = None, rounds: int = 80) -> dict:
    """The posterior class of each row of votes (0 or 1), each voter's rate of firing by class (and by its parent's vote), and the forest of correlations.

    The first ``terms`` columns are the term voters: texts in which two of them fire start as toxic, one as open, none as clean. ``prior`` has each voter's
    rate by class as known before, which counts as a part (PRIOR) of what the texts say. ``said`` has what a label says of each row, if any: it is one more voter, right in
    a part (TRUST) of all cases. Without both a group of voters that fires in texts of its own, as those of one language do, can change sides as a whole, since
    the silence of all other voters speaks for clean texts.
    """
    n, m = votes.shape
    fired = votes[:, :terms].sum(1)
    q = np.where(fired >= 2, 0.95, np.where(fired == 1, 0.6, 0.02))
    v, parent = votes.astype(np.float64), np.full(m, -1)
    for r in range(rounds):
        if r % 8 == 4:
            parent = forest(v, q)
        above = np.where(parent[None, :] >= 0, v[:, np.maximum(parent, 0)], 0)
        odds = np.full(n, np.log(np.clip(q.mean(), 1e-3, 1 - 1e-3) / np.clip(1 - q.mean(), 1e-3, 1 - 1e-3)))
        if said is not None:
            odds += np.where(said == 1, 1, -1) * np.log(TRUST / (1 - TRUST))
        rates = np.zeros((2, 2, m))
        for y, w in ((0, 1 - q), (1, q)):
            for b in (0, 1):
                given = w[:, None] * (above == b)
                base = (w @ v + PRIOR * n * prior[y]) / (w.sum() + PRIOR * n)  # a rare case of the parent's leans on the voter's own rate
                rates[y, b] = ((given * v).sum(0) + 2 * base) / (given.sum(0) + 2)
        for y, sign in ((0, -1), (1, 1)):
            p = np.clip(np.where(above == 1, rates[y, 1], rates[y, 0]), 1e-6, 1 - 1e-6)
            odds += sign * np.where(v == 1, np.log(p), np.log(1 - p)).sum(1)
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        done, q = np.abs(new - q).max() < 1e-5 and r % 8 > 4 and r > 24, new
        if done:
            break
    return {"posterior": q, "rates": rates, "parent": parent}


def _votes(hits: np.ndarray, shape: np.ndarray, m: dict) -> np.ndarray:
    """Which voters fire: terms by count and rate, patterns by their quantile, and the one that fires where no term does."""
    n = shape[:, :1]
    terms = (hits >= m["least"]) & (hits >= OVER * m["rate"] * n)
    patterns = shape[:, 1:] > m["cuts"] * np.maximum(n, 1)
    return np.column_stack([terms, patterns, ~terms.any(1)])


def linear_features(hits: np.ndarray, shape: np.ndarray, m: dict) -> np.ndarray:
    votes = _votes(hits, shape, m)
    k = hits.shape[1]
    live = hits * votes[:, :k]
    total, n = live.sum(1), np.maximum(shape[:, 0], 1)
    more = [np.log1p(total), np.log1p(1000 * total / n), votes[:, :k].sum(1).clip(max=5), np.log1p(n) / 5]
    return np.column_stack([votes, np.minimum(live, MOST) / MOST, *more]).astype(np.float64)


def fit(hits: np.ndarray, shape: np.ndarray, y: np.ndarray) -> dict:
    """Voters' thresholds, the label model, the linear classifier on its posterior classes, and the threshold that suits the labels best.

    Each term's voter fires from 1, 2 or 3 occurrences on, whichever tells the sample's labels apart best. Without both labels every text scores 0.5, or less
    and not toxic where there are clean ones alone.
    """
    k = hits.shape[1]
    model = {"least": np.ones(k), "rate": np.zeros(k), "cuts": np.zeros(PATTERNS), "w": None, "flat": 0.0 if len(y) else 0.25}
    if not (y == 1).any() or not (y == 0).any():
        model["flat"] = 0.75 if (y == 1).any() else 0.25
        return model
    n = np.maximum(shape[:, 0], 1)
    model["rate"] = hits[y == 0].sum(0) / n[y == 0].sum()
    gains = []
    for t in (1, 2, 3):
        a, b = ((hits[y == 1] >= t).mean(0), (hits[y == 0] >= t).mean(0))
        gains.append(a - b - 2 * b)
    model["least"] = np.argmax(gains, 0) + 1.0
    model["cuts"] = np.quantile(shape[:, 1:] / n[:, None], QUANTILE, axis=0)
    votes = _votes(hits, shape, model)
    prior = np.stack([(votes[y == c].sum(0) + 0.1) / ((y == c).sum() + 1) for c in (0, 1)])
    labels = label_model(votes, k, prior, y)
    q = labels["posterior"]
    x = linear_features(hits, shape, model)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.append(np.full(z.shape[1] - 1, 1e-2), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * np.maximum(p * (1 - p), 1e-4)) @ z / len(z) + np.diag(ridge), z.T @ (p - q) / len(z) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    order = np.unique(raw)
    cuts = (order[1:] + order[:-1]) / 2 if len(order) > 1 else order
    cuts = cuts[:: max(1, len(cuts) // 2000)]
    good = [(raw[y == 1] >= c).mean() + CLEAN * (raw[y == 0] < c).mean() - 1e-3 * abs(c) for c in cuts]
    return model | {"mean": mean, "scale": scale, "w": w, "limit": float(cuts[int(np.argmax(good))]), "labels": {"rates": labels["rates"], "parent": labels["parent"]}}


def chosen_voters(mined: list[dict]) -> list[dict]:
    """The mined terms with the most gain, but none that begins a better one or that a better one begins, and the lexicon's words that are not among them."""
    out: list[dict] = []
    for t in mined:
        if len(out) < VOTERS and not any(t["name"].startswith(o["name"]) or o["name"].startswith(t["name"]) for o in out):
            out.append(t)
    seen = {t["hash"] for t in out}
    return out + [t for t in _lexicon() if t["hash"] not in seen]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """The model of ``score``, fitted on at most ``sample_rows`` labelled rows; ``labels``: (doc_id, toxic)."""
    sample = labelled_sample(docs, labels, sample_rows)
    terms = chosen_voters(mined_terms(sample))
    tables = _tables(terms)
    rows = counted(sample, tables, ["toxic"]).toPandas()
    arrays = [np.array(rows[c].tolist(), np.float64).reshape(len(rows), -1 if len(rows) else width) for c, width in (("hits", len(terms)), ("shape", PATTERNS + 1))]
    return {"tables": tables, "terms": [t["name"] for t in terms]} | fit(*arrays, rows["toxic"].to_numpy())


def scores(raw: np.ndarray, off: np.ndarray, model: dict) -> np.ndarray:
    hits, shape = counts_of(raw, off, model["tables"])
    if model["w"] is None:
        return np.full(len(off) - 1, model["flat"])
    z = np.clip((linear_features(hits.astype(np.float64), shape, model) - model["mean"]) / model["scale"], -8, 8)
    return 1 / (1 + np.exp(-np.clip(z @ model["w"][:-1] + model["w"][-1] - model["limit"], -40, 40)))


def score(docs: DataFrame, model: dict, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of ``docs`` (doc_id alone by default) plus ``score`` (0 to 1) and ``predicted`` (1: score at or over LIMIT).

    Null and empty texts have no hits and are scored like others; repeated rows score alike; an empty table gives an empty result; columns named score or
    predicted are replaced.
    """
    keep = [c for c in carry or ["doc_id"] if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k not in ("terms", "labels")})

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            value = np.concatenate([np.zeros(0), *(scores(raw, off, shared.value) for _, raw, off in text_blocks(batch.column(0)))])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(value), pa.array((value >= LIMIT).astype(np.int32))], schema=pa.schema([*list(batch.schema)[1:], ("score", pa.float64()), ("predicted", pa.int32())]))

    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    return docs.select(F.col("text").alias("_text"), *keep).mapInArrow(run, schema)


def op11_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    out = score(docs, train(docs, labels.filter(rest != 0)))
    return out.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "score", "predicted")
