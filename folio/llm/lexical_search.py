"""Ranked lexical search: exact integer scores of a stated set of items against all documents, by sort-based accumulation.

A task finds the words of its documents that any item asks for, lays (item, document, impact) of all of them end to end, sorts the packed keys of item and
document by radix, adds the impacts of equal keys up with one ``reduceat`` and keeps each item's best on a heap. Only those reach the shuffle.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import mix, staged, text_blocks, words

TOP = 10
#: Items that are searched for at once; more are several rounds over the documents.
ITEMS = 4_000
#: Impacts that are sorted at once, beyond which the documents of a block are dealt with in turn.
IMPACTS = 1 << 21
#: Best documents that a task keeps of an item go through so many parts of the second stage before the last.
PARTS = 16
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order that sorts whole numbers of up to 64 bits: stable passes over 16 bits each, as many as the largest needs."""
    order = np.arange(len(keys))
    rest, at = int(keys.max()) if len(keys) else 0, 0
    while rest:
        order = order[np.argsort(((keys[order] >> np.uint64(at)) & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")]
        rest, at = rest >> 16, at + 16
    return order


def item_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash and length of each distinct term, in the order of hashes; bounds of its postings; postings: numbers of the items that have it)."""
    import pyarrow as pa

    found = []
    for first, raw, off in text_blocks(pa.array(texts, pa.string())):
        s, e, h, row = words(raw, off, lower=True, alnum=True)
        found.append((h, e - s, row + first))
    h, size, row = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
    pairs = np.unique(np.rec.fromarrays([h.astype(np.uint64), size.astype(np.int64), row.astype(np.int64)], names="h,n,row")) if len(h) else np.rec.fromarrays([np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)], names="h,n,row")
    key = _key(pairs["h"], pairs["n"])
    order = np.argsort(key, kind="stable")
    key, row = key[order], pairs["row"][order]
    fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[fresh], np.append(fresh, len(key)), row


def _key(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A word's hash with its length, so that only words of one length can be taken for one another."""
    return mix(h + size.astype(np.uint64))


def _asked(raw: np.ndarray, off: np.ndarray, keys: np.ndarray, small: np.ndarray):
    """(row, term, occurrences) of the asked terms in a block of documents, by row and term; words of each row."""
    s, e, h, row = words(raw, off, lower=True, alnum=True)
    n = np.bincount(row, minlength=len(off) - 1)
    k = _key(h, e - s)
    hit = np.flatnonzero(small[(k & np.uint64(0xFFFF)).astype(np.int64)])  # most words are asked for by no item
    at = np.searchsorted(keys, k[hit])
    same = keys[np.minimum(at, len(keys) - 1)] == k[hit] if len(keys) else np.zeros(0, bool)
    packed = row[hit][same].astype(np.uint64) << np.uint64(32) | at[same].astype(np.uint64)
    packed = packed[radix_order(packed)]
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(packed)))
    return (packed[first] >> np.uint64(32)).astype(np.int64), (packed[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), tf, n


def _bits(keys: np.ndarray) -> np.ndarray:
    small = np.zeros(1 << 16, bool)
    small[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
    return small


def corpus_counts(docs: DataFrame, keys: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(documents with a word, words of all documents, documents that hold each term), counted over all rows. A row for each term reaches the driver."""
    shared = docs.sparkSession.sparkContext.broadcast((keys, _bits(keys)))

    def run(batches):
        import pyarrow as pa

        keys, small = shared.value
        df, some, total = np.zeros(len(keys), np.int64), 0, 0
        for batch in batches:
            for _, raw, off in text_blocks(batch.column(0)):
                _, term, _, n = _asked(raw, off, keys, small)
                df += np.bincount(term, minlength=len(keys))
                some, total = some + int((n > 0).sum()), total + int(n.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], held]), pa.int64()), pa.array(np.concatenate([[some, total], df[held]]), pa.int64())], ["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, counts = np.zeros(len(keys), np.int64), {}
    for r in rows:
        if r["term"] < 0:
            counts[r["term"]] = r["n"]
        else:
            df[r["term"]] = r["n"]
    return counts.get(-2, 0), counts.get(-1, 0), df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def _best(docs: DataFrame, model: dict, key: str, top: int) -> DataFrame:
    """(item, key, score): of each task's documents the best of each item."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(key).schema.add("item", "long").add("score", "long")

    def run(batches):
        import pyarrow as pa

        m = shared.value
        keys, bounds, posts, weight = m["keys"], m["bounds"], m["posts"], m["weights"]
        small, heaps, least, kind = _bits(keys), [[] for _ in range(m["items"])], np.zeros(m["items"], np.int64), None
        for batch in batches:
            ids, kind = batch.column(1).to_pylist(), batch.schema.field(1).type
            for start, raw, off in text_blocks(batch.column(0)):
                row, term, tf, n = _asked(raw, off, keys, small)
                used = weight[term] > 0
                row, term, tf = row[used], term[used], tf[used]
                length = _lengths(n, m["n_docs"], m["n_words"])
                impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length[row]))
                fan = bounds[term + 1] - bounds[term]
                cuts = np.searchsorted(np.cumsum(fan), np.arange(IMPACTS, int(fan.sum()) + IMPACTS, IMPACTS), "right") if len(fan) else np.zeros(0, np.int64)
                cuts = np.unique(np.searchsorted(row, row[np.minimum(cuts, len(row) - 1)], "left")) if len(fan) else cuts  # whole documents only
                for a, b in zip([0, *cuts[cuts > 0]], [*cuts[cuts > 0], len(row)], strict=True):
                    some = fan[a:b]
                    at = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some) + np.repeat(bounds[term[a:b]], some)
                    packed = posts[at].astype(np.uint64) << np.uint64(24) | np.repeat(row[a:b], some).astype(np.uint64)  # a block has less than 2 ** 24 rows
                    order = radix_order(packed)
                    packed, value = packed[order], np.repeat(impact[a:b], some)[order]
                    if not len(packed):
                        continue
                    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
                    score, item, doc = np.add.reduceat(value, first), (packed[first] >> np.uint64(24)).astype(np.int64), (packed[first] & np.uint64(0xFFFFFF)).astype(np.int64)
                    for x in np.flatnonzero((score > 0) & (score >= least[item])):
                        i, entry = item[x], (int(score[x]), _Late(ids[start + doc[x]]))
                        heap = heaps[i]
                        if len(heap) < top:
                            heapq.heappush(heap, entry)
                        elif heap[0] < entry:
                            heapq.heapreplace(heap, entry)
                        if len(heap) == top:
                            least[i] = heap[0][0]
        out = [(e[1].key, i, e[0]) for i, heap in enumerate(heaps) for e in heap]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], [key, "item", "score"])

    return docs.select("text", key).mapInArrow(run, schema)


def _lengths(n: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """A document's m: 10 + (90 * n * N) div L, with whole numbers of any size where 64 bits don't hold the product."""
    if len(n) and int(n.max()) * 90 * n_docs >= 1 << 63:
        return np.array([10 + 90 * int(x) * n_docs // max(n_words, 1) for x in n], np.int64)
    return 10 + 90 * n.astype(np.int64) * n_docs // max(n_words, 1)


class _Late:
    """A document's key in a heap of (score, key): of equal scores the greater key goes first, a null one before all."""

    __slots__ = ("key",)

    def __init__(self, key):
        self.key = key

    def __lt__(self, other):
        return other.key is not None and (self.key is None or other.key < self.key)

    def __eq__(self, other):
        return self.key == other.key


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", item: str = "item_id", block: int = ITEMS) -> DataFrame:
    """(item, rank, key, score): the ``top`` documents of each item, score above 0, equal scores by ascending key.

    ``items`` is the stated query set; it passes through the driver in blocks of ``block`` items, so that what is in the tasks' memory is bounded, and each
    block reads the documents twice: to count them, and to score them. Null and empty texts match nothing and count as no document; an item without a word
    or a match has no rows; items of equal text and repeated items are answered one by one; repeated rows of a document rank one by one; a null key ranks after
    all others of its score; no documents or no items give an empty result; other columns make no difference.
    """
    spark = docs.sparkSession
    out = None
    for names, texts in _blocks(items, item, block):
        keys, bounds, posts = item_terms(texts)
        n_docs, n_words, df = corpus_counts(docs, keys)
        model = {"keys": keys, "bounds": bounds, "posts": posts, "weights": weights(n_docs, df), "n_docs": n_docs, "n_words": n_words, "items": len(texts)}
        kept = staged(_best(docs, model, key, top), "impacts")
        order = [F.desc("score"), F.asc_nulls_last(key)]
        # a task's best are dealt to several parts of an item first, so that no task sees all of an item's
        part = kept.withColumn("_p", F.pmod(F.xxhash64(key, "score"), F.lit(PARTS)))
        part = part.withColumn("_r", F.row_number().over(Window.partitionBy("item", "_p").orderBy(*order))).filter(F.col("_r") <= top)
        ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
        named = spark.createDataFrame(list(enumerate(names)), f"item long, {item} {items.schema[item].dataType.simpleString()}")
        found = ranked.join(F.broadcast(named), "item").select(item, "rank", key, "score")  # named has a block's items
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.select(key).limit(0).crossJoin(items.select(item).limit(0)).select(item, F.lit(0).alias("rank"), key, F.lit(0).cast("long").alias("score"))
    return out


def _blocks(items: DataFrame, item: str, block: int):
    held = []
    for r in items.select(item, "text").toLocalIterator():
        held.append(r)
        if len(held) == block:
            yield [x[0] for x in held], [x[1] for x in held]
            held = []
    if held:
        yield [x[0] for x in held], [x[1] for x in held]


def op12_sorted_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}')"
OP12_SQL = f"""WITH words AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, {_TERMS} AS ws FROM documents),
whole AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, sum(len(ws))::BIGINT AS n_words FROM words),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS MATERIALIZED (SELECT rid, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT rid, doc_id, len(ws) AS n, unnest(ws) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY rid, doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY term),
scored AS (SELECT item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_words)))))::BIGINT AS score FROM asked JOIN tf USING (term) JOIN w USING (term), whole GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= {TOP}"""
