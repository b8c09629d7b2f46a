"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import mix, text_blocks, words

#: An item of m words is found where a window is within floor(m / 5) word edits of it, a similarity of 0.8 or more.
EDITS = 5
#: Random walks a window; first sampled places of each, second ones to each of these, and third ones to each pair: their product is the number of tables.
WALKS, FIRSTS, SECONDS, THIRDS = 4, 4, 2, 4
#: Windows by size from so many words on; all of a size class are sampled within one and a half times its least size. Smaller items must occur word for word.
SIZES = (EDITS, 9, 17, 33)
#: An item of more words has windows of so many at every so many words; each says where the whole item may stand.
LONGEST = 64
#: Starts whose walks are in memory together, few enough for a processor's cache.
STARTS = 1 << 15
#: Items in one broadcast.
ITEM_BLOCK = 4_000
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def places(size: int, walk: int) -> list[tuple[int, int, list[int]]]:
    """(first, second, thirds): the places that are sampled in a walk over windows of a size class.

    Early places are likelier: fewer edits lie before them, so more of them agree.
    """
    rng = np.random.default_rng((size, walk))
    more = 3 if size < SIZES[1] else 1  # few places of so short a window are without an edit

    def draw(*far):
        while True:
            t = int(rng.random() ** 2 * 1.5 * size)
            if all(abs(t - x) > 1 for x in far):
                return t

    firsts = [draw() for _ in range(FIRSTS * more)]
    pairs = [(f, draw(f)) for f in firsts for _ in range(SECONDS * more)]
    return [(f, a, [draw(f, a) for _ in range(THIRDS)]) for f, a in pairs]


def walked(h: np.ndarray, at: np.ndarray, walk: int, wanted: set[int]) -> dict[int, np.ndarray]:
    """CGK: from each of the places ``at`` a pointer walks the words ``h`` and goes on or stays by a random bit of (walk, step, word); where it is at the wanted steps.

    Words with few edits between them are read alike in most steps, as both pointers wait until they are in step again.
    """
    out, pos, step, bits = {}, at.copy(), np.empty(len(at), np.int64), None
    for t in range(max(wanted) + 1):
        if t % 64 == 0:
            bits = mix(h ^ np.uint64(walk * 1_000_003 + t)).view(np.int64)
        if t in wanted:
            out[t] = pos.copy()
        np.take(bits, pos, out=step, mode="clip")
        step >>= t % 64
        step &= 1
        pos += step
    return out


def _share(h: np.ndarray, pos: dict[int, np.ndarray], steps, i: int, at) -> np.ndarray:
    """What the word at one of the steps adds to a key."""
    with np.errstate(over="ignore"):
        return h.take(pos[steps[i]].take(at), mode="clip") * _MULTIPLIERS[i]


def _folded(total: np.ndarray) -> np.ndarray:
    return total ^ (total >> np.uint64(32))


def _key(h: np.ndarray, pos: dict[int, np.ndarray], steps, at) -> np.ndarray:
    """One hash of the words at some steps."""
    with np.errstate(over="ignore"):
        return _folded(sum(_share(h, pos, steps, i, at) for i in range(len(steps))))


class Bitmap:
    """Low bits of hashes that occur; most that don't are told apart by it."""

    def __init__(self, key: np.ndarray):
        bits = max(12, len(key).bit_length() + 5)  # one place in 32 is taken, or fewer
        self.low, self.seen = np.uint64((1 << bits) - 1), np.zeros(1 << bits, bool)
        self.seen[(key & self.low).view(np.int64)] = True

    def find(self, key: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.seen.take((key & self.low).view(np.int64), mode="clip"))


class Table:
    """Keys of item windows, sorted."""

    def __init__(self, key: np.ndarray, window: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.key, self.window, self.seen = key[order], window[order], Bitmap(key)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys, item window) of all agreements."""
        some = self.seen.find(key)
        if not len(some):
            return some, some
        asked = key.take(some)
        lo = self.key.searchsorted(asked)
        same = (self.key.take(lo, mode="clip") == asked).nonzero()[0]
        some, asked, lo = some.take(same), asked.take(same), lo.take(same)
        if not len(some):
            return some, some
        n = self.key.searchsorted(asked, "right") - lo
        return np.repeat(some, n), self.window[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


class Items:
    """A block of benchmark items: word hashes, item-sized windows, and the tables of each walk and size class."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words = [], []
        for item_id, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            _, _, h, _ = words(raw, np.array([0, len(raw)]), alnum=True)
            if len(h):
                self.ids.append(item_id)
                self.words.append(h)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.edits = self.size // EDITS
        cuts = [(i, o) for i, m in enumerate(self.size.tolist()) for o in sorted({*range(0, max(1, m - LONGEST + 1), LONGEST), max(0, m - LONGEST)})]
        self.item, self.offset = (np.array(x, np.int64) for x in (zip(*cuts, strict=True) if cuts else ((), ())))
        kind = np.searchsorted(SIZES, np.minimum(self.size[self.item], LONGEST), "right")
        # items lie one after another with room between, so that no walk enters the next one
        gap = np.zeros(2 * LONGEST + 2, np.uint64)
        flat = np.concatenate([x for w in self.words for x in (w, gap)] or [gap])
        starts = np.concatenate([[0], np.cumsum(self.size + len(gap))])[:-1].astype(np.int64)
        at = starts[self.item] + self.offset
        exact = np.flatnonzero(kind == 0)
        self.exact = Table(flat[at[exact]], exact) if len(exact) else None
        self.tables: list[tuple[int, list]] = []
        for walk in range(WALKS):
            groups, wanted = [], set()
            for c in np.unique(kind[kind > 0]).tolist():
                mine = np.flatnonzero(kind == c)
                plan = places(SIZES[c - 1], walk)
                steps = {t for first, second, thirds in plan for t in (first, second, *thirds)}
                pos, every = walked(flat, at[mine], walk, steps), np.arange(len(mine))
                for first in sorted({f for f, _, _ in plan}):
                    seconds = []
                    for _, second, thirds in (p for p in plan if p[0] == first):
                        # a walk over the item's end says nothing, nor does one that waits: one word is no evidence
                        pair = np.flatnonzero((flat[pos[first]] > 0) & (flat[pos[second]] > 0) & (pos[first] != pos[second]))
                        tables = []
                        for third in thirds:
                            real = pair[(flat[pos[third][pair]] > 0) & (pos[third][pair] != pos[first][pair]) & (pos[third][pair] != pos[second][pair])]
                            three = (first, second, third)
                            tables.append((three, Table(_key(flat, pos, three, real), mine[real])))
                        seconds.append(((first, second), Bitmap(_key(flat, pos, (first, second), pair)), tables))
                    groups.append((first, Bitmap(flat[pos[first]][every]), seconds))
                wanted |= steps
            if groups:
                self.tables.append((walk, groups, wanted))


def candidates(items: Items, h: np.ndarray, row: np.ndarray):
    """(row, item, first start, last start) of windows that may match, merged to intervals that do not overlap within a row and item.

    A start is a candidate if the walk from it and that of an item's window agree in the sampled places of one table. The starts as near as the item's edits
    go with it. Items that may have no edit are looked up by their first word.
    """
    start, window = [], []
    if items.exact:
        s, w = items.exact.find(h)
        start.append(s)
        window.append(w)
    padded = np.append(h, np.zeros(2 * LONGEST + 2, np.uint64))
    for a in range(0, len(h), STARTS):
        part, every = padded[a : a + STARTS + 2 * LONGEST + 2], np.arange(min(STARTS, len(h) - a))
        for walk, groups, wanted in items.tables:
            pos = walked(part, every, walk, wanted)
            for first, firsts, seconds in groups:
                word = part.take(pos[first], mode="clip")
                one = firsts.find(word)
                begun = word.take(one) * _MULTIPLIERS[0]
                for pair, pairs, tables in seconds:
                    sums = begun + _share(part, pos, pair, 1, one)
                    kept = pairs.find(_folded(sums))
                    two, sums = one.take(kept), sums.take(kept)
                    for three, table in tables:
                        at, w = table.find(_folded(sums + _share(part, pos, three, 2, two)))
                        if len(w):
                            start.append(a + two[at])
                            window.append(w)
    if not start or not sum(map(len, start)):
        return (np.zeros(0, np.int64),) * 4
    start, window = np.concatenate(start), np.concatenate(window)
    item = items.item[window]
    owner, at = row[start], start - items.offset[window]
    lo, hi = at - items.edits[item], at + items.edits[item]
    order = np.lexsort((lo, item, owner))
    owner, item, lo, hi = owner[order], item[order], lo[order], hi[order]
    fresh = np.ones(len(lo), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1])
    reach = 2 * (len(h) + int(items.size.max())) + 2
    group = np.cumsum(fresh)
    top = np.maximum.accumulate(hi + group * reach) - group * reach  # largest end so far in the row and item
    fresh[1:] |= lo[1:] > top[:-1] + 1
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(lo)) - 1
    return owner[first], item[first], lo[first], top[last]


def edit_distance(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Word edits between a and the best prefix of b, and that prefix's length."""
    ramp = np.arange(len(b) + 1)
    last = ramp.copy()
    for i, w in enumerate(a):
        now = np.empty_like(last)
        now[0] = i + 1
        now[1:] = np.minimum(last[:-1] + (b != w), last[1:] + 1)
        last = np.minimum.accumulate(now - ramp) + ramp  # insertions
    best = int(last.argmin())
    return int(last[best]), best


def search(items: Items, raw: np.ndarray, off: np.ndarray):
    """(row, item, edits, first word, words) of the best match of each item in each row of a block of texts.

    All starts of a candidate region are verified by the edit distance, unless they lack too many of the item's words to be better than what was found.
    """
    _, _, h, row = words(raw, off, alnum=True)
    first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(off) - 1))]).astype(np.int64)
    found: dict[tuple[int, int], tuple] = {}
    regions = [x.tolist() for x in candidates(items, h, row)]
    for r, i, lo, hi in zip(*regions, strict=True):  # equal windows first: nothing can come nearer
        m = int(items.size[i])
        for s in range(max(lo, int(first[r])), min(hi, int(first[r + 1]) - m) + 1):
            if (r, i) not in found and h[s] == items.words[i][0] and (h[s : s + m] == items.words[i]).all():
                found[r, i] = (0, s, m, s - int(first[r]))
    for r, i, lo, hi in zip(*regions, strict=True):
        m, e = int(items.size[i]), int(items.edits[i])
        if not e or found.get((r, i), (m,))[0] == 0:
            continue
        a, end = max(lo, int(first[r])), int(first[r + 1])
        last = min(hi, end - m + e)
        # every word of the item that the region, or then the window, lacks is an edit
        if last < a or m - int(np.isin(items.words[i], h[a : min(last + m + e, end)]).sum()) > e:
            continue
        lacks = {s: m - int(np.isin(items.words[i], h[s : min(s + m + e, end)]).sum()) for s in range(a, last + 1)}
        for s in sorted((s for s in lacks if lacks[s] <= e), key=lambda s: (lacks[s], s)):
            if (lacks[s], s) < found.get((r, i), (m, 0))[:2]:
                d, n = edit_distance(items.words[i], h[s : min(s + m + e, end)])
                if d <= e and (d, s) < found.get((r, i), (m, 0))[:2]:
                    found[r, i] = (d, s, n, s - int(first[r]))
    return [(r, i, d, at, n) for (r, i), (d, _, n, at) in sorted(found.items())]


def _shared(benchmark: DataFrame) -> list:
    """The stated query set, as broadcasts of so many items each; one at a time is in the driver's memory as rows."""
    context, rows, out = benchmark.sparkSession.sparkContext, [], []
    for r in benchmark.select("item_id", "text").toLocalIterator():
        rows.append((r.item_id, r.text))
        if len(rows) == ITEM_BLOCK:
            out.append(context.broadcast({"rows": rows}))
            rows = []
    return [*out, context.broadcast({"rows": rows})] if rows else out


def _built(held: dict) -> Items:
    """The tables of a block of items; a worker's later tasks find them in its copy of the broadcast."""
    if "items" not in held:
        held["items"] = Items(held["rows"])
    return held["items"]


def _found(shared: list, batches):
    """(batch, matches in it): (row, item_id, edits, first word, words), for the batch's last column."""
    every = [items for items in (_built(b.value) for b in shared) if items.ids]
    for batch in batches:
        got = []
        for at, raw, off in text_blocks(batch.column(batch.num_columns - 1)) if every else ():
            for items in every:
                got += [(at + r, items.ids[i], d, w, n) for r, i, d, w, n in search(items, raw, off)]
        yield batch, got


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, first_word, n_words): the best match of each benchmark item in each document that has one.

    Words are runs of letters, digits and non-ASCII signs, A-Z as a-z. All windows of all documents are searched: walks and sampled places find candidates, the
    edit distance decides. What is found is right; what has its full number of edits is missed now and then (README gives the measured recall). The items
    are the stated query set and go to the tasks in blocks. Null and empty texts and items without a word match nothing; repeated documents and items are
    each reported, ties in edits go to the first window; empty tables give an empty result; other columns are not read.
    """
    kind, item_kind = (docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString())
    shared = _shared(benchmark)

    def run(batches):
        import pyarrow as pa

        for batch, got in _found(shared, batches):
            row, item, d, w, n = zip(*got, strict=True) if got else ([], [], [], [], [])
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(item, pa.int64()), pa.array(d, pa.int32()), pa.array(w, pa.int64()), pa.array(n, pa.int32())], ["doc_id", "item_id", "edits", "first_word", "n_words"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id long, edits int, first_word long, n_words int")
    return out.withColumn("item_id", F.col("item_id").cast(item_kind))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found, columns as they are.

    Each row is judged by its own text as it passes by, whatever its doc_id: nothing is joined or shuffled. Null texts stay; an empty table stays empty.
    """
    shared = _shared(benchmark)
    ordered = docs.select(*(c for c in docs.columns if c != "text"), "text")

    def run(batches):
        import pyarrow as pa

        for batch, got in _found(shared, batches):
            stays = np.ones(batch.num_rows, bool)
            stays[[r for r, *_ in got]] = False
            yield batch.filter(pa.array(stays))

    return ordered.mapInArrow(run, ordered.schema).select(*docs.columns)


def op10_cgk_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
