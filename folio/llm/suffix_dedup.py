"""Exact substring deduplication by external suffix sorting of the places where texts can agree."""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import common
from folio.llm.common import mix, staged, text_blocks
from folio.llm.induced_sort import repeated_starts

LENGTH = 400
#: Bytes of the grams by which windows are dealt: a window belongs to the gram of smallest hash in it. Where the pieces of one gram are too many for a
#: shard, they are dealt again by grams of the next length, and last by whole windows.
GRAMS = (200, 380, LENGTH)
#: Bytes of pieces that make a shard; of one gram from which it is dealt again; between the places where pieces are compared before they are sorted.
SHARD, HOT, GRID = 1 << 21, 1 << 23, 20


class Windows:
    """The windows of ``length`` bytes in a block of rows: hashes of prefixes, smallest grams, and pieces (runs of windows with one smallest gram)."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, length: int, gram: int, cut: bool = True):
        n, span = len(raw), length - gram + 1
        up, self.down = common._powers(n)
        with np.errstate(over="ignore"):
            self.total = np.zeros(n + 1, np.uint64)
            np.cumsum(common._BYTE[raw] * up[:n], out=self.total[1:])
        self.a = self.b = self.anchor = np.zeros(0, np.int64)
        self.many = np.zeros(0, bool)
        with np.errstate(over="ignore"):
            self.grams = grams = mix((self.total[gram:] - self.total[:-gram]) * self.down[: max(0, n - gram + 1)])
        if n < length or not cut:
            return
        least = _sliding(grams, span, np.minimum)
        row = np.repeat(np.arange(1, len(off)), np.diff(off))[: len(least)]
        whole = np.arange(len(least)) + length <= off[np.minimum(row, len(off) - 1)]
        turn = np.ones(len(least), bool)
        turn[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
        a = np.flatnonzero(turn)
        b = np.append(a[1:], len(least))
        a, b = a[whole[a]], b[whole[a]]
        self.a, self.b, self.anchor = a, b, least[a]
        # places that are the smallest of some window; two in a row of equal hash: the piece may hold equal windows
        most = _sliding(np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)]), span, np.maximum)
        place = np.flatnonzero(grams == most)
        again = np.concatenate([[0], np.cumsum(grams[place[1:]] == grams[place[:-1]])])
        lo, hi = np.searchsorted(place, a), np.searchsorted(place, b - 1 + span) - 1
        self.many = again[np.maximum(hi, 0)] > again[np.minimum(lo, len(again) - 1)] if len(place) else np.zeros(len(a), bool)

    def hash(self, start: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[start + length] - self.total[start]) * self.down[start])


def _sliding(v: np.ndarray, width: int, pick) -> np.ndarray:
    span = 1
    out = v
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    return pick(out[: len(out) - (width - span)], out[width - span :]) if span < width else out


def _segments(raw: np.ndarray, off: np.ndarray, length: int):
    """Blocks of rows as they are; a very long row in overlapping parts, so that every window is in one: (bytes, offsets, row, start)."""
    step = 2 * common.BLOCK
    if len(off) == 2 and len(raw) > step:
        for at in range(0, len(raw) - length + 1, step):
            part = raw[at : at + step + length - 1]
            yield part, np.array([0, len(part)]), np.zeros(len(part), np.int64), at
    else:
        yield raw, off, None, 0


def _text_key(total: np.ndarray, down: np.ndarray, off: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((total[off[1:]] - total[off[:-1]]) * down[off[:-1]] + np.diff(off).astype(np.uint64)).view(np.int64)


def _keys(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    up, down = common._powers(len(raw))
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(common._BYTE[raw] * up[: len(raw)], dtype=np.uint64)])
    return _text_key(total, down, off)


PIECE = "doc_id long, anchor long, piece long, text_key long, a long, n long, many boolean"


def _pieces(ids, keys, rows, first, raw, off, length: int, gram: int):
    """An Arrow batch of the pieces of a block: each row's id, text key and first byte in its text."""
    import pyarrow as pa

    w = Windows(raw, off, length, gram)
    row = np.searchsorted(off, w.a, "right") - 1
    with np.errstate(over="ignore"):
        body = mix(w.hash(w.a, w.b - w.a + length - 1) + (w.b - w.a).astype(np.uint64))
    arrays = [w.anchor.view(np.int64), body.view(np.int64), keys[row], w.a - off[row] + first[row], w.b - w.a]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(rows[row])), *(pa.array(x, pa.int64()) for x in arrays), pa.array(w.many)], ["doc_id", "anchor", "piece", "text_key", "a", "n", "many"])


def pieces(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, text) -> one row per piece: smallest gram, hash of all the piece's bytes, the row's text key, first window, windows, and whether its gram recurs in it."""

    def run(batches):
        for batch in batches:
            for at, raw, off in text_blocks(batch.column(1)):
                key = _keys(raw, off)
                rows = at + np.arange(len(key))
                for part, ends, _, start in _segments(raw, off, length):
                    yield _pieces(batch.column(0), key, rows, np.full(len(key), start), part, ends, length, gram)

    return docs.mapInArrow(run, PIECE)


def shared_pieces(bodies: DataFrame, length: int, gram: int) -> DataFrame:
    """(shard, anchor, piece, n, many, once, body), all of a shard in a row -> (anchor, piece, starts, ends): windows that occur in two pieces, or twice in one.

    A shard's pieces are gathered on disk. Pieces that share no run of about the window's length around their gram with another are left out; the
    suffixes of the others are sorted by external induction, and neighbours in that order that have a whole window in common are marked.
    """

    def settle(folder, rows):
        if not rows:
            return
        raw = np.memmap(f"{folder}/text", np.uint8, "r")
        size = np.array([r[2] + length - 1 for r in rows])
        start = np.concatenate([[0], np.cumsum(size)])
        anchor = np.array([r[0] for r in rows])
        keep = _candidates(raw, start, anchor, length, gram)
        if not keep.any():
            return
        chosen = np.flatnonzero(keep)
        ends = np.cumsum(size[chosen] + 1)
        starts = ends - size[chosen] - 1
        text = np.zeros(ends[-1], np.uint16)
        for i, s in zip(chosen.tolist(), starts.tolist(), strict=True):
            text[s : s + size[i]] = raw[start[i] : start[i + 1]].astype(np.uint16) + 1
        hit = repeated_starts(text, starts, length)
        for i, s in zip(chosen.tolist(), starts.tolist(), strict=True):
            if rows[i][4]:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[s : s + rows[i][2]].view(np.int8), [0]])))
                if len(edge):
                    yield rows[i][0], rows[i][1], edge[::2].tolist(), edge[1::2].tolist()

    def run(batches):
        import pyarrow as pa

        folder, shard, rows = tempfile.mkdtemp(prefix="folio-shard-"), None, []

        def done():
            made = list(zip(*settle(folder, rows), strict=True)) or [[]] * 4
            rows.clear()
            if os.path.exists(f"{folder}/text"):
                os.remove(f"{folder}/text")
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds, strict=True)], ["anchor", "piece", "starts", "ends"])

        try:
            for batch in batches:
                for s, anchor, piece, n, many, once, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if s != shard:
                        if rows:
                            yield done()
                        shard = s
                    with open(f"{folder}/text", "ab") as f:
                        f.write(body)
                    rows.append((anchor, piece, n, many, once))
            if rows:
                yield done()
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return bodies.mapInArrow(run, "anchor long, piece long, starts array<long>, ends array<long>")


def _candidates(raw, start, anchor, length, gram):
    """Pieces that may share a window: equal windows have their gram at the same distance d, and agree from d - d % GRID on for the length less GRID.

    Piece by piece, in blocks: a few hashes at each place of the gram are kept. Two places in one piece count as two.
    """
    keep = np.zeros(len(anchor), bool)
    reach = length - gram
    n = gram + max(0, reach - GRID)
    seen: dict[int, list] = {left: [] for left in range(0, reach + 1, GRID)}
    i = 0
    while i < len(start) - 1:
        j = max(i + 1, int(np.searchsorted(start, start[i] + common.BLOCK, "right")) - 1)
        off = start[i : j + 1] - start[i]
        w = Windows(np.asarray(raw[start[i] : start[j]]), off, length, gram, False)
        row = np.repeat(np.arange(j - i), np.diff(off))[: len(w.grams)]
        at = np.flatnonzero(w.grams.view(np.int64) == anchor[i + row])
        at = at[at + gram <= off[row[at] + 1]]
        row = row[at]
        for left, parts in seen.items():
            a = at - left
            fits = (a >= off[row]) & (a + n <= off[row + 1])
            parts.append((w.hash(a[fits], n), i + row[fits]))
        i = j
    for parts in seen.values():
        h, row = (np.concatenate(x) for x in zip(*parts, strict=True))
        back, count = np.unique(h, return_inverse=True, return_counts=True)[1:]
        keep[row[count[back] > 1]] = True
    return keep


def _asked(docs: DataFrame, kinds: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over (doc_id, text, asked): the texts that ``kinds`` names, with the pieces that are asked for in each."""
    one = F.struct("text_key", "anchor", "piece", "a", "n", "many", (F.col("copies") == 1).alias("once"))
    asked = kinds.groupBy("doc_id").agg(F.collect_list(one).alias("asked"))  # pieces of one document (of one id)
    return docs.join(asked.hint("merge"), "doc_id").select("doc_id", "text", "asked").mapInArrow(run, schema)


def _settled(found: DataFrame, docs: DataFrame, length: int, grams: tuple[int, ...]) -> DataFrame:
    """(doc_id, text_key, s, e): ranges of window starts that are repeats, of the windows in the pieces found.

    Pieces with a gram of their own hold no repeat and are dropped; pieces that occur twice as a whole are repeats as a whole; of the rest one copy of
    each goes to a shard with all others of its gram. Where these are too many, equal windows still have an equal longer gram: their pieces are cut again.
    """
    size = F.col("n") + (length - 1)
    kinds = found.groupBy("anchor", "piece").agg(F.count("*").alias("copies"), F.max("many").alias("many"), F.min(F.struct("doc_id", "text_key", "a", "n")).alias("one"))
    per = kinds.groupBy("anchor").agg(F.sum("copies").alias("all"), F.count("*").alias("kinds"), F.max("many").alias("any_many"), F.sum(F.col("one.n") + (length - 1)).alias("bytes"))
    per = per.filter("all > 1 or any_many").select("anchor", "kinds", "bytes")
    kinds = staged(kinds.join(per.hint("merge"), "anchor").filter("copies > 1 or kinds > 1 or many").select("anchor", "piece", "copies", "many", "kinds", "bytes", "one.*"), "kinds")

    twice = kinds.filter("copies > 1").select("anchor", "piece")
    out = found.join(twice.hint("merge"), ["anchor", "piece"], "left_semi").select("doc_id", "text_key", F.col("a").alias("s"), (F.col("a") + F.col("n")).alias("e"))
    sort = kinds.filter("kinds > 1 or (many and copies = 1)")
    hot = F.col("bytes") > HOT if grams[1:] else F.lit(False)
    total, many_hot = sort.agg(F.sum(F.when(~hot, size)), F.sum(F.when(hot, size))).first()
    shards = max(1, -(-(total or 0) // SHARD))

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for at, raw, off in text_blocks(batch.column(1)):
                rows = []
                for i, key in enumerate(_keys(raw, off).tolist()):
                    for x in batch.column(2)[at + i].as_py():
                        if x["text_key"] == key:
                            s = off[i] + x["a"]
                            rows.append((x["anchor"] % shards, x["anchor"], x["piece"], x["n"], x["many"], x["once"], raw[s : s + x["n"] + length - 1].tobytes()))
                made = list(zip(*rows, strict=True)) or [[]] * 7
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, types, strict=True)], ["shard", "anchor", "piece", "n", "many", "once", "body"])

    def cut_again(batches):
        for batch in batches:
            for at, raw, off in text_blocks(batch.column(1)):
                found = [(i, key, off[i] + x["a"], x["a"], x["n"]) for i, key in enumerate(_keys(raw, off).tolist()) for x in batch.column(2)[at + i].as_py() if x["text_key"] == key]
                if found:
                    row, key, start, first, n = np.array(found, np.int64).T
                    bodies = [raw[s : s + k + length - 1] for s, k in zip(start.tolist(), n.tolist(), strict=True)]
                    yield _pieces(batch.column(0), key, at + row, first, np.concatenate(bodies), np.cumsum([0, *map(len, bodies)]), length, grams[1])

    if total:
        bodies = _asked(docs, sort.filter(~hot), cut, "shard long, anchor long, piece long, n long, many boolean, once boolean, body binary")
        bodies = bodies.dropDuplicates(["anchor", "piece"]).repartition(int(min(shards, 4096)), "shard").sortWithinPartitions("shard")
        some = shared_pieces(bodies, length, grams[0]).join(kinds.select("anchor", "piece", "doc_id", "text_key", "a"), ["anchor", "piece"])
        some = some.select("doc_id", "text_key", "a", F.explode(F.arrays_zip("starts", "ends")).alias("z"))
        out = out.union(some.select("doc_id", "text_key", (F.col("a") + F.col("z.starts")).alias("s"), (F.col("a") + F.col("z.ends")).alias("e")))
    if many_hot:
        again = staged(_asked(docs, sort.filter(hot), cut_again, PIECE).distinct(), "pieces")
        out = out.union(_settled(again, docs, length, grams[1:]))
    return out


def marks(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """(doc_id, text) -> (doc_id, text_key, s, e): ranges of window starts that begin ``length`` bytes which also begin elsewhere.

    Windows are dealt by the smallest gram in them, which equal windows share; a run of windows with one smallest gram is a piece.
    """
    found = staged(pieces(docs, length, grams[0]), "pieces")
    return staged(_settled(found, docs, length, grams).distinct(), "marks")


def removed_spans(off: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Byte ranges covered by windows that start in the given ranges, merged."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], ends[order] - 1 + length
    top = np.maximum.accumulate(b)
    fresh = np.ones(len(a), bool)
    fresh[1:] = a[1:] > top[:-1]
    first = np.flatnonzero(fresh)
    return np.column_stack([a[first], np.append(top[first[1:] - 1], top[-1])])


def deduplicate(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, spans, kept): every byte of ``length`` bytes that also start elsewhere is removed, judged on the input.

    Texts are UTF-8 bytes, null is empty, and no match crosses documents; repeated rows are documents of their own and so lose all windows; texts
    shorter than a window stay whole; ``kept`` are the other bytes; ``spans`` the removed ranges, start and end by turns. A null doc_id is a value like
    others. An empty table gives an empty result; other columns are not read. Pieces that agree as a whole are told by 64-bit hashes of all their bytes, all
    other repeats by the order of suffixes.
    """
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), "text")
    by_doc = marks(slim, length, grams).groupBy("doc_id").agg(F.collect_list(F.struct("text_key", "s", "e")).alias("marks"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, raw, off in text_blocks(batch.column(1)):
                size, spans, kept = [], [], []
                for i, key in enumerate(_keys(raw, off).tolist()):
                    mine = [x for x in batch.column(2)[at + i].as_py() or [] if x["text_key"] == key]
                    text = raw[off[i] : off[i + 1]]
                    cut = np.zeros((0, 2), np.int64)
                    if mine:
                        cut = removed_spans(off, np.array([x["s"] for x in mine]), np.array([x["e"] for x in mine]), length)
                    stay = np.concatenate([[0], cut.ravel(), [len(text)]]).reshape(-1, 2)
                    size.append(len(text))
                    spans.append(cut.ravel().tolist())
                    kept.append(b"".join(text[a:b].tobytes() for a, b in stay.tolist()))
                ids = batch.column(0).slice(at, len(size))
                yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    out = slim.join(by_doc.hint("merge"), "doc_id", "left").select("doc_id", "text", "marks").mapInArrow(run, "doc_id long, n_bytes long, spans array<long>, kept binary")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(-(2**63))))


def op6_induced_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is removed and kept, and the kept text itself (a cut inside a character leaves a replacement sign in it)."""
    out = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = ((F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return out.select("doc_id", "n_bytes", *counts, F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
