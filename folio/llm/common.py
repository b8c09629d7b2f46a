"""Bounded broadcasts and vectorised word hashing for the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.session import staged

__all__ = ["mix", "shingle_sets", "small", "staged", "text_blocks", "words", "grams", "WORD"]

WORD = "[^\\x20\\x09-\\x0D]+"
#: Small tables are broadcast only up to this many rows and list elements, counted first.
BROADCAST_ROWS = 20_000
#: Rows of one key that go to one task of a join with one row a key.
SPLIT = 4096


def small(df: DataFrame, lists: str | None = None) -> DataFrame:
    """Mark a staged table of few rows (and few elements in its column of lists) for broadcast; a larger one is joined as any other."""
    size = F.count("*") + (F.coalesce(F.sum(F.size(lists)), F.lit(0)) if lists else F.lit(0))
    return F.broadcast(df) if df.agg(size).first()[0] <= BROADCAST_ROWS else df


def with_each(rows: DataFrame, per: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """Join many rows a key with one row a key. ``count`` says how many rows a key has: those of very many are dealt to several tasks, and the one row to each."""
    parts = F.ceil(F.col(count) / SPLIT)
    hot = small(staged(per.filter(F.col(count) > SPLIT).select(key, parts.alias("_parts")), "hot"))
    dealt = rows.join(hot, key, "left").withColumn("_part", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*(c for c in rows.columns if c != key)), "_parts")).cast("long")).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col(count) > SPLIT, parts - 1).otherwise(F.lit(0)).cast("long")))
    return dealt.join(per.withColumn("_part", copies), [key, "_part"], how).drop("_part")


# --- vectorised hashing of the words of an Arrow batch -----------------------------------------------------------
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Bytes of text that are hashed at once; a longer document is a block of its own.
BLOCK = 1 << 20
_POW: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, BLOCK)
        with np.errstate(over="ignore"):
            _POW[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, r, np.uint64)]), dtype=np.uint64) for r in (_R, _RINV)]
    return _POW


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_blocks(column):
    """(first row, byte array, row offsets) of an Arrow string column, in blocks of whole rows; null is empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1)
        yield i, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(raw: np.ndarray, off: np.ndarray, lower: bool = True, alnum: bool = False):
    """Start, end, hash and row of every word of a block; words never cross rows.

    A word is a run of bytes other than ASCII white space or, with ``alnum``, other than any ASCII sign; A-Z count as a-z with ``lower``.
    """
    n = len(raw)
    gap = (_ALNUM_GAP if alnum else _SPACE)[raw]
    inside = np.zeros(n + 2, bool)
    inside[1 : n + 1] = ~gap
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edge = off[(off > 0) & (off < n)]
    starts[edge[inside[1:-1][edge]]] = True
    ends[edge[inside[1:-1][edge - 1]] - 1] = True
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[raw] if lower else raw] * up[:n], out=total[1:])
        h = mix((total[e] - total[s]) * down[s])
    return s, e, h, np.searchsorted(off, s, "right") - 1


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; only whole runs count."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0xD1342543DE82EF95) + h[i : i + n]
    return mix(out)


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int):
    """Distinct k-word shingles of each row of a block: (hashes sorted within rows, row bounds).

    A row with fewer words has its whole word sequence as its one shingle; a row without words has none.
    """
    rows = len(off) - 1
    _, _, h, row = words(raw, off)
    n = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(n)])
    g = grams(h, k)
    whole = row[: len(g)] == row[k - 1 :] if len(g) else np.zeros(0, bool)
    value, owner = g[whole], row[: len(g)][whole]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        with np.errstate(over="ignore"):
            one = np.array([mix(np.array([len(w) + sum(int(x) * pow(31, i, 2**64) for i, x in enumerate(w)) & (2**64 - 1)], dtype=object).astype(np.uint64))[0] for w in (h[first[r] : first[r + 1]] for r in short)], np.uint64)
        value, owner = np.concatenate([value, one]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])
