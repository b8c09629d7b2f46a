"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bound of the training sample: so many texts per language, whole ones, of up to SHORT characters where there are such, and BUDGET characters in all. A
#: language whose shortest chosen text is longer than that is learned from so much of it.
TEXTS, SHORT, BUDGET = 48, 1500, 80_000
#: Texts are parsed in pieces of so many characters side by side; the parses are then joined to that of the whole text.
PIECE = 512
#: Characters parsed at once.
BLOCK = 1 << 21


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a symbol sequence, a dict per state; state 0 is the start."""
    size = 2 * len(codes) + 2
    step, link, length = [dict() for _ in range(size)], [-1] * size, [0] * size
    last, n = 0, 1
    for c in codes.tolist():
        cur, n = n, n + 1
        length[cur] = length[last] + 1
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone, n = n, n + 1
                length[clone], step[clone], link[clone] = length[p] + 1, dict(step[q]), link[q]
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step[:n]


class Automaton:
    """Transitions in one array for all states: that of state s by symbol c stands at base[s] + c if check says it is of s. The start's are in ``root``."""

    def __init__(self, step: list[dict[int, int]], symbols: int, seed: int = 1):
        self.root = np.zeros(symbols, np.int32)  # 0: no phrase begins with the symbol but the symbol itself
        for c, t in step[0].items():
            self.root[c] = t
        n_edges = sum(map(len, step[1:]))
        size = 2 * n_edges + 2 * symbols
        self.base = np.zeros(len(step), np.int32)
        self.check, self.next = np.full(size + symbols, -1, np.int32), np.zeros(size + symbols, np.int32)
        free, rng = bytearray(b"\1") * size, np.random.default_rng(seed)
        several = sorted((s for s in range(1, len(step)) if len(step[s]) > 1), key=lambda s: -len(step[s]))
        tries = iter(())
        for s in several:
            edges = step[s]
            while True:
                b = next(tries, None)
                if b is None:
                    tries = iter(rng.integers(0, size - symbols, 1 << 16).tolist())
                elif all(free[b + c] for c in edges):
                    break
            self.base[s] = b
            for c, t in edges.items():
                free[b + c] = 0
                self.check[b + c], self.next[b + c] = s, t
        one = [(s, *next(iter(e.items()))) for s, e in enumerate(step) if s and len(e) == 1]
        if one:
            s, c, t = np.array(one).T
            slot = np.flatnonzero(np.frombuffer(bytes(free), np.uint8)[symbols:])[: len(s)] + symbols
            self.base[s], self.check[slot], self.next[slot] = slot - c, s, t


class Model:
    """Suffix automata of each language's sample and the symbol table they share."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        points = np.concatenate([_points(t) for t in samples.values()] or [np.zeros(0, np.uint32)])
        letters = np.unique(points[_letter(points)])
        self.table = np.ones(0x110000, np.int32)  # 1: a letter of no sample, a phrase of its own in any language
        self.table[~_letter(np.arange(0x110000, dtype=np.uint32))] = 0
        self.table[letters] = np.arange(2, 2 + len(letters))
        self.automata = [Automaton(suffix_automaton(self.codes(samples[k])), len(letters) + 2) for k in self.langs]

    def codes(self, text: str) -> np.ndarray:
        """Symbols of a text: lower-case letters, every run of other characters one gap."""
        c = self.table[_points(text)]
        return c[(c > 0) | np.concatenate([[True], c[:-1] > 0])] if len(c) else c

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases (texts x languages) of the greedy parse of each whole text into longest matches; a symbol without a match is a phrase.

        All pieces are parsed from their starts side by side. Where a piece's last phrase ends in the next one, the parse goes on from there until it comes to a
        phrase start of that piece's own parse; from there on both are the same.
        """
        size = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate([np.zeros(0, np.int32), *texts])
        n = -(-size // PIECE)
        owner = np.repeat(np.arange(len(texts)), n)
        bound = np.cumsum(size)  # ends of texts
        start = np.repeat(bound - size, n) + PIECE * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
        end = np.minimum(start + PIECE, bound[owner])
        out = np.zeros((len(texts), len(self.langs)))
        for k, a in enumerate(self.automata):
            begins, state = self._pieces(a, flat, start, end)
            extra, joined = self._joins(a, flat, end, bound[owner], begins, state)
            into = np.searchsorted(start, joined, "right") - 1
            count = np.concatenate([[0], np.cumsum(begins)])
            at, from_, text = np.cumsum(n) - n, bound - size, np.arange(len(texts))
            at, from_, text = at[n > 0], from_[n > 0], text[n > 0]
            while len(text):  # from each text's piece to the one in which its parse goes on
                out[text, k] += count[end[at]] - count[from_] + extra[at]
                going = joined[at] < bound[text]
                at, from_, text = into[at[going]], joined[at[going]], text[going]
        return out

    @staticmethod
    def _pieces(a: Automaton, flat, start, end):
        """Where phrases begin if each piece is parsed from its start, and the state at its end."""
        order = np.argsort(start - end, kind="stable")
        first, length = start[order], (end - start)[order]
        active = np.searchsorted(-length, -np.arange(PIECE), "left")  # pieces longer than t
        begins, s = np.zeros(len(flat), bool), np.zeros(len(order), np.int32)
        for t in range(PIECE):
            m = active[t]
            if not m:
                break
            at = first[:m] + t
            c = flat[at]
            edge = a.base[s[:m]] + c
            begin = a.check[edge] != s[:m]
            begins[at] = begin
            s[:m] = np.where(begin, a.root[c], a.next[edge])
        state = np.empty_like(s)
        state[order] = s
        return begins, state

    @staticmethod
    def _joins(a: Automaton, flat, end, bound, begins, state):
        """From each piece's end on: phrases that begin before the parse meets a phrase start of another piece's parse, and where that is (or the text's end)."""
        extra, joined = np.zeros(len(end), np.int64), bound.copy()
        live = np.flatnonzero(end < bound)
        at, s = end[live].copy(), state[live]
        while len(live):
            c = flat[at]
            edge = a.base[s] + c
            begin = a.check[edge] != s
            met = begin & begins[at]
            joined[live[met]] = at[met]
            extra[live[begin & ~met]] += 1
            s = np.where(begin, a.root[c], a.next[edge])
            at = at + 1
            stay = ~met & (at < bound[live])
            live, at, s = live[stay], at[stay], s[stay]
        return extra, joined


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


_LETTERS: list[np.ndarray] = []


def _letter(points: np.ndarray) -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0][points]


def training_sample(labelled: DataFrame) -> dict[str, str]:
    """(text, lang, hash) -> each language's sample: in each of TEXTS hash classes the short text of lowest hash, or the shortest if the class has no short one;
    of these, from the shortest on, as many whole ones as BUDGET holds. That much reaches the driver, however long the texts are."""
    part = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("n", F.length("text"))
    by = F.struct(F.greatest("n", F.lit(SHORT)), "hash", "text")
    chosen = part.groupBy("lang", F.pmod("hash", F.lit(TEXTS)).alias("class")).agg(F.min_by(F.struct("text", "n"), by).alias("c")).select("lang", "class", "c.*")
    order = Window.partitionBy("lang").orderBy("n", "class")  # TEXTS rows a language
    fits = chosen.withColumn("sum", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("first", F.row_number().over(order) == 1)
    rows = fits.filter(F.col("first") | (F.col("sum") <= BUDGET)).select("lang", "class", F.substring("text", 1, BUDGET).alias("text"))
    samples: dict[str, list[str]] = {}
    for r in sorted(rows.collect()):
        samples.setdefault(r.lang, []).append(r.text)
    return {k: "\n".join(v) for k, v in samples.items()}


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """(doc_id, text) -> (doc_id, lang_pred, score): the language whose sample parses the whole text into the fewest phrases.

    Phrase counts are divided by the text's symbols; the score is one minus the ratio of the best to the next best count (1 with one language). Null
    texts, texts without a letter, and all texts if there is no language give ``und`` and 0; ties go to the first language by name; an empty table gives
    an empty result; other columns are not read. The model is as large as the samples, which are bounded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Model(samples))

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            texts = batch.column(1)
            langs, scores, at = ["und"] * len(texts), [0.0] * len(texts), 0
            while at < len(texts):
                block, room = [], BLOCK
                while at < len(texts) and (room > 0 or not block):
                    text = texts[at].as_py()
                    codes = model.codes(text or "")
                    if model.langs and (codes > 0).any():
                        block.append((at, codes))
                    room -= len(codes) + 64
                    at += 1
                counts = model.phrases([c for _, c in block]) / np.array([[len(c)] for _, c in block]).reshape(-1, 1)
                for (i, _), row in zip(block, counts, strict=True):
                    best = int(row.argmin())
                    rest = np.delete(row, best)
                    langs[i] = model.langs[best]
                    scores[i] = float(1 - row[best] / rest.min()) if len(rest) and rest.min() > 0 else 1.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    train = docs.filter(rest != 2).select("text", "lang", F.xxhash64("text").alias("hash"))
    out = identify(docs, training_sample(train))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
