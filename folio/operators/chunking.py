"""Chunkers: fixed, paragraph, semantic, software and math."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from folio.functions import patterns as P
from folio.functions.text import lines, ustrip
from folio.session import by_slices, spread

MAX_CHARS = 1500
#: Boundaries from the largest to the smallest; the last resort is any character.
BOUNDARIES = [re.compile(p) for p in (r"\n\s*\n", r"\n", r"(?<=[.!?])\s+", r"\s+")]


def split_text(text: str, limit: int = MAX_CHARS, level: int = 0) -> list[str]:
    """Pieces of at most ``limit`` characters in order, cut at the largest boundary that serves and filled up greedily."""
    if len(text) <= limit:
        return [text]
    if level == len(BOUNDARIES):
        return [text[i : i + limit] for i in range(0, len(text), limit)]
    cuts = [m.end() for m in BOUNDARIES[level].finditer(text)]
    parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True) if b > a]
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(part) <= limit:
            out[-1] += part
        else:
            out += split_text(part, limit, level + 1)
    return out


def _prose(text: str, limit: int) -> list[dict]:
    return [{"text": p.strip(), "code_blocks": []} for p in split_text(text, limit) if p.strip()]


_FENCE, _INDENT, _REF = re.compile(P.CODE_FENCE), re.compile(P.INDENTED), re.compile(P.PLACEHOLDER)


def _software(text: str, limit: int) -> list[dict]:
    """Code goes out of the prose into numbered blocks, fences first; each chunk takes back the blocks it refers to. Chunks of references alone go."""
    fences = list(_FENCE.finditer(text))
    blocks, parts, at = [m[1].strip() for m in fences], [], 0
    for i, fence in enumerate([*fences, None]):
        between = text[at : fence.start() if fence else None]
        seen = 0
        for line in _INDENT.finditer(between):
            parts += [between[seen : line.start()], f"\n[CODE_{len(blocks)}]\n"]
            blocks.append(line[1].rstrip())
            seen = line.end()
        parts.append(between[seen:])
        if fence:
            parts.append(f"\n[CODE_{i}]\n")
            at = fence.end()
    prose = "".join(parts)
    out = []
    for piece in split_text(prose, limit):
        numbers = [int(r[6:-1]) for r in _REF.findall(piece)]
        clean = _REF.sub("", piece).strip()
        if clean:
            out.append({"text": clean, "code_blocks": [blocks[n] for n in numbers if n < len(blocks)]})
    return out


PIECES = ArrayType(StructType([StructField("text", StringType()), StructField("code_blocks", ArrayType(StringType()))]))


def _chunk_udf(split, limit: int):
    return by_slices(lambda t: split(t or "", limit), PIECES)


def _numbered(df: DataFrame, pieces, kind: str | None = None) -> DataFrame:
    cols = [c for c in df.columns if c != "text"]
    out = df.select(*cols, F.posexplode(pieces).alias("chunk_idx", "piece"))
    out = out.select(*cols, "chunk_idx", F.col("piece.text").alias("text"), F.col("piece.code_blocks").alias("code_blocks"))
    out = out.withColumn("has_code", F.size("code_blocks") > 0)
    return out if kind is None else out.withColumn("route", F.lit(kind))


def chunk_prose(df: DataFrame, kind: str | None = "selfhelp", limit: int = MAX_CHARS) -> DataFrame:
    """(.., text) -> a row per chunk: chunk_idx, text, code_blocks, has_code, route. Blank chunks go."""
    return _numbered(df, _chunk_udf(_prose, limit)("text"), kind)


def chunk_software(df: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    return _numbered(df, _chunk_udf(_software, limit)("text"), "software")


def without_formulas(text):
    """Formulas become a space, and lines of at most 20 characters go."""
    clean = F.regexp_replace(text, P.FORMULA, " ")
    return F.array_join(F.filter(lines(clean), lambda x: F.length(ustrip(x)) > 20), "\n")


def chunk_math(df: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    return chunk_prose(df.withColumn("text", without_formulas(F.col("text"))), "math", limit)


def chunk_routed(df: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """Each document by the chunker that its ``route`` names, in one pass."""
    run = by_slices(lambda t, r: (_software if r == "software" else _prose)(t or "", limit), PIECES)

    ready = df.withColumn("text", F.when(F.col("route") == "math", without_formulas(F.col("text"))).otherwise(F.col("text")))
    return _numbered(ready, run("text", "route"))


def chunk_fixed(df: DataFrame, size: int = MAX_CHARS) -> DataFrame:
    """Cut every ``size`` characters."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / size)).cast("int")
    cols = [c for c in df.columns if c != "text"]
    out = df.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.select(*cols, "chunk_idx", F.substring(F.col("text"), F.col("chunk_idx") * size + 1, F.lit(size)).alias("text"))


def chunk_paragraph(df: DataFrame) -> DataFrame:
    """Cut at blank lines; blank paragraphs go but keep their number."""
    cols = [c for c in df.columns if c != "text"]
    out = df.select(*cols, F.posexplode(F.split("text", r"\n[ \t]*\n")).alias("chunk_idx", "_p"))
    return out.select(*cols, "chunk_idx", ustrip(F.col("_p")).alias("text")).filter(F.length("text") > 0)


def merge_similar(chunks: DataFrame, vectors: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Neighbouring chunks of a document whose vectors reach the cosine threshold become one: (doc key ``ref``, chunk_idx, text) and (ref, chunk_idx, embedding)."""
    from pyspark.sql import Window

    from folio.functions.text import cosine

    w = Window.partitionBy("ref").orderBy("chunk_idx")
    both = chunks.join(vectors, ["ref", "chunk_idx"]).withColumn("_new", (F.coalesce(cosine(F.col("embedding"), F.lag("embedding").over(w)), F.lit(-1.0)) < threshold).cast("int"))
    run = both.withColumn("_run", F.sum("_new").over(w))
    merged = run.groupBy("ref", "_run").agg(F.min("chunk_idx").alias("chunk_idx"), F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))).alias("_t"))
    return merged.select("ref", "chunk_idx", F.array_join(F.transform("_t", lambda x: x["text"]), "\n").alias("text"))


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Numbers of a sentence's vector, and what one more chunk costs against the scatter within chunks.
SENTENCE_DIM, CHUNK_COST = 64, 0.8


def sentence_vectors(sentences: list[str], dim: int = SENTENCE_DIM) -> np.ndarray:
    """Signed hashed counts of the words of each sentence, at unit length; a sentence without words is zero."""
    words = [s.lower().split() for s in sentences]
    number = {w: zlib.crc32(w.encode("utf-8", "replace")) for ws in words for w in ws}
    v = np.zeros((len(sentences), dim))
    if number:
        h = np.array([number[w] for ws in words for w in ws], np.int64)
        np.add.at(v, (np.repeat(np.arange(len(words)), [len(ws) for ws in words]), h % dim), np.where(h >> 31, 1.0, -1.0))
    length = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(length > 0, length, 1)


def segmented(v: np.ndarray, size: np.ndarray, limit: int, cost: float = CHUNK_COST) -> tuple[list[int], float]:
    """(ends of the segments, cost) of the cheapest division of a row of vectors: ``cost`` a segment plus the squared distances to the segments' means.

    Segments of several vectors have ``limit`` characters at most. The best division of every beginning is found from those of shorter ones; of equally good
    ones the last segment is the longest. The work is the vectors times those that fit a segment.
    """
    n = len(v)
    total = np.vstack([np.zeros(v.shape[1]), np.cumsum(v, 0)])
    square = np.concatenate([[0.0], np.cumsum((v * v).sum(1))])
    chars = np.concatenate([[0], np.cumsum(size)])
    best, back = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    for i in range(1, n + 1):
        j = np.arange(min(i - 1, int(np.searchsorted(chars, chars[i] - limit))), i)
        d = total[i] - total[j]
        c = best[j] + square[i] - square[j] - (d * d).sum(1) / (i - j) + cost
        at = int(np.flatnonzero(c <= c.min() + 1e-12)[0])
        best[i], back[i] = c[at], j[at]
    ends, i = [], n
    while i:
        ends.append(i)
        i = int(back[i])
    return ends[::-1], float(best[n])


def _by_vectors(text: str, limit: int) -> list[dict]:
    cuts = [m.end() for m in _SENTENCE.finditer(text)]
    pieces = [p for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True) if b > a for p in split_text(text[a:b], limit)]
    ends, _ = segmented(sentence_vectors(pieces), np.array([len(p) for p in pieces], np.int64), limit) if pieces else ([], 0.0)
    chunks = ["".join(pieces[a:b]).strip() for a, b in zip([0, *ends], ends, strict=False)]
    return [{"text": c, "code_blocks": []} for c in chunks if c]


def chunk_vectors(df: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """The vector strategy: a text is cut between sentences so that the sentences of a chunk are alike, by the cheapest division of all. Sentences longer than
    ``limit`` are cut first; null and blank texts have no chunk."""
    return _numbered(spread(df), _chunk_udf(_by_vectors, limit)("text"), "vector")
