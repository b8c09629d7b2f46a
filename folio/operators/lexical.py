"""Words of texts as tables: an inverted index with BM25 scores, re-ranking of retrieved chunks, and synonyms from co-occurrence."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.session import staged

K1, B = 1.2, 0.75
#: Postings of a term that one task joins with the queries that ask for it.
PART = 100_000
#: Bytes of texts whose words one task counts; pairs of a text and a query that one task adds up; words whose neighbours are paired at once.
TEXTS, PAIRS, RUN = 16 << 20, 500_000, 1 << 20


def words(text):
    """Lower-case words of letters and digits, in order and with repeats; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


@dataclass
class InvertedIndex:
    """``postings``: (term, part, id, tf, n) with n the words of the text; ``terms``: (term, df, parts); the number of texts with a word and of their words."""

    postings: DataFrame
    terms: DataFrame
    n_docs: int
    n_words: int

    def write(self, path: str) -> None:
        """Tables at ``path``; postings stay where their texts are, each text's in one place, in runs by term."""
        spark = self.postings.sparkSession
        self.postings.write.parquet(f"{path}/postings")
        self.terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
        spark.createDataFrame([(self.n_docs, self.n_words)], "n_docs long, n_words long").coalesce(1).write.parquet(f"{path}/counts")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> InvertedIndex:
        counts = spark.read.parquet(f"{path}/counts").first()
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), counts.n_docs, counts.n_words)


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> InvertedIndex:
    """The index of all words of (key, text). Rows of one key are one text; a null text has no words."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    # the texts are shuffled once, before they are words: all that is counted of a text is counted where it lies
    texts = rows.repartition(max(1, -(-size // TEXTS)), "id").groupBy("id").agg(F.array_join(F.collect_list("t"), " ").alias("t"))
    found = texts.select("id", words(F.col("t")).alias("w")).select("id", F.size("w").cast("long").alias("n"), F.explode("w").alias("term"))
    counts = staged(found.groupBy("id", "n", "term").agg(F.count("*").alias("tf")).sortWithinPartitions("term"), "postings")
    terms = staged(counts.groupBy("term").agg(F.count("*").alias("df")).withColumn("parts", F.ceil(F.col("df") / PART).cast("int")), "terms")
    whole = counts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_words")).first()
    n_docs = counts.select("id").distinct().count()
    # only terms of several parts need to be known to deal the postings out: one row for PART postings at most
    several = F.broadcast(terms.filter("parts > 1").select("term", "parts"))
    placed = counts.join(several, "term", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), "parts"), F.lit(0)).cast("int"))
    return InvertedIndex(placed.select("term", "part", "id", "tf", "n"), terms, n_docs, whole.n_words)


def _asked(found: InvertedIndex, queries: DataFrame) -> DataFrame:
    """(query_id, term, part, idf) of the distinct words of each query that any text has."""
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).distinct().join(found.terms, "term")
    idf = F.log(1 + (F.lit(found.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return staged(asked.select("query_id", "term", idf.alias("idf"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "asked")


def _weight(found: InvertedIndex):
    mean = found.n_words / max(found.n_docs, 1)
    return F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.lit(float(mean or 1))))


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)


def _best(scores: DataFrame, k: int) -> DataFrame:
    """Of the rows (query_id, id, score) of each task the k best of each query."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            order = pc.sort_indices(rows, [("query_id", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start")
            rows = rows.take(order)
            code = rows.column("query_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            first = np.append(True, code[1:] != code[:-1]) if len(code) else np.zeros(0, bool)
            start = np.maximum.accumulate(np.where(first, np.arange(len(code)), 0))
            held = rows.take(pa.array(np.flatnonzero(np.arange(len(code)) - start < k)))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return scores.select("query_id", "id", "score").mapInArrow(run, scores.select("query_id", "id", "score").schema)


def bm25(found: InvertedIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k texts of greatest BM25 score for each query (query_id, text); equal scores (to nine digits) by id.

    The postings of words that are asked for are dealt by text, so that a text's scores are added up in one task, which puts out its k best of each query; pairs
    of texts and queries are not shuffled. Postings of very common words lie in several parts, so no task sees all of one word's.
    """
    asked = _asked(found, queries)
    tasks = max(1, -(-found.n_docs * asked.select("query_id").distinct().count() // PAIRS))
    own = found.postings.join(asked.select("term", "part").distinct(), ["term", "part"], "left_semi").repartition(tasks, "id")
    hits = own.join(asked, ["term", "part"])
    return _ranked(_best(hits.groupBy("query_id", "id").agg(F.round(F.sum(_weight(found)), 9).alias("score")), k), k)


def rerank(found: InvertedIndex, queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the candidates (query_id, id) alone: retrieved chunks in order of their BM25 score, those without a shared word last.

    The postings are cut down to the candidates' before they are joined with the words.
    """
    pairs = staged(candidates.select("query_id", "id").distinct(), "candidates")
    own = found.postings.join(pairs.select("id").distinct(), "id", "left_semi")
    hits = own.join(_asked(found, queries), ["term", "part"]).groupBy("query_id", "id").agg(F.sum(_weight(found)).alias("s"))
    return _ranked(pairs.join(hits, ["query_id", "id"], "left").select("query_id", "id", F.round(F.coalesce("s", F.lit(0.0)), 9).alias("score")), k)


def _neighbours(coded: DataFrame, window: int) -> DataFrame:
    """(x < y, m): how often two codes stand at most ``window`` places apart in the arrays of codes (null: no word that counts), added up a run of arrays at a time."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(0)
            ends = np.cumsum(np.concatenate([[0], column.value_lengths().fill_null(0).to_numpy()]))
            a = 0
            while a < len(column):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + RUN, "right")) - 1)
                flat = column.slice(a, b - a).flatten()
                some = flat.is_valid().to_numpy(zero_copy_only=False)
                codes, at = np.unique(flat.fill_null(0).to_numpy(), return_inverse=True)
                row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                keys = []
                for d in range(1, window + 1):
                    x, y = at[:-d], at[d:]
                    fit = some[:-d] & some[d:] & (row[:-d] == row[d:]) & (x != y)
                    keys.append(np.minimum(x, y)[fit] * len(codes) + np.maximum(x, y)[fit])
                key, m = np.unique(np.concatenate(keys), return_counts=True)
                n = max(1, len(codes))
                yield pa.RecordBatch.from_arrays([pa.array(codes[key // n]), pa.array(codes[key % n]), pa.array(m.astype(np.int64))], ["x", "y", "m"])
                a = b

    return coded.mapInArrow(run, "x long, y long, m long")


def synonyms(docs: DataFrame, window: int = 4, least: int = 5, k: int = 5, least_pmi: float = 2.0, stop: list[str] = [], key: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B006
    """(word, synonym, pairs, pmi): of each word the k others that most often stand near it beyond chance.

    Two words are a pair each time they stand at most ``window`` words apart; ``pmi`` is the logarithm of how many times oftener than chance that is. Only
    words and pairs with ``least`` occurrences count; pairs are added up before the shuffle. Words of fewer than three letters and stop words are no synonyms.
    """
    usable = lambda w: (F.length(w) >= 3) & ~w.isin(stop) if stop else F.length(w) >= 3
    rows = docs.select(F.col(key).alias("id"), words(F.col(text)).alias("w"))
    every = staged(rows.select(F.explode("w").alias("word")).filter(usable(F.col("word"))).groupBy("word").agg(F.count("*").alias("n")), "words")
    total = every.agg(F.sum("n")).first()[0] or 0
    seed = next(i for i in range(64) if every.groupBy(F.xxhash64("word", F.lit(i))).count().filter("count > 1").isEmpty())  # no two words have one code
    counts = every.filter(F.col("n") >= least)
    # neighbours are paired within the text, by codes; rows of one key are one text and share its places
    coded = rows.filter("id is not null").select("id", F.transform("w", lambda w: F.when(usable(w), F.xxhash64(w, F.lit(seed)))).alias("w"))
    again = staged(rows.groupBy("id").count().filter("count > 1").select("id"), "again")
    once = _neighbours(coded.join(again, "id", "left_anti").select("w"), window)
    placed = coded.join(again, "id", "left_semi").select("id", F.posexplode("w").alias("at", "x")).filter("x is not null")
    near = placed.withColumn("next", F.collect_list("x").over(Window.partitionBy("id").orderBy("at").rangeBetween(1, window)))
    shared = near.select("x", F.explode("next").alias("y")).filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.lit(1).cast("long").alias("m"))
    pairs = once.union(shared).groupBy("x", "y").agg(F.sum("m").alias("pairs")).filter(F.col("pairs") >= least)
    word = lambda c, to: counts.select(F.xxhash64("word", F.lit(seed)).alias(c), F.col("word").alias(to))
    named = pairs.join(word("x", "u"), "x").join(word("y", "v"), "y")
    ordered = named.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "pairs")
    side = lambda c: counts.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    pmi = F.round(F.log(F.col("pairs") * F.lit(float(total)) / (F.col("n_a") * F.col("n_b") * F.lit(2.0 * window))), 6)
    scored = staged(ordered.join(side("a"), "a").join(side("b"), "b").select("a", "b", "pairs", pmi.alias("pmi")).filter(F.col("pmi") >= least_pmi), "pmi")
    both = scored.select(F.col("a").alias("word"), F.col("b").alias("synonym"), "pairs", "pmi").union(scored.select("b", "a", "pairs", "pmi"))
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("pmi"), F.desc("pairs"), "synonym"))
    return both.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def expanded(asked: list[str], table: DataFrame) -> list[str]:
    """Words of a query and their synonyms: a row for each synonym of these few words reaches the driver."""
    rows = table.filter(F.col("word").isin(asked)).select("synonym").distinct().orderBy("synonym").collect()
    return [*asked, *(r.synonym for r in rows if r.synonym not in asked)]
