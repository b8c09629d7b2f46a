"""Quality rules with host-level verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import WORD, small, staged

#: A host is rejected if its shrunk failure rate is above this.
HOST_LIMIT = 0.6
WINDOW = 8


def _within(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """Words inside k-word windows that occur twice or more in the word list, the first included."""

    def covered(hashes: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(hashes) - (k - 1))
        return _within(F.transform(at, lambda i: F.xxhash64(F.slice(hashes, i, k))), of_windows)

    def of_windows(windows: Column) -> Column:
        distinct = F.size(F.array_distinct(windows))
        return F.when(distinct == F.size(windows), F.lit(0)).otherwise(_within(F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), of_sorted))

    def of_sorted(pairs: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(pairs, j)["w"] == x["w"], F.lit(False))
        found = F.filter(pairs, lambda x, j: same(x, j - 1) | same(x, j + 1))
        start = F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(k), i - acc["last"])).alias("n"))
        return F.aggregate(F.sort_array(F.transform(found, lambda x: x["i"])), start, step, lambda acc: acc["n"])

    return F.when(F.size(words) < k, F.lit(0)).otherwise(_within(F.transform(words, lambda w: F.xxhash64(w)), covered)).cast("long")


def text_counts(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document with its word, symbol, line and repetition counts over the whole text; null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("_text"))
    split = base.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))).withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD)))
    return split.select(
        "doc_id",
        "host",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )


def host_verdicts(failures: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, failed boolean) -> one row per host with its failure rate shrunk by a beta prior fitted to all hosts by moments.

    Hosts count by their rows. What their rates differ by chance alone, m (1 - m) for each host less one, is taken off their weighted squares before the
    prior's strength is read from what is left. Rows with a null host have no verdict. Where nothing is left, or hosts of one row each can't tell, the prior
    is as strong as all rows together, and hosts get about the mean rate.
    """
    hosts = failures.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("f"))
    n, f = F.col("n"), F.col("f")
    sums = hosts.agg(F.sum("n").alias("rows"), F.sum(n.cast("double") * n).alias("squares"), F.sum("f").alias("failed"), F.sum(f.cast("double") * f / n).alias("own"), F.count("*").alias("hosts"))
    m, free = F.col("failed") / F.col("rows"), F.col("hosts") - 1
    chance = m * (1 - m)
    spread = F.col("own") - F.col("failed") * m - chance * free
    room = chance * (F.col("rows") - F.col("squares") / F.col("rows") - free)
    # the share of a row's variance that lies between hosts is 1 / (strength + 1)
    strength = F.when((spread > 0) & (room > 0), F.least(F.col("rows").cast("double"), F.greatest(F.lit(0.0), room / spread - 1))).otherwise(F.col("rows").cast("double"))
    prior = sums.select((m * strength).alias("alpha"), strength.alias("strength"))
    scored = hosts.crossJoin(F.broadcast(prior))  # the prior is one row
    shrunk = (f + F.col("alpha")) / (n + F.col("strength"))
    return scored.select("host", shrunk.alias("host_rate"), (shrunk > limit).alias("host_rejected"))


def judge(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Per-document rule counts, the base verdict and the verdict after the host's rate.

    A document fails its host's count if it fails the base rule, has over one symbol to four words, or over half its lines are repeats. It is kept if
    it passes the base rule and its host is not rejected. Null text is empty and so fails; a null host has no verdict; repeated rows are judged and
    counted each; an empty table gives an empty result; other columns of ``docs`` are not read.
    """
    counted = text_counts(docs)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = base | (4 * F.col("n_symbols") > F.col("n_words")) | (2 * F.col("n_dup_lines") > F.col("n_lines"))
    judged = staged(counted.withColumn("base_failed", base).withColumn("failed", failed), "rules")
    verdicts = small(host_verdicts(judged.select("host", "failed"), limit))
    out = judged.join(verdicts, "host", "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = """
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), runs AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM base, unnest(range(1, len(w) - 6)) AS u(i)
), dup AS (
  SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -8) AS gap
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM runs) WHERE n > 1
), rep AS (
  SELECT doc_id, sum(least(8, gap)) AS r FROM dup GROUP BY doc_id
), c AS (
  SELECT b.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN rep USING (doc_id)
), j AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
), f AS (
  SELECT *, base_failed OR 4 * n_symbols > n_words OR 2 * n_dup_lines > n_lines AS failed FROM j
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (failed) AS f FROM f WHERE source IS NOT NULL GROUP BY source
), m AS (
  SELECT sum(f) / sum(n) AS m, sum(n) AS rows, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS u, count(*) - 1 AS k,
         sum(n * (f / n - (SELECT sum(f) / sum(n) FROM h)) ** 2) AS s
  FROM h
), p AS (
  SELECT m, CASE WHEN s > m * (1 - m) * k AND m * (1 - m) * u > 0
                 THEN least(rows, greatest(0, m * (1 - m) * u / (s - m * (1 - m) * k) - 1)) ELSE rows END AS s
  FROM m
), verdict AS (
  SELECT source, (f + m * s) / (n + s) > 0.6 AS rejected FROM h, p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM f LEFT JOIN verdict USING (source)
"""
