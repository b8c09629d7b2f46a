"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import staged

#: Buckets of the global numbering: their counts, a table of so many rows, are what is summed in one task.
BUCKETS = 1 << 16
#: Copies of one row that are expanded from one array.
SPREAD = 65_536
ROUNDS = 6


def feistel(x: Column, a: Column, b: Column, seed: int) -> Column:
    """A permutation of 0..a*b-1: the number is a pair (left below a, right below b), and each round adds a hash of one half to the other."""
    left, right = ((x - x % b) / b).cast("long"), x % b
    for i in range(0, ROUNDS, 2):
        left = (left + F.pmod(F.xxhash64(right, F.lit(seed), F.lit(i)), a)) % a
        right = (right + F.pmod(F.xxhash64(left, F.lit(seed), F.lit(i + 1)), b)) % b
    return left * b + right


def walked(place: Column, n: Column, a: Column, b: Column, seed: int) -> Column:
    """Cycle walking: a place outside 0..n-1 is permuted again until it is inside.

    A walk meets no place twice, so it is over after as many steps as there are places outside, about sqrt(n) at most; only that many rows walk.
    """
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), a * b - n))
    again = F.aggregate(steps, place, lambda at, _: F.when(at < n, at).otherwise(feistel(at, a, b, seed)))
    return F.when(place < n, place).otherwise(again)


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """Give every row a number 0..n-1 in column ``name`` and the row count in ``name_total``.

    Equal rows are counted first and expanded last, so a row that makes up much of the input is no hot key. The rest is ordered by a hash: by
    bucket, whose counts add up to offsets, and then within the bucket. Equal inputs get equal numbers in any run.
    """
    cols = df.columns
    counted = staged(df.groupBy(*cols).agg(F.count("*").alias("_copies")).withColumn("_hash", F.xxhash64(*cols)).withColumn("_bucket", F.pmod("_hash", F.lit(BUCKETS))), "rows")
    totals = counted.groupBy("_bucket").agg(F.sum("_copies").alias("_rows"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("_bucket", F.coalesce(F.sum("_rows").over(upto), F.lit(0)).alias("_offset"), F.sum("_rows").over(every).alias(f"{name}_total"))
    before = Window.partitionBy("_bucket").orderBy("_hash", *cols).rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.join(F.broadcast(offsets), "_bucket").withColumn("_first", F.col("_offset") + F.coalesce(F.sum("_copies").over(before), F.lit(0)))
    part = F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / SPREAD).cast("long")))
    lo = F.col("_first") + F.col("_part") * SPREAD
    hi = F.least(lo + SPREAD, F.col("_first") + F.col("_copies")) - 1
    return numbered.withColumn("_part", part).withColumn(name, F.explode(F.sequence(lo, hi))).select(*cols, name, f"{name}_total")


def shard_rows(df: DataFrame, n_shards: int = 16, seed: int = 11) -> DataFrame:
    """Deal the rows of ``df`` to ``n_shards`` shards by a seeded Feistel permutation: columns of ``df`` plus ``shard`` and ``slot``.

    Row number r goes to place p = permutation(r), shard p mod n_shards, slot p div n_shards: both are computed from the number alone, shard counts
    differ by one at most and slots have no gaps. Nulls are values like others; repeated rows get places of their own; an empty table
    gives an empty result; columns of ``df`` named ``shard`` or ``slot`` are replaced. All columns must be comparable (no maps).
    """
    df = df.drop("shard", "slot")
    numbered = number_rows(df, "_no")
    n = F.col("_no_total")
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    sized = numbered.withColumn("_a", a).withColumn("_b", F.floor((n + F.col("_a") - 1) / F.col("_a")).cast("long"))
    placed = sized.withColumn("_once", feistel(F.col("_no"), F.col("_a"), F.col("_b"), seed))
    placed = placed.withColumn("_place", walked(F.col("_once"), n, F.col("_a"), F.col("_b"), seed))
    return placed.select(*df.columns, (F.col("_place") % n_shards).cast("int").alias("shard"), F.floor(F.col("_place") / n_shards).cast("long").alias("slot"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sharded(docs: DataFrame) -> DataFrame:
    """Places of all documents under the law ``rows``; equal texts are not kept together by it."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    slim = docs.select("doc_id", size.alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    out = shard_rows(slim)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
