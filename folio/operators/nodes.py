"""Text nodes from chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import book_id, ustrip
from folio.operators.classify import classify_two_tier, is_curated


def build_nodes(chunks: DataFrame) -> DataFrame:
    """(source_path, chunk_idx, text, code_blocks, has_code) -> prose nodes and one code node per non-blank block, which names its prose node as parent.

    Ids are hashes of path and ordinals, so a rebuild gives the same ids.
    """
    base = classify_two_tier(chunks).withColumn("ref_doc_id", book_id(F.col("source_path")))
    base = base.withColumn("node_id", F.md5(F.concat_ws("|", "source_path", F.col("chunk_idx").cast("string")).cast("binary")))
    base = base.withColumn("tier", F.when(is_curated(F.col("source_path")), "curated").otherwise("embed"))
    shared = ["ref_doc_id", "source_path", "tier"]
    prose = base.select("node_id", F.lit(None).cast("string").alias("parent_id"), F.lit("prose").alias("kind"), "text", "content_type", (F.coalesce("has_code", F.lit(False)) | (F.size("code_blocks") > 0)).alias("has_code"), *shared)
    code = base.select("*", F.posexplode("code_blocks").alias("_i", "_code")).filter(F.length(ustrip(F.col("_code"))) > 0)
    code = code.select(
        F.md5(F.concat_ws("|", "source_path", F.col("chunk_idx").cast("string"), F.col("_i").cast("string")).cast("binary")).alias("node_id"),
        F.col("node_id").alias("parent_id"), F.lit("code").alias("kind"), F.col("_code").alias("text"), F.array(F.lit("code")).alias("content_type"), F.lit(True).alias("has_code"), *shared,
    )
    return prose.unionByName(code).withColumn("source_type", F.lit("book"))


def tier_summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tier").agg(F.count("*").alias("nodes"), F.countDistinct("source_path").alias("books"))


def write_nodes(nodes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The node table, embed-only and curated alike, partitioned by namespace so that one can be rebuilt alone."""
    nodes.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("source_type").parquet(path)
