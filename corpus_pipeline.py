"""A corpus pipeline of five stages; each is written as a table and read again as the next one's documents.

All stages but the last return the columns of ``documents``. Null texts are empty; every stage works on all rows that its predecessor kept; an empty
table passes through. Rows of a null doc_id are rows like others: the classifier, the search for benchmark items and the mix judge them by their texts, near
duplicates keep one of each group (one with a doc_id, if the group has any), and the last stage gives each a shard and slot of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import decontaminate, mixing, ngram_join, quality_classifier, sharding
from folio.llm.common import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.train(docs, quality_classifier.training_labels(labels))
    return quality_classifier.score(docs, model, docs.columns).filter("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 over five-word shingles connect, the one of lowest doc_id stays; so do documents without a word."""
    return ngram_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes; documents that it does not take go. The last stage deals the copies to shards anew, as the columns
    of ``documents`` have no room for the splitting tree's shards."""
    return mixing.mix_documents(docs).select(*docs.columns, F.explode("shards")).drop("col")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row."""
    return sharding.sharded(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
    ("sharded", sharded),
]
#: The classifier, the hashed draws and the CRC have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
