"""Streams into keyed tables: each micro-batch is one version of a bucketed table, so a batch that is delivered again changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from folio.operators.bucketed import BucketedTable


def batch_upsert(table: BucketedTable, order: str | None = None, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that upserts what ``prepare`` makes of a batch. The batch's number is the version: Spark gives a batch that it runs again
    after a failure the same number and the same rows."""

    def run(batch: DataFrame, number: int) -> None:
        table.upsert(prepare(batch), order, version=number)

    return run


def upsert_stream(stream: DataFrame, table: BucketedTable, checkpoint: str, order: str | None = None, prepare: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Start upserting a stream into a table; it takes what is there and stops. Documents that come again, changed or not, replace their rows."""
    return stream.writeStream.foreachBatch(batch_upsert(table, order, prepare)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
