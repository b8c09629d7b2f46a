"""Changes of status checked as a stream, with state for each document and timers that put late rows in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folio.operators.tables import ALLOWED

OUT = "doc_id long, seq long, before string, status string"


def _changes(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "seq", "before", "status"], dtype=object).astype({"doc_id": "int64", "seq": "int64"})


class Transitions(StatefulProcessor):
    """Rows wait until the watermark has passed their time; then they are taken in order of ``seq``, and a change that is not allowed is put out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string")
        self.waiting = handle.getListState("waiting", "at long, seq long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sent = []
        for pdf in rows:
            at = pdf["ts"].astype("datetime64[us]").astype("int64") // 1000
            sent.extend(zip(at.tolist(), pdf["seq"].tolist(), pdf["status"].tolist(), strict=True))
        if sent:  # one call to the state store for all rows of a document, not one for each
            self.waiting.appendList(sent)
            self.handle.registerTimer(min(r[0] for r in sent))
        yield _changes([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()]
        ready, later = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        before = self.last.get()[0] if self.last.exists() else None
        out = []
        for _, seq, status in sorted(ready, key=lambda r: r[1]):
            if before is not None and before != status and (before, status) not in ALLOWED:
                out.append((key[0], seq, before, status))
            before = status
        if ready:
            self.last.update((before,))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(r[0] for r in later))
        else:
            self.waiting.clear()
        if out:
            yield _changes(out)

    def close(self) -> None:
        pass


def invalid_transitions_stream(history: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """A stream of (doc_id, seq, status, ts) -> changes of status that are not allowed, as ``tables.invalid_transitions`` finds them, however the rows are split
    into batches.

    Rows may come out of order by as much as ``delay``; what comes later still is left out, as with any watermark. A row's change is told once the watermark
    has passed it, so the rows of the last ``delay`` wait in the state for what comes next. A document's state is its last status and the rows that wait.
    """
    spark = history.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = history.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return rows.groupBy("doc_id").transformWithStateInPandas(statefulProcessor=Transitions(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
