"""Key-value and status tables: upsert, merge, delete, lookups, transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALLOWED = [("pending", "processing"), ("processing", "processed"), ("processing", "failed"), ("failed", "processing")]


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those of equal key; others stay. Of rows of one key in ``new`` the latest counts (``latest``)."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(latest(new, keys, order))


def latest(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row a key: the greatest by ``order``, ties and no order by all other fields."""
    fields = [c for c in rows.columns if c not in keys]
    by = F.struct(*([order] if order else []), *fields) if fields else F.lit(1)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), by).alias("_r")).select("_r.*")


def merge(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """As ``upsert``, but a null field of ``new`` leaves the old value."""
    new = latest(new, keys, order)
    fields = [c for c in old.columns if c not in keys]
    renamed = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in fields))
    return old.join(renamed, keys, "full").select(*keys, *(F.coalesce(f"_new_{c}", c).alias(c) for c in fields))


def delete(old: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(ids.select(*keys).distinct(), keys, "left_anti")


def missing(asked: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Asked keys that the table lacks."""
    return asked.select(*keys).distinct().join(table.select(*keys), keys, "left_anti")


def get_by_ids(table: DataFrame, ids: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(pos, key) -> the rows in the order asked for, null fields for keys that are not there."""
    return ids.join(table.select(key, *fields), key, "left").select("pos", key, *fields).orderBy("pos")


def pending(asked: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """Ids that are not yet processed; ``done`` is another word for it."""
    return asked.join(status.filter(F.col("status").isin("processed", "done")).select(key), key, "left_anti")


def invalid_transitions(history: DataFrame) -> DataFrame:
    """(doc_id, seq, status) -> changes of status that are not allowed."""
    before = F.lag("status").over(Window.partitionBy("doc_id").orderBy("seq"))
    steps = history.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col("before") != F.col("status")))
    allowed = F.lit(False)
    for a, b in ALLOWED:
        allowed = allowed | ((F.col("before") == a) & (F.col("status") == b))
    return steps.filter(~allowed)


def page(table: DataFrame, order: list, offset: int, n: int) -> DataFrame:
    return table.orderBy(*order).offset(offset).limit(n)


def purge(rows: DataFrame, namespace: str, id_col: str = "id") -> DataFrame:
    """Rows outside a namespace (book, note). A row is in it by source_type, id or ref_doc_id; unknown fields count as outside."""
    marks = (F.col("source_type") == namespace, F.col(id_col).startswith(f"{namespace}::"), F.col("ref_doc_id").startswith(f"{namespace}::"))
    return rows.filter(~(_true(marks[0]) | _true(marks[1]) | _true(marks[2])))


def purge_graph(nodes: DataFrame, edges: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame]:
    """The graph without a namespace's nodes, and without the edges that would dangle."""
    from folio.operators.graph import detach

    left = purge(nodes, namespace)
    return left, detach(edges, left)


def in_namespace(table: DataFrame, namespace: str) -> DataFrame:
    """What a namespace sees of a table that several share: its own rows, without the mark."""
    return table.filter(F.col("namespace") == namespace).drop("namespace")


def write_in_namespace(table: DataFrame, new: DataFrame, namespace: str, keys: list[str]) -> DataFrame:
    """Upsert into one namespace; the same keys in others are other rows."""
    return upsert(table, new.withColumn("namespace", F.lit(namespace)), ["namespace", *keys])


def lookup(table: DataFrame, asked: DataFrame, by: str) -> DataFrame:
    """Rows of the table whose field ``by`` is asked for."""
    return table.join(asked.select(by).distinct(), by, "left_semi")


def is_empty(table: DataFrame) -> DataFrame:
    """One row that says whether the table has none."""
    return table.limit(1).agg((F.count("*") == 0).alias("is_empty"))


def reset(table: DataFrame, namespace: str | None = None) -> DataFrame:
    """The table without its rows, or without one namespace's."""
    return table.filter(F.lit(False)) if namespace is None else table.filter(~F.col("namespace").eqNullSafe(namespace))


def _true(c):
    return F.coalesce(c, F.lit(False))
