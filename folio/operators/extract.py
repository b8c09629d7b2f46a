"""Extraction of entities and relations, and its results."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import patterns as P
from folio.operators.graph import communities
from folio.session import staged

REPLY = "entities array<struct<name: string, type: string>>, relations array<struct<source: string, target: string, type: string>>"


def parse_replies(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds entities and relations from the JSON between the first { and the last } of a reply; anything else gives empty lists."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, REPLY)
    none = lambda kind: F.array().cast(kind)
    return df.withColumn("_r", parsed).select(
        *df.columns,
        F.coalesce("_r.entities", none("array<struct<name: string, type: string>>")).alias("entities"),
        F.coalesce("_r.relations", none("array<struct<source: string, target: string, type: string>>")).alias("relations"),
    )


def in_schema(df: DataFrame) -> DataFrame:
    """Only entities and relations of allowed types."""
    return df.withColumn("entities", F.filter("entities", lambda e: e["type"].isin(P.ENTITY_TYPES))).withColumn("relations", F.filter("relations", lambda r: r["type"].isin(P.RELATION_TYPES)))


def glean(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """Two passes over the same texts as one: what the second one adds is joined to the first; a text may be in one of them only."""
    more = second.select(key, F.col("entities").alias("_e"), F.col("relations").alias("_r"))
    both = first.join(more, key, "full")
    kinds = {"entities": ("_e", "array<struct<name: string, type: string>>"), "relations": ("_r", "array<struct<source: string, target: string, type: string>>")}
    some = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return both.select(key, *(F.array_union(some(c, kind), some(d, kind)).alias(c) for c, (d, kind) in kinds.items()))


TRIPLES = "id string, source string, label string, target string, pos int"


def capital_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The offline extractor: neighbouring capitalised words of a sentence are related."""
    name = re.compile(r"\b[^\W\d_]\w*\b")
    for pdf in batches:
        rows = []
        for key, text in zip(pdf["id"], pdf["text"], strict=True):
            n = 0
            for sentence in re.split(r"(?<=[.!?])\s+", text or ""):
                found = [w for w in name.findall(sentence) if w[0].isupper()]
                for a, b in zip(found, found[1:], strict=False):
                    if a != b:
                        rows.append((key, a, "RELATES_TO", b, n))
                        n += 1
        yield pd.DataFrame(rows, columns=["id", "source", "label", "target", "pos"])


def extract_triples(nodes: DataFrame, extractor: Callable = capital_pairs, most: int = 10) -> DataFrame:
    """(id, text) -> at most ``most`` triples a node, the first ones. The extractor maps batches of nodes to batches of triples."""
    out = nodes.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(extractor, TRIPLES)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return out.withColumn("_n", rank).filter(F.col("_n") <= most).drop("_n")


def no_triples(nodes: DataFrame) -> DataFrame:
    """For embed-only nodes: no triple at all."""
    return nodes.sparkSession.createDataFrame([], TRIPLES)


def resolve_entities(entities: DataFrame) -> DataFrame:
    """Entities of equal name but for case and outer blanks as one."""
    name = F.lower(F.trim("entity_name"))
    return entities.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.min("id").alias("id"))


#: Code points of a q-gram, and of a name for each edit that is allowed in it. Names of one q-gram that one task compares with the others.
GRAM, PER_EDIT, BUCKET = 2, 5, 1000


def similar_names(names: DataFrame) -> DataFrame:
    """(a < b) of distinct names that differ in one edit for each PER_EDIT code points of the shorter one at most, and whose digits are the same.

    Names with d edits between them lose GRAM * d of their q-grams at most, so they share one of the GRAM * d + 1 rarest ones of each, which block them; the
    edits of each blocked pair are then counted. A q-gram of very many names is dealt to several tasks. Names that differ in a number are never alike.
    """
    rows = names.select("name").filter("name is not null").distinct()
    rows = rows.withColumn("n", F.length("name")).withColumn("d", F.floor(F.col("n") / PER_EDIT)).withColumn("digits", F.regexp_replace("name", r"[^0-9]", "")).filter("d > 0")
    rows = staged(rows, "names")
    at = F.posexplode(F.sequence(F.lit(1), F.col("n") - GRAM + 1)).alias("_p", "at")
    grams = rows.select("name", "n", "d", "digits", at).select("name", "n", "d", "digits", F.expr(f"substring(name, at, {GRAM})").alias("g"))
    # the second of two equal q-grams of a name is another token than the first; digits are alike anyway and tell nothing
    numbered = grams.groupBy("name", "n", "d", "digits", "g").agg(F.count("*").alias("m")).select("name", "n", "d", "digits", F.col("g"), F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("i"))
    tokens = staged(numbered.withColumn("token", F.xxhash64("g", "i", "digits")), "grams")
    df = tokens.groupBy("token").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("df", "token"))
    kept = staged(tokens.join(df, "token").withColumn("_r", rank).filter(F.col("_r") <= GRAM * F.col("d") + 1).select("token", "name", "n", "d", "digits"), "rare-grams")
    parts = kept.groupBy("token").agg(F.ceil(F.count("*") / BUCKET).alias("parts"), F.count("*").alias("m")).filter("m > 1").drop("m")
    members = kept.join(parts, "token")
    a = members.select("token", F.pmod(F.xxhash64("name"), "parts").alias("part"), F.col("name").alias("a"), F.col("n").alias("na"), F.col("digits").alias("da"))
    b = members.select("token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("name").alias("b"), F.col("n").alias("nb"), F.col("digits").alias("db"))
    most = F.floor(F.least("na", "nb") / PER_EDIT)
    pairs = a.join(b, ["token", "part"]).filter((F.col("a") < F.col("b")) & (F.col("da") == F.col("db")) & (F.abs(F.col("na") - F.col("nb")) <= most)).select("a", "b", most.alias("most")).distinct()
    return pairs.filter(F.levenshtein("a", "b") <= F.col("most")).select("a", "b")


def resolve_fuzzy(entities: DataFrame) -> DataFrame:
    """(name, entity, n, id): each name but for case and outer blanks, the least name of those that chains of similar names lead to, and the count and least id of
    all entities with one of these names. Null names are left out."""
    exact = staged(resolve_entities(entities).filter("name is not null"), "entities")
    pairs = similar_names(exact)
    found = communities(pairs.select(F.col("a").alias("src_id"), F.col("b").alias("tgt_id"))).select(F.col("id").alias("name"), F.col("community").alias("entity"))
    named = exact.join(found, "name", "left").withColumn("entity", F.coalesce("entity", "name"))
    whole = named.groupBy("entity").agg(F.sum("n").alias("n"), F.min("id").alias("id"))
    return named.select("name", "entity").join(whole, "entity").select("name", "entity", "n", "id")
