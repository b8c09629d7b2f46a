"""Notes: Markdown with front matter and wiki links, as a graph of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import note_id


def parse(notes: DataFrame) -> DataFrame:
    """(path, content) -> (path, ref_doc_id, title, tags, body, links); templates go.

    Tags are the inline list of the front matter or the items of a block list; the title is the first heading; a stray ``ø`` at the end goes.
    """
    front = F.regexp_extract("content", r"(?s)\A---\n(.*?)\n---\n", 1)
    body = F.rtrim(F.regexp_replace("content", r"(?s)\A---\n.*?\n---\n", ""), F.lit("ø \n"))
    inline = F.regexp_extract(front, r"(?m)^tags:\s*\[([^\]]*)\]", 1)
    block = F.regexp_extract_all(F.regexp_extract(front, r"(?m)^tags:[ \t]*\n((?:[ \t]*- .*\n?)+)", 1), F.lit(r"(?m)^[ \t]*- (.*)$"), F.lit(1))
    tags = F.filter(F.transform(F.when(inline != "", F.split(inline, ",")).otherwise(block), lambda t: F.trim(t)), lambda t: t != "")
    links = F.transform(F.regexp_extract_all(body, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), lambda t: F.trim(t))
    out = notes.select("path", note_id(F.col("path")).alias("ref_doc_id"), F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1).alias("title"), tags.alias("tags"), body.alias("body"), links.alias("links"))
    return out.filter(~F.col("body").contains("${FOAM_"))


def entities(parsed: DataFrame) -> DataFrame:
    return parsed.select("ref_doc_id", F.col("title").alias("entity_name"), F.lit("Concept").alias("entity_type"), "tags", F.lit("note").alias("source_type"))


def relations(parsed: DataFrame) -> DataFrame:
    """An edge for each wiki link."""
    return parsed.select("ref_doc_id", F.col("title").alias("src_id"), F.explode("links").alias("tgt_id")).withColumn("label", F.lit("RELATES_TO")).withColumn("source_type", F.lit("note"))


def rebuild(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """A table's note rows made anew from all notes; other rows as they are."""
    return rows.filter(F.coalesce(F.col("source_type") != "note", F.lit(True))).unionByName(notes)
