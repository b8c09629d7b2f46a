"""Retrieval modes over nodes, graph and vectors, and prompts.

Only one-line definitions of the modes are given; what follows is this library's reading of them. local: entities whose name has a query word, and
their edges. global: edges by query words in their label or keywords, weight and degree, or whole communities by what their edges say. naive: nearest chunks. hybrid: local and
global. mix: hybrid and naive. Lists are fused by reciprocal rank (1 / (60 + rank)).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import patterns as P
from folio.functions.text import capitalize
from folio.operators.graph import communities, edge_degrees
from folio.operators.lexical import InvertedIndex, rerank
from folio.operators.vectors import top_k
from folio.session import staged

STOP = ["the", "and", "for", "with", "that", "this", "from", "are", "was", "what", "how", "does", "who", "which", "about"]
RANK_CONSTANT = 60


def validate_mode(mode):
    m = F.lower(F.trim(mode))
    return F.when(m.isin(P.MODES), m).otherwise("mix")


def _ranked(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def naive(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(item, rank) of the nearest vectors."""
    return _ranked(top_k(vectors, query, k), F.desc(F.round("score", 9)), "vec_id").select(F.concat(F.lit("chunk:"), F.col("vec_id")).alias("item"), "rank")


def local(nodes: DataFrame, edges: DataFrame, words: list[str], k: int, degree: DataFrame | None = None) -> DataFrame:
    """(item, rank): edges at entities whose lower-case name has a query word, by words matched, weight and degree."""
    parts = F.split(F.lower("entity_name"), r"[^\p{L}\p{N}]+")
    hits = nodes.withColumn("matched", F.size(F.array_intersect(parts, F.array(*map(F.lit, words))))).filter("matched > 0").select("id", "matched")
    side = lambda c, n: hits.groupBy(F.col("id").alias(c)).agg(F.sum("matched").alias(n))
    ends = edges.join(side("src_id", "_a"), "src_id", "left").join(side("tgt_id", "_b"), "tgt_id", "left")
    ends = ends.withColumn("_m", F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))).filter("_m > 0 and rel_id is not null")
    touched = staged(ends.select("rel_id", "src_id", "tgt_id", "weight", F.sum("_m").over(Window.partitionBy("rel_id")).alias("matched")), "touched")
    # degrees only tell edges apart that have as many words and as much weight as the last of the k best
    last = touched.orderBy(F.desc("matched"), F.desc("weight")).limit(k).agg(F.min(F.struct("matched", "weight")).alias("_last"))
    best = touched.join(F.broadcast(last), F.struct("matched", "weight") >= F.col("_last")).drop("_last")  # one row
    best = staged(best, "best")
    order = (F.desc("matched"), F.desc("weight"), F.desc("edge_degree"), F.asc("rel_id"))
    if degree is None:
        near = best.select(F.col("src_id").alias("id")).union(best.select("tgt_id")).distinct()
        met = edges.select(F.explode(F.array_distinct(F.array("src_id", "tgt_id"))).alias("id")).join(staged(near, "near"), "id", "left_semi")
        degree = met.groupBy("id").agg(F.count("*").alias("degree"))
    out = edge_degrees(edges, best, degree).orderBy(*order).limit(k)
    return _ranked(out, *order).select(F.concat(F.lit("edge:"), "rel_id").alias("item"), "rank")


def global_(edges: DataFrame, words: list[str], k: int, degree: DataFrame | None = None) -> DataFrame:
    """(item, rank): edges by query words in label and keywords, then weight times degree."""
    text = F.split(F.lower(F.concat_ws(" ", "label", "keywords")), r"[^\p{L}\p{N}]+")
    hits = edges.withColumn("matched", F.size(F.array_intersect(text, F.array(*map(F.lit, words))))).filter("matched > 0")
    hits = hits.select("rel_id", "src_id", "tgt_id", "weight", "matched")  # the texts stay out of the joins
    scored = edge_degrees(edges, hits, degree).withColumn("strength", F.col("weight") * F.col("edge_degree"))
    order = (F.desc("matched"), F.desc("strength"), F.asc("rel_id"))
    return _ranked(scored.orderBy(*order).limit(k), *order).select(F.concat(F.lit("edge:"), "rel_id").alias("item"), "rank")


def community_summary(edges: DataFrame) -> DataFrame:
    """Nodes, edges and weight of each community."""
    edges = staged(edges, "edges")
    return summary_of(edges, communities(edges))


def summary_of(edges: DataFrame, c: DataFrame, *more) -> DataFrame:
    inside = edges.join(c.withColumnRenamed("id", "src_id").hint("merge"), "src_id").groupBy("community").agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 6).alias("weight"), *more)
    return c.groupBy("community").agg(F.count("*").alias("nodes")).join(inside, "community", "left")


def global_communities(edges: DataFrame, words: list[str], k: int, of=communities) -> DataFrame:
    """(item, rank, nodes, edges, weight): communities by how many of their edges have a query word, then by their weight. ``of`` makes (id, community) of edges."""
    text = F.split(F.lower(F.concat_ws(" ", "label", "keywords")), r"[^\p{L}\p{N}]+")
    hit = (F.size(F.array_intersect(text, F.array(*map(F.lit, words)))) > 0).alias("hit")
    edges = staged(edges.select("src_id", "tgt_id", "weight", hit), "edges")  # the texts stay out of the joins
    c = of(edges)
    order = (F.desc("matched"), F.desc("weight"), F.asc("community"))
    top = summary_of(edges, c, F.count_if("hit").alias("matched")).filter("matched > 0").orderBy(*order).limit(k)
    return _ranked(top, *order).select(F.concat(F.lit("community:"), "community").alias("item"), "rank", "nodes", "edges", "weight")


def reranked(chunks: DataFrame, index: InvertedIndex, query: DataFrame, k: int) -> DataFrame:
    """(item, score, rank): retrieved chunks (item "chunk:<id>", ..) in the order of their BM25 score for the query, one row (query_id, text)."""
    asked = chunks.select(F.substring_index("item", ":", -1).cast(index.postings.schema["id"].dataType).alias("id"))
    pairs = asked.crossJoin(query.select("query_id").limit(1))  # one query
    out = rerank(index, query, pairs, k)
    return out.select(F.concat(F.lit("chunk:"), F.col("id").cast("string")).alias("item"), "score", "rank")


def vector_context(vectors: DataFrame, edges: DataFrame, query: list[float], k: int, key: str = "id", node: str = "id") -> DataFrame:
    """(id, hop, score): the k nearest nodes and the nodes one edge away, these with the best score of those that led to them. Ties go by ``key``."""
    near = top_k(vectors, query, k, key=key).select(F.col(node).alias("id"), "score")
    both = edges.select(F.col("src_id").alias("id"), F.col("tgt_id").alias("to")).union(edges.select("tgt_id", "src_id"))
    around = both.join(F.broadcast(near), "id").groupBy(F.col("to").alias("id")).agg(F.max("score").alias("score"))  # near has k rows
    around = around.join(F.broadcast(near.select("id")), "id", "left_anti").select("id", F.lit(1).alias("hop"), "score")
    return near.select("id", F.lit(0).alias("hop"), "score").unionByName(around)


def cited(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item, ..) of chunks -> the same with ``source_path`` and ``chunk_idx`` of each; ``chunks``: (item, source_path, chunk_idx). Items of no chunk keep nulls."""
    return ranked.join(chunks.select("item", "source_path", "chunk_idx"), "item", "left")


def of_sources(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """What a retrieval mode may see if it is asked for some kinds of sources: any mode takes the filtered vectors, nodes or edges."""
    return rows.filter(F.col("source_type").isin(kinds))


def fuse(*lists: DataFrame, k: int) -> DataFrame:
    """One list of the items of several ranked ones."""
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    out = every.groupBy("item").agg(F.round(F.sum(1.0 / (RANK_CONSTANT + F.col("rank"))), 9).alias("score"))
    return out.orderBy(F.desc("score"), "item").limit(k)


def history_tail(turns: DataFrame, n: int = 6) -> DataFrame:
    """The n messages before the last one of each conversation."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("back", back).filter(F.col("back").between(2, n + 1))


def history_turns(turns: DataFrame, n: int = 3) -> DataFrame:
    """The last n user messages of each conversation."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.filter(F.col("role") == "user").withColumn("back", back).filter(F.col("back") <= n)


def split_query(turns: DataFrame) -> DataFrame:
    """The last message of each conversation and how many came before."""
    return turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("query"), (F.count("*") - 1).alias("history"))


def prompts(turns: DataFrame, context: str) -> DataFrame:
    """The chat prompt of each conversation: context, the six messages before the last, the question."""
    said = F.concat(capitalize(F.col("role")), F.lit(": "), F.col("text"))
    past = history_tail(turns).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("s")))), lambda x: x["s"]), "\n").alias("past"))
    history = F.when(F.coalesce("past", F.lit("")) != "", F.concat(F.lit("Conversation history:\n"), "past", F.lit("\n\n"))).otherwise("")
    head = f"You are a knowledgeable assistant. Answer based on the context below.\n\nContext:\n{context}\n\n"
    out = split_query(turns).join(past, "conv_id", "left")
    return out.select("conv_id", F.concat(F.lit(head), history, F.lit("User: "), "query", F.lit("\nAssistant:")).alias("prompt"))


def question_prompt(question, context):
    """The prompt without a history."""
    return F.concat(F.lit("Answer the following question using only the provided context.\n\nContext:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))
