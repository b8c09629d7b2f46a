"""Queries over stores: graph, vectors, key-value and status tables, notes, extraction runs, retrieval and chat."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import patterns as P
from folio.functions.text import file_name, keywords
from folio.operators import extract, graph, notes, retrieval, stats, tables, vectors
from folio.plans import views
from folio.plans.views import GRAPH, quoted
from folio.session import shared_dir, staged, table
from folio.sources import files
from folio.streaming.ingest import event_counts as counted_events

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- graph -------------------------------------------------------------------------------------------------------
HUB = "nation:7"


@query("get_node", f"WITH {GRAPH} SELECT * FROM nodes WHERE id = '{HUB}'")
def get_node(spark: SparkSession, sf: str) -> DataFrame:
    return views.graph_nodes(spark, sf).filter(F.col("id") == HUB)


@query("graph_nodes", f"WITH {GRAPH} SELECT id, entity_name AS label, entity_type AS type FROM nodes")
def graph_nodes(spark, sf):
    return views.graph_nodes(spark, sf).select("id", F.col("entity_name").alias("label"), F.col("entity_type").alias("type"))


@query("graph_edges", f'WITH {GRAPH} SELECT src_id AS "from", tgt_id AS "to", label FROM edges')
def graph_edges(spark, sf):
    return views.graph_edges(spark, sf).select(F.col("src_id").alias("from"), F.col("tgt_id").alias("to"), "label")


@query("node_edges", f"WITH {GRAPH} SELECT rel_id FROM edges WHERE src_id = '{HUB}' OR tgt_id = '{HUB}'")
def node_edges(spark, sf):
    return graph.incident(views.graph_edges(spark, sf), HUB).select("rel_id")


@query("nodes_edges", f"WITH {GRAPH} SELECT DISTINCT rel_id FROM edges WHERE src_id IN (SELECT id FROM nodes WHERE entity_type = 'supplier') OR tgt_id IN (SELECT id FROM nodes WHERE entity_type = 'supplier')")
def nodes_edges(spark, sf):
    asked = views.graph_nodes(spark, sf).filter("entity_type = 'supplier'")
    return graph.incident_to(views.graph_edges(spark, sf), asked).select("rel_id")


@query("has_edge", f"WITH {GRAPH} SELECT count(*) > 0 AS found FROM edges WHERE rel_id = 'nation:7___region:3'")
def has_edge(spark, sf):
    return views.graph_edges(spark, sf).filter("rel_id = 'nation:7___region:3'").agg((F.count("*") > 0).alias("found"))


@query("node_degree", f"WITH {GRAPH} SELECT id, degree FROM degree")
def node_degree(spark, sf):
    return graph.degrees(views.graph_edges(spark, sf))


_EDGE_DEGREE = f"""{GRAPH}, scored AS (
  SELECT e.*, coalesce(a.degree, 0) + coalesce(b.degree, 0) AS edge_degree FROM edges e LEFT JOIN degree a ON a.id = src_id LEFT JOIN degree b ON b.id = tgt_id
)"""


@query("edge_degree", f"WITH {_EDGE_DEGREE} SELECT rel_id, edge_degree FROM scored")
def edge_degree(spark, sf):
    return graph.edge_degrees(staged(views.graph_edges(spark, sf), "edges")).select("rel_id", "edge_degree")


@query("popular_labels", f"WITH {GRAPH} SELECT id, entity_name, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degree USING (id) ORDER BY degree DESC, id LIMIT 20")
def popular_labels(spark, sf):
    return graph.popular(views.graph_nodes(spark, sf), views.graph_edges(spark, sf), 20)


@query("search_labels", f"WITH {GRAPH} SELECT DISTINCT entity_name FROM nodes WHERE contains(lower(entity_name), 'an')")
def search_labels(spark, sf):
    return graph.search_labels(views.graph_nodes(spark, sf), "AN")


@query("upsert_nodes", f"WITH {GRAPH} SELECT * FROM nodes WHERE entity_type <> 'supplier' UNION ALL SELECT id, upper(entity_name), 'vendor' FROM nodes WHERE entity_type = 'supplier' UNION ALL SELECT 'new:1', 'New', 'Concept'")
def upsert_nodes(spark, sf):
    old = views.graph_nodes(spark, sf)
    changed = old.filter("entity_type = 'supplier'").select("id", F.upper("entity_name").alias("entity_name"), F.lit("vendor").alias("entity_type"))
    fresh = spark.range(1).select(F.lit("new:1").alias("id"), F.lit("New").alias("entity_name"), F.lit("Concept").alias("entity_type"))
    return tables.upsert(old, changed.unionByName(fresh), ["id"])


@query("upsert_edges", f"WITH {GRAPH} SELECT rel_id, src_id, tgt_id, label, CASE WHEN label = 'IN_NATION' THEN 2.0 ELSE weight END AS weight, keywords FROM edges")
def upsert_edges(spark, sf):
    old = views.graph_edges(spark, sf)
    return tables.upsert(old, old.filter("label = 'IN_NATION'").withColumn("weight", F.lit(2.0)), ["rel_id"])


@query("delete_node", f"WITH {GRAPH} SELECT rel_id FROM edges WHERE src_id <> '{HUB}' AND tgt_id <> '{HUB}'")
def delete_node(spark, sf):
    gone = spark.range(1).select(F.lit(HUB).alias("id"))
    return graph.delete_nodes(views.graph_nodes(spark, sf), views.graph_edges(spark, sf), gone)[1].select("rel_id")


@query("delete_nodes", f"WITH {GRAPH} SELECT id, entity_name FROM nodes WHERE id <> '{HUB}'")
def delete_nodes(spark, sf):
    gone = spark.range(1).select(F.lit(HUB).alias("id"))
    return graph.delete_nodes(views.graph_nodes(spark, sf), views.graph_edges(spark, sf), gone)[0].select("id", "entity_name")


@query("delete_edges", f"WITH {GRAPH} SELECT rel_id FROM edges WHERE label <> 'IN_REGION'")
def delete_edges(spark, sf):
    edges = views.graph_edges(spark, sf)
    return tables.delete(edges, edges.filter("label = 'IN_REGION'"), ["rel_id"]).select("rel_id")


@query(
    "bfs_khop",
    f"""WITH {GRAPH}, both_ AS (SELECT src_id AS a, tgt_id AS b FROM edges UNION SELECT tgt_id, src_id FROM edges),
h1 AS (SELECT DISTINCT b AS id FROM both_ WHERE a = 'region:3'), h2 AS (SELECT DISTINCT b AS id FROM both_ JOIN h1 ON a = id), h3 AS (SELECT DISTINCT b AS id FROM both_ JOIN h2 ON a = id)
SELECT id, min(hop)::INT AS hop FROM (SELECT 'region:3' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2 UNION ALL SELECT id, 3 FROM h3) GROUP BY id""",
)
def bfs_khop(spark, sf):
    return graph.k_hop(staged(views.graph_edges(spark, sf), "edges"), spark.range(1).select(F.lit("region:3").alias("id")), 3)


_COMMUNITY = f"""{GRAPH}, linked AS (SELECT src_id AS id, tgt_id AS near FROM edges UNION SELECT tgt_id, src_id FROM edges), spreading(id, community) USING KEY (id) AS (
  SELECT id, id FROM (SELECT DISTINCT id FROM linked)
  UNION
  SELECT l.id, min(s.community) FROM spreading s JOIN linked l ON l.near = s.id JOIN recurring.spreading r ON r.id = l.id GROUP BY l.id, r.community HAVING min(s.community) < r.community
)"""


@query("graph_communities", f"WITH RECURSIVE {_COMMUNITY} SELECT id, community FROM spreading")
def graph_communities(spark, sf):
    return graph.communities(views.graph_edges(spark, sf))


@query(
    "community_summary",
    f"""WITH RECURSIVE {_COMMUNITY} SELECT c.community, c.nodes, e.edges, e.weight FROM (SELECT community, count(*) AS nodes FROM spreading GROUP BY ALL) c
LEFT JOIN (SELECT community, count(*) AS edges, round(sum(weight), 6) AS weight FROM edges JOIN spreading ON src_id = id GROUP BY ALL) e USING (community)""",
)
def community_summary(spark, sf):
    return retrieval.community_summary(views.graph_edges(spark, sf))


# --- notes -------------------------------------------------------------------------------------------------------
_NOTES = f"""{views.NOTES}, parsed AS (
  SELECT path, 'note::' || md5(path) AS ref_doc_id, rtrim(regexp_replace(content, '(?s)\\A---\\n.*?\\n---\\n', ''), 'ø ' || chr(10)) AS body, regexp_extract(content, '(?s)\\A---\\n(.*?)\\n---\\n', 1) AS front FROM notes
), kept AS (SELECT *, regexp_extract(body, '(?m)^#\\s+(.+)$', 1) AS title FROM parsed WHERE NOT contains(body, '${{FOAM_'))"""
_TAGS = "list_filter(list_transform(CASE WHEN regexp_extract(front, '(?m)^tags: *\\[([^\\]]*)\\]', 1) <> '' THEN string_split(regexp_extract(front, '(?m)^tags: *\\[([^\\]]*)\\]', 1), ',') ELSE regexp_extract_all(front, '(?m)^ *- (.*)$', 1) END, lambda t: trim(t)), lambda t: t <> '')"


@query("wikilinks", f"WITH {_NOTES} SELECT ref_doc_id, title AS src_id, trim(unnest(regexp_extract_all(body, '\\[\\[([^\\]]+)\\]\\]', 1))) AS tgt_id, 'RELATES_TO' AS label FROM kept")
def wikilinks(spark, sf):
    return notes.relations(notes.parse(views.notes(spark, sf))).select("ref_doc_id", "src_id", "tgt_id", "label")


@query("note_concepts", f"WITH {_NOTES} SELECT ref_doc_id, title AS entity_name, array_to_string({_TAGS}, ',') AS tags FROM kept")
def note_concepts(spark, sf):
    return notes.entities(notes.parse(views.notes(spark, sf))).select("ref_doc_id", "entity_name", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ",").alias("tags"))


def _store(spark, sf):
    """Rows of three kinds as a store holds them: books, notes, and rows that only their ids place."""
    docs = table(spark, sf, "documents")
    kind = F.when(F.col("lang") == "en", "book").when(F.col("lang") == "fr", "note")
    key = F.when(F.col("lang") == "de", F.concat(F.lit("book::"), F.col("doc_id").cast("string"))).when(F.col("lang") == "es", F.concat(F.lit("note::"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    return docs.select(key.alias("id"), kind.alias("source_type"), F.lit(None).cast("string").alias("ref_doc_id"), F.lower(F.trim("source")).alias("name"))


_STORE = "store AS (SELECT CASE lang WHEN 'de' THEN 'book::' || doc_id WHEN 'es' THEN 'note::' || doc_id ELSE doc_id::VARCHAR END AS id, CASE lang WHEN 'en' THEN 'book' WHEN 'fr' THEN 'note' END AS source_type, lower(trim(source)) AS name FROM documents)"


@query("purge_books", f"WITH {_STORE} SELECT id FROM store WHERE coalesce(source_type, '') <> 'book' AND NOT starts_with(id, 'book::')")
def purge_books(spark, sf):
    return tables.purge(_store(spark, sf), "book").select("id")


@query("purge_notes", f"WITH {_STORE} SELECT id FROM store WHERE coalesce(source_type, '') <> 'note' AND NOT starts_with(id, 'note::')")
def purge_notes(spark, sf):
    return tables.purge(_store(spark, sf), "note").select("id")


@query("purge_edges", f"WITH {GRAPH} SELECT rel_id FROM edges WHERE NOT starts_with(src_id, 'supplier:') AND NOT starts_with(tgt_id, 'supplier:')")
def purge_edges(spark, sf):
    """A namespace goes with its nodes and all edges at them."""
    kind = F.when(F.col("entity_type") == "supplier", "book").otherwise("note")
    held = views.graph_nodes(spark, sf).withColumn("source_type", kind).withColumn("ref_doc_id", F.lit(None).cast("string"))
    return tables.purge_graph(held, views.graph_edges(spark, sf), "book")[1].select("rel_id")


@query("graph_export", f"WITH {GRAPH} SELECT src_id, tgt_id, label, weight FROM edges")
def graph_export(spark, sf):
    """A graph that was exported and imported again."""
    path = f"{shared_dir(spark)}/folio-graph-{uuid.uuid4().hex}"
    n, e = views.graph_nodes(spark, sf), views.graph_edges(spark, sf)
    files.write_graph(n, e, path)
    return files.read_graph(spark, path, n.schema, e.schema)[1].select("src_id", "tgt_id", "label", "weight")


@query("rebuild_notes", f"WITH {_STORE}, {_NOTES} SELECT id, source_type FROM store WHERE coalesce(source_type, '') <> 'note' UNION ALL SELECT ref_doc_id, 'note' FROM kept")
def rebuild_notes(spark, sf):
    fresh = notes.entities(notes.parse(views.notes(spark, sf))).select(F.col("ref_doc_id").alias("id"), "source_type")
    return notes.rebuild(_store(spark, sf).select("id", "source_type"), fresh)


@query("bridge_entities", f"WITH {_STORE} SELECT DISTINCT b.name FROM store b JOIN store n ON b.name = n.name WHERE b.source_type = 'book' AND n.source_type = 'note'")
def bridge_entities(spark, sf):
    rows = _store(spark, sf).select("name", "source_type")
    return rows.filter("source_type = 'book'").select("name").distinct().join(rows.filter("source_type = 'note'"), "name", "left_semi")


@query("resolve_entities", f"WITH {GRAPH} SELECT lower(trim(entity_name)) AS name, count(*) AS n, min(id) AS id FROM nodes GROUP BY ALL")
def resolve_entities(spark, sf):
    return extract.resolve_entities(views.graph_nodes(spark, sf))


# --- vectors -----------------------------------------------------------------------------------------------------
QUERY = [1.0 if i % 2 else -0.5 for i in range(64)]
_Q = "[" + ", ".join(map(str, QUERY)) + "]::DOUBLE[]"
_SCORED = f"scored AS (SELECT vec_id, label, embedding, list_cosine_similarity(embedding::DOUBLE[], {_Q}) AS score FROM embeddings)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.round("score", 6).alias("score"))


@query("vector_topk", f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM scored ORDER BY round(scored.score, 9) DESC, vec_id LIMIT 10")
def vector_topk(spark, sf):
    return _rounded(vectors.top_k(table(spark, sf, "embeddings"), QUERY, 10))


@query("vector_topk_filtered", f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM scored WHERE label = 3 ORDER BY round(scored.score, 9) DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark, sf):
    return _rounded(vectors.top_k(table(spark, sf, "embeddings"), QUERY, 10, F.col("label") == 3))


@query("vector_cutoff", f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM scored WHERE scored.score >= 0.05 ")
def vector_cutoff(spark, sf):
    return _rounded(vectors.at_least(table(spark, sf, "embeddings"), QUERY, 0.05))


@query("vectors_by_ids", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)")
def vectors_by_ids(spark, sf):
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id")).distinct()
    return table(spark, sf, "embeddings").join(asked, "vec_id", "left_semi").select("vec_id", "label")


@query("vectors_delete", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def vectors_delete(spark, sf):
    gone = table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"))
    return tables.delete(table(spark, sf, "embeddings"), gone, ["vec_id"]).select("vec_id", "label")


@query(
    "bridge_vectors",
    """SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id)::INT AS rank
  FROM (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.label = 0 AND v.label <> 0)
) WHERE rank <= 5""",
)
def bridge_vectors(spark, sf):
    rows = table(spark, sf, "embeddings")
    asked = rows.filter("label = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.top_k_each(rows.filter("label <> 0"), asked, 5).withColumn("score", F.round("score", 6))


@query("embed_texts")
def embed_texts(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", vectors.hashing_embedder()("text").alias("embedding"))


# --- key-value and status tables ---------------------------------------------------------------------------------
_STATUS = "status AS (SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status, o_orderdate AS updated_at, o_totalprice AS chunks FROM orders)"


def _status(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), status.alias("status"), F.col("o_orderdate").alias("updated_at"), F.col("o_totalprice").alias("chunks"))


@query("status_counts", f"WITH {_STATUS} SELECT status, count(*) AS n FROM status GROUP BY status")
def status_counts(spark, sf):
    return _status(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("status_counts_rollup", f"WITH {_STATUS} SELECT coalesce(status, 'all') AS status, count(*) AS n FROM status GROUP BY ROLLUP (status)")
def status_counts_rollup(spark, sf):
    return _status(spark, sf).rollup("status").agg(F.count("*").alias("n")).select(F.coalesce("status", F.lit("all")).alias("status"), "n")


@query("docs_by_status", f"WITH {_STATUS} SELECT doc_id FROM status WHERE status IN ('pending', 'failed')")
def docs_by_status(spark, sf):
    return _status(spark, sf).filter(F.col("status").isin("pending", "failed")).select("doc_id")


@query("status_filter_keys", f"WITH {_STATUS} SELECT DISTINCT l_orderkey AS doc_id FROM lineitem WHERE l_orderkey NOT IN (SELECT doc_id FROM status WHERE status = 'processed')")
def status_filter_keys(spark, sf):
    asked = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct()
    return tables.pending(asked, _status(spark, sf), "doc_id")


@query("pending_docs", f"WITH {_STATUS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM status WHERE status = 'processed')")
def pending_docs(spark, sf):
    return tables.pending(table(spark, sf, "documents").select("doc_id"), _status(spark, sf), "doc_id")


@query("docs_page", f"WITH {_STATUS} SELECT doc_id, updated_at FROM status ORDER BY updated_at, doc_id LIMIT 25 OFFSET 50")
def docs_page(spark, sf):
    return tables.page(_status(spark, sf), ["updated_at", "doc_id"], 50, 25).select("doc_id", "updated_at")


_ASKED = "asked AS (SELECT * FROM documents WHERE doc_id % 100 = 0)"


def _by(spark, sf, field):
    """Documents that share a field's value with the stated query set of every hundredth one."""
    docs = table(spark, sf, "documents").select("doc_id", field.alias("f"))
    return tables.lookup(docs, docs.filter("doc_id % 100 = 0"), "f").select("doc_id")


@query("docs_by_hash", f"WITH {_ASKED} SELECT doc_id FROM documents WHERE md5(text) IN (SELECT md5(text) FROM asked)")
def docs_by_hash(spark, sf):
    return _by(spark, sf, F.md5(F.col("text").cast("binary")))


@query("docs_by_path", f"WITH {_ASKED} SELECT doc_id FROM documents WHERE source || '/' || (doc_id % 700) IN (SELECT source || '/' || (doc_id % 700) FROM asked)")
def docs_by_path(spark, sf):
    return _by(spark, sf, F.concat("source", F.lit("/"), (F.col("doc_id") % 700).cast("string")))


@query("docs_by_basename", f"WITH {_ASKED} SELECT doc_id FROM documents WHERE doc_id % 700 IN (SELECT doc_id % 700 FROM asked)")
def docs_by_basename(spark, sf):
    return _by(spark, sf, file_name(F.concat(F.lit("x/"), "source", F.lit("/"), (F.col("doc_id") % 700).cast("string"))))


@query("docs_by_track", f"WITH {_ASKED} SELECT doc_id FROM documents WHERE source IN (SELECT source FROM asked)")
def docs_by_track(spark, sf):
    return _by(spark, sf, F.col("source"))


@query("kv_is_empty", "SELECT count(*) = 0 AS is_empty FROM documents WHERE lang = 'xx'")
def kv_is_empty(spark, sf):
    return tables.is_empty(table(spark, sf, "documents").filter("lang = 'xx'"))


@query("kv_drop", "SELECT lang, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY lang")
def kv_drop(spark, sf):
    return tables.reset(table(spark, sf, "documents").withColumn("namespace", F.col("lang")), "en").groupBy("lang").agg(F.count("*").alias("n"))


@query("status_merge", f"WITH {_STATUS} SELECT coalesce(s.doc_id, c.c_custkey) AS doc_id, coalesce(c.st, s.status) AS status, s.updated_at, coalesce(c.c_acctbal, s.chunks) AS chunks FROM status s FULL JOIN (SELECT *, CASE WHEN c_acctbal > 0 THEN 'processed' END AS st FROM customer) c ON s.doc_id = c.c_custkey")
def status_merge(spark, sf):
    new = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_acctbal") > 0, "processed").alias("status"), F.lit(None).cast("timestamp").alias("updated_at"), F.col("c_acctbal").alias("chunks"))
    return tables.merge(_status(spark, sf), new, ["doc_id"])


@query(
    "invalid_transitions",
    """WITH h AS (
  SELECT user_id AS doc_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'processed' ELSE 'failed' END AS status FROM events
), s AS (SELECT *, lag(status) OVER (PARTITION BY doc_id ORDER BY seq) AS before FROM h)
SELECT doc_id, seq, before, status FROM s WHERE before IS NOT NULL AND before <> status
  AND (before, status) NOT IN (('pending', 'processing'), ('processing', 'processed'), ('processing', 'failed'), ('failed', 'processing'))""",
)
def invalid_transitions(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind == "view", "pending").when(kind == "click", "processing").when(kind == "purchase", "processed").otherwise("failed")
    history = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), status.alias("status"))
    return tables.invalid_transitions(history).select("doc_id", "seq", "before", "status")


@query("kv_get_by_ids", "SELECT (row_number() OVER (ORDER BY item_id DESC) - 1)::INT AS pos, item_id AS doc_id, lang, n_chars FROM benchmark LEFT JOIN documents ON doc_id = item_id")
def kv_get_by_ids(spark, sf):
    asked = table(spark, sf, "benchmark").agg(F.sort_array(F.collect_list("item_id"), asc=False).alias("ids")).select(F.posexplode("ids").alias("pos", "doc_id"))
    return tables.get_by_ids(table(spark, sf, "documents"), asked, "doc_id", ["lang", "n_chars"])


@query("kv_filter_keys", "SELECT DISTINCT c_custkey AS doc_id FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM documents)")
def kv_filter_keys(spark, sf):
    return tables.missing(table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id")), table(spark, sf, "documents"), ["doc_id"])


@query("kv_upsert", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'q' || quality FROM labels")
def kv_upsert(spark, sf):
    new = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang"))
    return tables.upsert(table(spark, sf, "documents").select("doc_id", "lang"), new, ["doc_id"])


@query("kv_delete", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def kv_delete(spark, sf):
    return tables.delete(table(spark, sf, "documents"), table(spark, sf, "labels").filter("toxic = 1"), ["doc_id"]).select("doc_id")


@query("cache_misses", "SELECT DISTINCT md5(text) AS key FROM conversations WHERE role = 'user' AND md5(text) NOT IN (SELECT md5(text) FROM conversations WHERE role = 'assistant')")
def cache_misses(spark, sf):
    turns = table(spark, sf, "conversations").select("role", F.md5(F.col("text").cast("binary")).alias("key"))
    return tables.missing(turns.filter("role = 'user'"), turns.filter("role = 'assistant'"), ["key"])


@query("namespace_isolation", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'new' ELSE 'a' END AS value FROM documents")
def namespace_isolation(spark, sf):
    """Two namespaces hold the same keys; one is written to, the other is written to as well, and the first sees its own writes only."""
    keys = table(spark, sf, "documents").select("doc_id")
    shared = keys.select(F.lit("a").alias("namespace"), "doc_id", F.lit("a").alias("value")).unionByName(keys.select(F.lit("b").alias("namespace"), "doc_id", F.lit("b").alias("value")))
    toxic = table(spark, sf, "labels").filter("toxic = 1").select("doc_id").distinct()
    shared = tables.write_in_namespace(shared, toxic.withColumn("value", F.lit("new")), "a", ["doc_id"])
    shared = tables.write_in_namespace(shared, keys.withColumn("value", F.lit("other")), "b", ["doc_id"])
    return tables.in_namespace(shared, "a")


@query("retrieve_by_source", f"WITH {_STORE} SELECT id FROM store WHERE source_type IN ('note', 'book')")
def retrieve_by_source(spark, sf):
    return _store(spark, sf).filter(F.col("source_type").isin("note", "book")).select("id")


# --- extraction runs ---------------------------------------------------------------------------------------------
def _replies(spark, sf):
    return extract.parse_replies(views.replies(spark, sf))


@query("parse_extractions", f"WITH {views.REPLIES} SELECT id, array_to_string(list_transform(coalesce(r.entities, []), lambda e: e.name || ':' || e.type), ',') AS names, len(coalesce(r.relations, []))::INT AS n_relations FROM parsed_replies")
def parse_extractions(spark, sf):
    return _replies(spark, sf).select("id", F.array_join(F.transform("entities", lambda e: F.concat(e["name"], F.lit(":"), e["type"])), ",").alias("names"), F.size("relations").alias("n_relations"))


@query("schema_filter", f"WITH {views.REPLIES} SELECT id, len(list_filter(coalesce(r.entities, []), lambda e: e.type IN ({', '.join(map(quoted, P.ENTITY_TYPES))})))::INT AS n_entities FROM parsed_replies")
def schema_filter(spark, sf):
    return extract.in_schema(_replies(spark, sf)).select("id", F.size("entities").alias("n_entities"))


@query("extract_triples")
def extract_triples(spark, sf):
    return extract.extract_triples(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


def _calls(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("condition"), F.col("value").alias("seconds"), F.get_json_object("props", "$.k").cast("int").alias("gen_tokens"), (F.col("user_id") % 13).cast("int").alias("entities"), (F.col("event_id") % 7).cast("int").alias("relations"), ((F.col("event_id") % 11 != 0) & (F.col("event_type") != "purchase")).alias("ok"))


_OK = "event_id % 11 <> 0 AND event_type <> 'purchase'"
_SUMMARY = f"""calls AS (SELECT event_type AS condition, CASE WHEN {_OK} THEN value END AS s, CASE WHEN {_OK} THEN (props::JSON->>'k')::INT END AS k, CASE WHEN {_OK} THEN user_id % 13 END AS e, CASE WHEN {_OK} THEN event_id % 7 END AS r FROM events),
summary AS (SELECT condition, count(s) AS n, count(*) - count(s) AS failures, printf('%.2f', median(s))::DOUBLE AS median_s, printf('%.2f', avg(s))::DOUBLE AS mean_s,
  printf('%.2f', list_sort(list(s) FILTER (s IS NOT NULL))[greatest(floor(count(s) * 0.9), 1)::INT])::DOUBLE AS p90_s, printf('%.2f', min(s))::DOUBLE AS min_s, printf('%.2f', max(s))::DOUBLE AS max_s,
  trunc(median(k))::INT AS median_tokens, trunc(median(e))::INT AS median_entities, trunc(median(r))::INT AS median_relations, CASE WHEN count(s) = 0 THEN 'no successful calls' END AS note FROM calls GROUP BY condition)"""


@query("condition_summary", f"WITH {_SUMMARY} SELECT * FROM summary")
def condition_summary(spark, sf):
    return stats.condition_summary(_calls(spark, sf))


_M = "max(CASE WHEN condition = '{}' THEN median_s END)"


@query("condition_deltas", f"WITH {_SUMMARY} SELECT round((1 - {_M.format('click')} / {_M.format('view')}) * 100, 6) AS schema_saving_pct, round(({_M.format('signup')} / {_M.format('view')} - 1) * 100, 6) AS glean_cost_pct FROM summary")
def condition_deltas(spark, sf):
    out = stats.condition_deltas(stats.condition_summary(_calls(spark, sf)), "view", "click", "signup")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("extrapolate", f"WITH {_SUMMARY} SELECT chunks::INT AS chunks, round(chunks * median_s, 3) AS seconds FROM summary, (VALUES (80000), (300000), (1000000)) AS t(chunks) WHERE condition = 'view'")
def extrapolate(spark, sf):
    return stats.extrapolate(stats.condition_summary(_calls(spark, sf)), "view").select("chunks", F.round("seconds", 3).alias("seconds"))


@query("strata_sizes", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def strata_sizes(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query(
    "stratified_sample",
    """WITH o AS (SELECT doc_id, lang, md5(doc_id || '|0') AS o, count(*) OVER (PARTITION BY lang) AS size, count(*) OVER () AS total FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY o, doc_id) AS n FROM o)
SELECT doc_id, lang FROM r WHERE n <= greatest(1, round_even(40.0 * size / total, 0)) ORDER BY o, doc_id LIMIT 40""",
)
def stratified_sample(spark, sf):
    return stats.stratified_sample(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], 40, "doc_id")


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf):
    return counted_events(table(spark, sf, "events")).select(F.col("window.start").alias("start"), "event_type", "n")


# --- retrieval and chat ------------------------------------------------------------------------------------------
WORDS = ["supplier", "nation", "part"]
_WORDS = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"


@query("retrieve_naive", f"WITH {_SCORED}, top AS (SELECT * FROM scored ORDER BY round(score, 9) DESC, vec_id LIMIT 20) SELECT 'chunk:' || vec_id AS item, (row_number() OVER (ORDER BY round(score, 9) DESC, vec_id))::INT AS rank FROM top")
def retrieve_naive(spark, sf):
    return retrieval.naive(table(spark, sf, "embeddings"), QUERY, 20)


_LOCAL = f"""hits AS (SELECT id, len(list_intersect(string_split_regex(lower(entity_name), '[^\\p{{L}}\\p{{N}}]+'), ['supplier', '000000001', 'part'])) AS m FROM nodes), touched AS (
  SELECT rel_id, sum(m) AS matched FROM (SELECT rel_id, src_id AS id FROM edges UNION ALL SELECT rel_id, tgt_id FROM edges) JOIN hits USING (id) WHERE m > 0 GROUP BY rel_id
), local_top AS (SELECT s.rel_id, (row_number() OVER (ORDER BY matched DESC, weight DESC, edge_degree DESC, s.rel_id))::INT AS rank FROM scored s JOIN touched USING (rel_id))"""
_GLOBAL = f"""global_top AS (SELECT rel_id, (row_number() OVER (ORDER BY len(list_intersect(string_split_regex(lower(label || ' ' || keywords), '[^\\p{{L}}\\p{{N}}]+'), {_WORDS})) DESC, weight * edge_degree DESC, rel_id))::INT AS rank
  FROM scored WHERE len(list_intersect(string_split_regex(lower(label || ' ' || keywords), '[^\\p{{L}}\\p{{N}}]+'), {_WORDS})) > 0)"""


@query("retrieve_local", f"WITH {_EDGE_DEGREE}, {_LOCAL} SELECT 'edge:' || rel_id AS item, rank FROM local_top WHERE rank <= 20")
def retrieve_local(spark, sf):
    return retrieval.local(views.graph_nodes(spark, sf), views.graph_edges(spark, sf), ["supplier", "000000001", "part"], 20)


@query(
    "retrieve_communities",
    f"""WITH RECURSIVE {_COMMUNITY}, hit AS (SELECT community, count(*) AS matched FROM edges JOIN spreading ON src_id = id WHERE len(list_intersect(string_split_regex(lower(label || ' ' || keywords), '[^\\p{{L}}\\p{{N}}]+'), {_WORDS})) > 0 GROUP BY ALL),
c AS (SELECT community, count(*) AS nodes FROM spreading GROUP BY ALL), e AS (SELECT community, count(*) AS edges, round(sum(weight), 6) AS weight FROM edges JOIN spreading ON src_id = id GROUP BY ALL)
SELECT 'community:' || community AS item, (row_number() OVER (ORDER BY matched DESC, weight DESC, community))::INT AS rank, nodes, edges, weight FROM hit JOIN c USING (community) JOIN e USING (community) ORDER BY rank LIMIT 10""",
)
def retrieve_communities(spark, sf):
    return retrieval.global_communities(views.graph_edges(spark, sf), WORDS, 10)


@query(
    "retrieve_vector_context",
    f"""WITH {_SCORED}, near AS (SELECT 'supplier:' || vec_id AS id, score FROM scored ORDER BY round(score, 9) DESC, vec_id LIMIT 5), {GRAPH}, linked AS (SELECT src_id AS id, tgt_id AS near_id FROM edges UNION SELECT tgt_id, src_id FROM edges)
SELECT id, 0 AS hop, round(score, 6) AS score FROM near UNION ALL SELECT near_id, 1, round(max(score), 6) FROM linked JOIN near USING (id) WHERE near_id NOT IN (SELECT id FROM near) GROUP BY near_id""",
)
def retrieve_vector_context(spark, sf):
    held = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("supplier:"), F.col("vec_id").cast("string")).alias("id"), "embedding")
    out = retrieval.vector_context(held, views.graph_edges(spark, sf), QUERY, 5, "vec_id", "id")
    return out.withColumn("score", F.round("score", 6))


@query(
    "retrieve_cited",
    f"WITH {_SCORED}, top AS (SELECT * FROM scored WHERE label % 2 = 0 ORDER BY round(score, 9) DESC, vec_id LIMIT 20) SELECT 'chunk:' || t.vec_id AS item, (row_number() OVER (ORDER BY round(t.score, 9) DESC, t.vec_id))::INT AS rank, d.source || '.pdf' AS source_path, (d.doc_id % 9)::INT AS chunk_idx FROM top t LEFT JOIN documents d ON d.doc_id = t.vec_id",
)
def retrieve_cited(spark, sf):
    """Chunks of books alone, each with the file and the place it is from."""
    held = table(spark, sf, "embeddings").withColumn("source_type", F.when(F.col("label") % 2 == 0, "book").otherwise("note"))
    chunks = table(spark, sf, "documents").select(F.concat(F.lit("chunk:"), F.col("doc_id").cast("string")).alias("item"), F.concat("source", F.lit(".pdf")).alias("source_path"), (F.col("doc_id") % 9).cast("int").alias("chunk_idx"))
    return retrieval.cited(retrieval.naive(retrieval.of_sources(held, ["book"]), QUERY, 20), chunks)


@query("retrieve_global", f"WITH {_EDGE_DEGREE}, {_GLOBAL} SELECT 'edge:' || rel_id AS item, rank FROM global_top WHERE rank <= 20")
def retrieve_global(spark, sf):
    return retrieval.global_(views.graph_edges(spark, sf), WORDS, 20)


_FUSED = f"""{_EDGE_DEGREE}, {_LOCAL}, {_GLOBAL}, {_SCORED}, near AS (SELECT vec_id, (row_number() OVER (ORDER BY round(score, 9) DESC, vec_id))::INT AS rank FROM scored_vectors),
lists AS (SELECT 'edge:' || rel_id AS item, rank FROM local_top WHERE rank <= 20 UNION ALL SELECT 'edge:' || rel_id, rank FROM global_top WHERE rank <= 20 {{more}})
SELECT item, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM lists GROUP BY item ORDER BY score DESC, item LIMIT 20"""
_FUSED = _FUSED.replace("scored AS (SELECT vec_id", "scored_vectors AS (SELECT vec_id")


def _graph_lists(spark, sf):
    """Local and global over one edge table and its degrees."""
    edges = staged(views.graph_edges(spark, sf), "edges")
    degree = staged(graph.degrees(edges), "degrees")
    return retrieval.local(views.graph_nodes(spark, sf), edges, ["supplier", "000000001", "part"], 20, degree), retrieval.global_(edges, WORDS, 20, degree)


@query("retrieve_hybrid", f"WITH {_FUSED.replace('{more}', '')}")
def retrieve_hybrid(spark, sf):
    return retrieval.fuse(*_graph_lists(spark, sf), k=20)


@query("retrieve_mix", f"WITH {_FUSED.replace('{more}', "UNION ALL SELECT 'chunk:' || vec_id, rank FROM near WHERE rank <= 20")}")
def retrieve_mix(spark, sf):
    return retrieval.fuse(*_graph_lists(spark, sf), retrieve_naive(spark, sf), k=20)


@query("query_modes", "SELECT mode, count(conv_id) AS turns FROM (VALUES " + ", ".join(f"('{m}')" for m in P.MODES) + ") AS t(mode) LEFT JOIN (SELECT conv_id, CASE WHEN lower(trim(role)) IN ('mix', 'hybrid', 'local', 'global', 'naive') THEN lower(trim(role)) ELSE 'mix' END AS mode FROM conversations) USING (mode) GROUP BY mode")
def query_modes(spark, sf):
    """The modes, and how many turns ask for each."""
    modes = spark.createDataFrame([(m,) for m in P.MODES], "mode string")
    asked = table(spark, sf, "conversations").groupBy(retrieval.validate_mode(F.col("role")).alias("mode")).agg(F.count("*").alias("turns"))
    return modes.join(asked, "mode", "left").select("mode", F.coalesce("turns", F.lit(0)).alias("turns"))


@query("validate_mode", "SELECT conv_id, turn, CASE WHEN lower(trim(role)) IN ('mix', 'hybrid', 'local', 'global', 'naive') THEN lower(trim(role)) ELSE 'mix' END AS mode FROM conversations")
def validate_mode(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", retrieval.validate_mode(F.col("role")).alias("mode"))


_KEYWORDS = "list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}]+'), lambda w: length(w) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in retrieval.STOP) + "], w)))"


@query("query_keywords", f"SELECT item_id, array_to_string(list_sort({_KEYWORDS}), ',') AS words FROM benchmark")
def query_keywords(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(keywords(F.col("text"), retrieval.STOP)), ",").alias("words"))


@query("history_tail", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back BETWEEN 2 AND 7")
def history_tail(spark, sf):
    return retrieval.history_tail(table(spark, sf, "conversations")).select("conv_id", "turn", "role")


@query("history_turns", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role = 'user') WHERE back <= 3")
def history_turns(spark, sf):
    return retrieval.history_turns(table(spark, sf, "conversations")).select("conv_id", "turn")


@query("split_query", "SELECT conv_id, max_by(text, turn) AS query, count(*) - 1 AS history FROM conversations GROUP BY conv_id")
def split_query(spark, sf):
    return retrieval.split_query(table(spark, sf, "conversations"))


@query(
    "build_prompt",
    """WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
p AS (SELECT conv_id, string_agg(upper(role[1]) || lower(role[2:]) || ': ' || text, chr(10) ORDER BY turn) AS past FROM b WHERE back BETWEEN 2 AND 7 GROUP BY conv_id)
SELECT conv_id, 'You are a knowledgeable assistant. Answer based on the context below.' || chr(10) || chr(10) || 'Context:' || chr(10) || 'CTX' || chr(10) || chr(10)
  || CASE WHEN coalesce(past, '') <> '' THEN 'Conversation history:' || chr(10) || past || chr(10) || chr(10) ELSE '' END || 'User: ' || text || chr(10) || 'Assistant:' AS prompt
FROM b LEFT JOIN p USING (conv_id) WHERE back = 1""",
)
def build_prompt(spark, sf):
    return retrieval.prompts(table(spark, sf, "conversations"), "CTX")


@query("question_prompt", "SELECT item_id, 'Answer the following question using only the provided context.' || chr(10) || chr(10) || 'Context:' || chr(10) || 'CTX' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Answer:' AS prompt FROM benchmark")
def question_prompt(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", retrieval.question_prompt(F.col("text"), F.lit("CTX")).alias("prompt"))


@query("ndjson_chunks", """SELECT conv_id, turn, '{"model":"mix","message":{"role":"assistant","content":' || to_json(text) || '},"done":' || (role = 'assistant')::VARCHAR || '}' AS line FROM conversations""")
def ndjson_chunks(spark, sf):
    turns = table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", files.ndjson("mix", F.col("text"), F.col("role") == "assistant").alias("line"))
