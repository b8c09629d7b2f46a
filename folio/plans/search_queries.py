"""Queries over indexes: vectors by cells, words by BM25, synonyms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folio.operators import chunking, extract, lexical, modularity, retrieval, vector_index
from folio.operators.band_index import BandIndex
from folio.operators.bucketed import BucketedTable
from folio.plans import views
from folio.plans import store_queries
from folio.plans.store_queries import _EDGE_DEGREE, _SCORED, QUERY, WORDS
from folio.plans.views import GRAPH
from folio.plans.text_queries import _KEPT
from folio.session import shared_dir, staged, table
from folio.streaming.transitions import invalid_transitions_stream
from folio.streaming.upserts import batch_upsert, upsert_stream

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- vectors by cells --------------------------------------------------------------------------------------------
def _vectors(spark, sf):
    rows = table(spark, sf, "embeddings")
    return rows, rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query("vector_index_topk")
def vector_index_topk(spark, sf):
    """The ten nearest vectors of every vector, from so many cells of a written index as nineteen in twenty neighbours of a sample need."""
    rows, asked = _vectors(spark, sf)
    path = f"{shared_dir(spark)}/folio-index-{uuid.uuid4().hex}"
    vector_index.build(rows, 64).write(path)
    index = vector_index.Index.read(spark, path)
    out = vector_index.search(index, rows, asked, 10, vector_index.tuned_probes(index, rows, 10))
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(
    "vector_index_exact",
    """SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id)::INT AS rank
  FROM (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v)
) WHERE rank <= 10""",
)
def vector_index_exact(spark, sf):
    """The ten nearest vectors of every vector, from all cells that can hold one."""
    rows, asked = _vectors(spark, sf)
    out = vector_index.search_exact(vector_index.build(rows, 64), rows, asked, 10)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


# --- words -------------------------------------------------------------------------------------------------------
_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
_BM25 = f"""held AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents), whole AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, sum(len(ws)) AS n_words FROM held),
tf AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM held) GROUP BY ALL),
idf AS (SELECT term, ln(1 + (any_value(n_docs) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, whole GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
bm25 AS (SELECT item_id, doc_id, round(sum(idf * tf * {lexical.K1 + 1} / (tf + {lexical.K1} * (1 - {lexical.B} + {lexical.B} * n / (n_words::DOUBLE / n_docs)))), 9) AS score FROM asked JOIN tf USING (term) JOIN idf USING (term), whole GROUP BY item_id, doc_id)"""


@query("bm25_topk", f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY item_id ORDER BY bm25.score DESC, doc_id))::INT AS rank FROM bm25 QUALIFY rank <= 10")
def bm25_topk(spark, sf):
    """The ten best documents of each benchmark item, from a written index."""
    path = f"{shared_dir(spark)}/folio-words-{uuid.uuid4().hex}"
    lexical.index(table(spark, sf, "documents")).write(path)
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    out = lexical.bm25(lexical.InvertedIndex.read(spark, path), asked, 10)
    return out.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(
    "retrieve_reranked",
    f"""WITH {_SCORED}, near AS (SELECT vec_id FROM scored ORDER BY round(score, 9) DESC, vec_id LIMIT 50), {_BM25}, first AS (SELECT min(item_id) AS item_id FROM benchmark)
SELECT 'chunk:' || vec_id AS item, round(coalesce(b.score, 0), 6) AS score, (row_number() OVER (ORDER BY coalesce(b.score, 0) DESC, vec_id))::INT AS rank
FROM near LEFT JOIN (SELECT * FROM bm25 JOIN first USING (item_id)) b ON b.doc_id = vec_id QUALIFY rank <= 20""",
)
def retrieve_reranked(spark, sf):
    """The fifty chunks nearest to the query's vector, in the order of their BM25 score for its text."""
    near = retrieval.naive(table(spark, sf, "embeddings"), QUERY, 50)
    asked = table(spark, sf, "benchmark").orderBy("item_id").limit(1).select(F.lit(0).alias("query_id"), "text")
    out = retrieval.reranked(near, lexical.index(table(spark, sf, "documents")), asked, 20)
    return out.select("item", F.round("score", 6).alias("score"), "rank")


def _synonym_sql(rows: str, key: str, text: str, window: int, least: int, k: int, pmi: float) -> str:
    ws = f"regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+')"
    return f"""placed AS MATERIALIZED (SELECT id, generate_subscripts(ws, 1) AS place, unnest(ws) AS word FROM (SELECT {key} AS id, {ws} AS ws FROM {rows})), usable AS MATERIALIZED (SELECT * FROM placed WHERE length(word) >= 3),
counted AS MATERIALIZED (SELECT word, count(*) AS n FROM usable GROUP BY word HAVING count(*) >= {least}), total AS (SELECT count(*) AS total FROM usable),
paired AS (SELECT least(x.word, y.word) AS a, greatest(x.word, y.word) AS b, count(*) AS pairs FROM usable x JOIN (SELECT id, place, word, unnest(range(1, {window + 1})) AS back FROM usable) y ON x.id = y.id AND x.place = y.place - back AND x.word <> y.word GROUP BY ALL HAVING count(*) >= {least}),
pmi AS (SELECT a, b, pairs, round(ln(pairs * total::DOUBLE / (m.n * n.n * {2.0 * window})), 6) AS pmi FROM paired JOIN counted m ON m.word = a JOIN counted n ON n.word = b, total),
synonyms AS (SELECT * FROM (SELECT a AS word, b AS synonym, pairs, pmi FROM pmi WHERE pmi >= {pmi} UNION ALL SELECT b, a, pairs, pmi FROM pmi WHERE pmi >= {pmi}) QUALIFY row_number() OVER (PARTITION BY word ORDER BY pmi DESC, pairs DESC, synonym) <= {k})"""


@query("synonyms", f"WITH {_synonym_sql('documents', 'doc_id', 'text', 4, 5, 5, 2.0)} SELECT word, synonym, pairs, pmi FROM synonyms")
def synonyms(spark, sf):
    return lexical.synonyms(table(spark, sf, "documents"))


_ASKED = "ring"


@query(
    "retrieve_local_synonyms",
    f"""WITH {_EDGE_DEGREE}, {_synonym_sql('nodes', 'id', 'entity_name', 4, 2, 3, 0.0)}, words AS (SELECT list(w) AS ws FROM (SELECT '{_ASKED}' AS w UNION SELECT synonym FROM synonyms WHERE word = '{_ASKED}')),
hits AS (SELECT id, len(list_intersect(string_split_regex(lower(entity_name), '[^\\p{{L}}\\p{{N}}]+'), ws)) AS m FROM nodes, words), touched AS (
  SELECT rel_id, sum(m) AS matched FROM (SELECT rel_id, src_id AS id FROM edges UNION ALL SELECT rel_id, tgt_id FROM edges) JOIN hits USING (id) WHERE m > 0 GROUP BY rel_id
) SELECT 'edge:' || s.rel_id AS item, (row_number() OVER (ORDER BY matched DESC, weight DESC, edge_degree DESC, s.rel_id))::INT AS rank FROM scored s JOIN touched USING (rel_id) QUALIFY rank <= 20""",
)
def retrieve_local_synonyms(spark, sf):
    """Local retrieval by a word and what stands near it in the entities' names."""
    nodes = staged(views.graph_nodes(spark, sf), "nodes")
    table_ = lexical.synonyms(nodes, least=2, k=3, least_pmi=0.0, key="id", text="entity_name")
    return retrieval.local(nodes, views.graph_edges(spark, sf), lexical.expanded([_ASKED], table_), 20)


# --- communities that divide a component -------------------------------------------------------------------------
@query("modularity_communities")
def modularity_communities(spark, sf):
    return modularity.communities(views.graph_edges(spark, sf))


@query("modularity_parts")
def modularity_parts(spark, sf):
    """What each community adds to the modularity of the whole graph."""
    edges = staged(views.graph_edges(spark, sf).select("src_id", "tgt_id", "weight"), "edges")
    return modularity.parts(edges, modularity.communities(edges)).withColumn("part", F.round("part", 9))


@query("retrieve_modular_communities")
def retrieve_modular_communities(spark, sf):
    return retrieval.global_communities(views.graph_edges(spark, sf), WORDS, 10, modularity.communities)


# --- tables that change by batches -------------------------------------------------------------------------------
_BATCHES = 3
_BATCHED = f"""taken AS (SELECT (doc_id % {_BATCHES})::INT AS batch, doc_id, lang, n_chars FROM documents), again AS (SELECT * FROM taken UNION ALL SELECT {_BATCHES}, doc_id, 'again', n_chars FROM documents WHERE doc_id % 5 = 0)"""


def _fresh(spark, name):
    return f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"


@query("kv_upsert_buckets", f"WITH {_BATCHED} SELECT doc_id, arg_max(lang, batch) AS lang, any_value(n_chars) AS n_chars FROM again GROUP BY doc_id HAVING doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def kv_upsert_buckets(spark, sf):
    """Documents in three upserts, some changed by a fourth and some deleted by a fifth; each rewrites the buckets it touches."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    held = BucketedTable(spark, _fresh(spark, "kv"), "doc_id long, lang string, n_chars long", ["doc_id"], 16)
    for batch in range(_BATCHES):
        held.upsert(docs.filter(F.col("doc_id") % _BATCHES == batch))
    held.upsert(docs.filter("doc_id % 5 = 0").withColumn("lang", F.lit("again")))
    held.delete(table(spark, sf, "labels").filter("toxic = 1"))
    return held.read()


@query("stream_upsert", "SELECT md5(text) AS key, count(DISTINCT text) AS texts, max(doc_id) AS last FROM documents GROUP BY 1")
def stream_upsert(spark, sf):
    """The documents as a stream into a table by text, with the last document of each; the batch is delivered twice."""
    held = BucketedTable(spark, _fresh(spark, "stream"), "key string, texts long, last long", ["key"], 16)
    prepare = lambda df: df.groupBy(F.md5(F.col("text").cast("binary")).alias("key")).agg(F.lit(1).cast("long").alias("texts"), F.max("doc_id").alias("last"))
    docs = table(spark, sf, "documents")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf}/documents.parque[t]")  # a pattern may name one file as well as a folder
    upsert_stream(stream, held, _fresh(spark, "stream-checkpoint"), "last", prepare).awaitTermination()
    batch_upsert(held, "last", prepare)(docs.withColumn("doc_id", F.col("doc_id") + 1), held.versions()[-1])  # a version that is there already
    return held.read()


@query("dedup_batches", f"WITH {_KEPT} SELECT id FROM kept")
def dedup_batches(spark, sf):
    """The documents in three batches by id, each held against what the ones before kept."""
    docs = table(spark, sf, "documents")
    most = docs.agg(F.max("doc_id")).first()[0] or 0
    kept = BandIndex(spark, _fresh(spark, "bands"))
    for batch in range(_BATCHES):
        kept.add(docs.filter(F.floor(F.col("doc_id") * _BATCHES / (most + 1)) == batch), batch)
    return kept.kept().select("id")


@query("invalid_transitions_stream", store_queries.ORACLES["invalid_transitions"])
def invalid_transitions_as_stream(spark, sf):
    """The same changes as ``invalid_transitions``, from the events as a stream."""
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")
    kind = F.col("event_type")
    status = F.when(kind == "view", "pending").when(kind == "click", "processing").when(kind == "purchase", "processed").otherwise("failed")
    history = events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), status.alias("status"), "ts")
    out = _fresh(spark, "transitions")
    invalid_transitions_stream(history).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id long, seq long, before string, status string").parquet(out)


# --- names and chunks --------------------------------------------------------------------------------------------
_FUZZY = f"""{GRAPH}, exact AS (SELECT lower(trim(entity_name)) AS name, count(*) AS n, min(id) AS id FROM nodes GROUP BY ALL), alike AS MATERIALIZED (
  SELECT a.name AS id, b.name AS near FROM exact a JOIN exact b ON a.name <> b.name AND regexp_replace(a.name, '[^0-9]', '', 'g') = regexp_replace(b.name, '[^0-9]', '', 'g')
    AND abs(length(a.name) - length(b.name)) <= least(length(a.name), length(b.name)) // {extract.PER_EDIT} AND levenshtein(a.name, b.name) <= least(length(a.name), length(b.name)) // {extract.PER_EDIT}
), spreading(id, entity) USING KEY (id) AS (
  SELECT name, name FROM exact
  UNION
  SELECT l.id, min(s.entity) FROM spreading s JOIN alike l ON l.near = s.id JOIN recurring.spreading r ON r.id = l.id GROUP BY l.id, r.entity HAVING min(s.entity) < r.entity
)"""


@query("resolve_fuzzy", f"WITH RECURSIVE {_FUZZY} SELECT e.name, s.entity, w.n, w.id FROM exact e JOIN spreading s ON s.id = e.name JOIN (SELECT entity, sum(n)::BIGINT AS n, min(e.id) AS id FROM exact e JOIN spreading s ON s.id = e.name GROUP BY entity) w USING (entity)")
def resolve_fuzzy(spark, sf):
    return extract.resolve_fuzzy(views.graph_nodes(spark, sf))


@query("chunk_vectors")
def chunk_vectors(spark, sf):
    return chunking.chunk_vectors(table(spark, sf, "documents").select("doc_id", "text"))
