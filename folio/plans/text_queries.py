"""Queries over documents: classification, routing, chunking, nodes, checks, deduplication."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import patterns as P
from folio.functions.text import book_id, preview, stem, ustrip
from folio.operators import chunking, classify, dedup, inspect, nodes
from folio.plans.views import DOCS, documents, quoted
from folio.session import shared_dir, spread, table
from folio.sources import files

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- SQL forms of the classifier ---------------------------------------------------------------------------------
def _count(p: str) -> str:
    return f"len(regexp_extract_all(text, {quoted_pattern(p)}))"


def quoted_pattern(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


DENSITIES = ", ".join(f"CASE WHEN length(text) > 0 THEN ({' + '.join(map(_count, P.PATTERNS[t]))}) / (length(text) / 1000) ELSE 0 END AS d_{t}" for t in P.PATTERNS)
FENCES = f"len(list_filter(regexp_extract_all(text, {quoted_pattern(P.FENCE)}, 1), lambda b: regexp_matches(b, {quoted_pattern('^(?s:.{8}.*?)(?:' + P.FENCE_TOKEN + ')')})))"
LABEL_LIST = "[" + ", ".join(f"CASE WHEN d_{t} >= {P.LABEL_DENSITY}{' OR fences >= 1' if t == 'software' else ''} THEN '{t}' END" for t in P.PATTERNS) + "]"
CLASSIFIED = f"""WITH {DOCS}, scored AS (SELECT *, {DENSITIES}, {FENCES} AS fences FROM docs), found AS (
  SELECT *, list_sort(list_filter({LABEL_LIST}, lambda x: x IS NOT NULL)) AS l FROM scored
), chunked AS (SELECT *, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') ELSE 'foundation' END AS labels2 FROM found), hand(title, labels1) AS (VALUES
  {", ".join(f"({quoted(t)}, {quoted(','.join(ls))})" for t, ls in P.LABELS)}
), labelled AS (
  SELECT c.*, labels1, coalesce(labels1, labels2) AS labels, CASE WHEN labels1 IS NULL THEN 2 ELSE 1 END AS tier
  FROM (SELECT *, regexp_replace(regexp_extract(source_path, '[^/]*$'), '\\.[^.]+$', '') AS title FROM chunked) c LEFT JOIN hand USING (title)
)"""
ROUTED = f"""{CLASSIFIED}, routed AS (
  SELECT *, CASE WHEN list_has_any(string_split(labels, ','), ['software', 'python']) OR fences >= 1 OR d_software >= 0.3 THEN 'software'
    WHEN list_has_any(string_split(labels, ','), ['math', 'discrete_math']) OR d_math >= 1.0 THEN 'math' ELSE 'selfhelp' END AS route FROM labelled
)"""
joined = lambda c: F.array_join(c, ",")


@query("route_counts", f"{ROUTED} SELECT route, count(*) AS n FROM routed GROUP BY route")
def route_counts(spark: SparkSession, sf: str) -> DataFrame:
    return classify.route(documents(spark, sf)).groupBy("route").agg(F.count("*").alias("n"))


@query("route_documents", f"{ROUTED} SELECT doc_id, route FROM routed")
def route_documents(spark, sf):
    return classify.route(documents(spark, sf)).select("doc_id", "route")


@query("route_signals", f"{CLASSIFIED} SELECT doc_id, round(d_math, 6) AS math, round(d_software, 6) AS software, round(d_python, 6) AS python, fences FROM labelled")
def route_signals(spark, sf):
    out = classify.with_fences(classify.with_densities(documents(spark, sf)))
    return out.select("doc_id", *(F.round(f"d_{t}", 6).alias(t) for t in ("math", "software", "python")), F.col("fences").cast("long").alias("fences"))


@query("density_scores", f"{CLASSIFIED} SELECT doc_id, " + ", ".join(f"round(d_{t}, 6) AS d_{t}" for t in P.PATTERNS) + " FROM labelled")
def density_scores(spark, sf):
    return classify.with_densities(documents(spark, sf)).select("doc_id", *(F.round(f"d_{t}", 6).alias(f"d_{t}") for t in P.PATTERNS))


@query("fence_count", f"{CLASSIFIED} SELECT doc_id, fences FROM labelled WHERE fences > 0")
def fence_count(spark, sf):
    return classify.with_fences(documents(spark, sf)).select("doc_id", F.col("fences").cast("long").alias("fences")).filter("fences > 0")


@query("classify_chunks", f"{CLASSIFIED} SELECT doc_id, labels2 AS labels FROM labelled")
def classify_chunks(spark, sf):
    return classify.classify_chunks(documents(spark, sf)).select("doc_id", joined("content_type").alias("labels"))


@query("classify_two_tier", f"{CLASSIFIED} SELECT doc_id, labels, tier FROM labelled")
def classify_two_tier(spark, sf):
    return classify.classify_two_tier(documents(spark, sf)).select("doc_id", joined("content_type").alias("labels"), "tier")


@query("label_lookup", f"{CLASSIFIED} SELECT doc_id, title, labels1 AS labels FROM labelled WHERE labels1 IS NOT NULL")
def label_lookup(spark, sf):
    docs = documents(spark, sf).select("doc_id", stem(F.col("source_path")).alias("title"))
    return docs.join(F.broadcast(classify.labels_table(spark)), "title").select("doc_id", "title", joined("content_type").alias("labels"))


@query("curated_labels", f"{CLASSIFIED} SELECT h.title, h.labels1 AS labels, count(l.doc_id) AS docs FROM hand h LEFT JOIN labelled l ON l.title = h.title GROUP BY h.title, h.labels1")
def curated_labels(spark, sf):
    """The label table, and how many documents have each of its titles."""
    held = documents(spark, sf).groupBy(stem(F.col("source_path")).alias("title")).agg(F.count("*").alias("docs"))
    return classify.labels_table(spark).join(held, "title", "left").select("title", joined("content_type").alias("labels"), F.coalesce("docs", F.lit(0)).alias("docs"))


@query("curated_split", f"{CLASSIFIED} SELECT doc_id, labels1 IS NOT NULL AS curated FROM labelled")
def curated_split(spark, sf):
    return documents(spark, sf).select("doc_id", classify.is_curated(F.col("source_path")).alias("curated"))


@query("tier_counts", f"{CLASSIFIED} SELECT tier, count(*) AS n FROM labelled GROUP BY tier")
def tier_counts(spark, sf):
    return classify.classify_two_tier(documents(spark, sf)).groupBy("tier").agg(F.count("*").alias("n"))


@query("label_set_top15", f"{CLASSIFIED} SELECT labels, count(*) AS n FROM labelled GROUP BY labels ORDER BY n DESC, labels LIMIT 15")
def label_set_top15(spark, sf):
    out = classify.classify_two_tier(documents(spark, sf)).groupBy(joined("content_type").alias("labels")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "labels").limit(15)


@query("label_examples", f"{CLASSIFIED} SELECT labels, min_by(replace(substr(text, 1, 120), chr(10), ' '), doc_id) AS example FROM labelled GROUP BY labels")
def label_examples(spark, sf):
    out = classify.classify_two_tier(documents(spark, sf)).select("doc_id", joined("content_type").alias("labels"), F.replace(F.substring("text", 1, 120), F.lit("\n"), F.lit(" ")).alias("p"))
    return out.groupBy("labels").agg(F.min_by("p", "doc_id").alias("example"))


_RULE_CASE = " ".join(f"WHEN contains(part, '{k}') THEN '{v}'" for k, v in P.PATH_RULES)


@query("path_classify", f"WITH {DOCS} SELECT doc_id, coalesce(list_filter(list_transform(string_split(lower(source_path), '/'), lambda part: CASE {_RULE_CASE} END), lambda x: x IS NOT NULL)[1], 'selfhelp') AS kind FROM docs")
def path_classify(spark, sf):
    return documents(spark, sf).select("doc_id", classify.path_type(F.col("source_path")).alias("kind"))


@query("doc_ids", f"WITH {DOCS} SELECT doc_id, 'book::' || md5(source_path) AS ref_doc_id FROM docs")
def doc_ids(spark, sf):
    return documents(spark, sf).select("doc_id", book_id(F.col("source_path")).alias("ref_doc_id"))


# --- filters and projections -------------------------------------------------------------------------------------
@query("usable_chunks", f"WITH {DOCS} SELECT doc_id FROM docs WHERE length(text) >= 200")
def usable_chunks(spark, sf):
    return documents(spark, sf).filter(F.length("text") >= 200).select("doc_id")


@query("contains_filter", f"WITH {DOCS} SELECT doc_id FROM docs WHERE contains(source, 'src1') OR contains(text, 'src1')")
def contains_filter(spark, sf):
    return inspect.about(documents(spark, sf), "src1").select("doc_id")


@query("preview", f"WITH {DOCS} SELECT doc_id, CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || ' …[truncated]' ELSE text END AS preview FROM docs")
def previews(spark, sf):
    return documents(spark, sf).select("doc_id", preview(F.col("text")).alias("preview"))


_S = "trim(text, ' ' || chr(9) || chr(10) || chr(13))"
FLAGS = f"""array_to_string(list_filter([
  CASE WHEN len(regexp_extract_all(text, '```')) % 2 <> 0 THEN 'UNBALANCED_CODE_FENCE' END,
  CASE WHEN len(regexp_extract_all(text, '(?m)^\\|.*\\|$')) > 0 AND len(list_filter(regexp_extract_all(text, '(?m)^\\|.*\\|$'), lambda r: regexp_full_match(r, '\\|[\\s\\-:|]+\\|'))) = 0 THEN 'TABLE_ROWS_NO_SEPARATOR' END,
  CASE WHEN substr(s, 1, 1) = lower(substr(s, 1, 1)) AND substr(s, 1, 1) <> upper(substr(s, 1, 1)) THEN 'STARTS_MID_SENTENCE' END,
  CASE WHEN length(s) > 0 AND NOT contains({quoted(P.SENTENCE_ENDS)}, substr(s, -1, 1)) THEN 'ENDS_MID_SENTENCE' END,
  CASE WHEN length(s) > 0 AND length(s) < 40 THEN 'VERY_SHORT_CHUNK' END,
  CASE WHEN ({" OR ".join(f"contains(text, {quoted(c)})" for c in P.CODE_SIGNS)}) AND NOT contains(text, '```') AND NOT contains(text, '[CODE]') THEN 'POSSIBLE_UNTAGGED_CODE' END
], lambda x: x IS NOT NULL), ',')"""


@query("flag_issues", f"WITH {DOCS} SELECT doc_id, {FLAGS} AS flags FROM (SELECT *, {_S} AS s FROM docs)")
def flag_issues(spark, sf):
    return spread(documents(spark, sf)).select("doc_id", joined(inspect.flag_issues(F.col("text"))).alias("flags"))


@query("metadata_missing", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'content_type,has_code,source' WHEN doc_id % 3 = 1 THEN 'content_type,has_code' ELSE '' END AS missing FROM documents")
def metadata_missing(spark, sf):
    docs = table(spark, sf, "documents")
    full = F.create_map(F.lit("content_type"), F.col("lang"), F.lit("has_code"), F.lit("false"), F.lit("source"), F.col("source"))
    meta = F.when(F.col("doc_id") % 3 == 1, F.create_map(F.lit("source"), F.col("source"))).when(F.col("doc_id") % 3 == 2, full)
    return docs.select("doc_id", joined(inspect.missing_fields(meta)).alias("missing"))


@query("math_lines", f"WITH {DOCS} SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ' || chr(9))) > 20), chr(10)) AS prose FROM docs")
def math_lines(spark, sf):
    from folio.functions.text import lines

    return documents(spark, sf).select("doc_id", F.array_join(F.filter(lines(F.col("text")), lambda x: F.length(ustrip(x)) > 20), "\n").alias("prose"))


@query("strip_formulas", f"WITH {DOCS} SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(text, {quoted_pattern(P.FORMULA)}, ' ', 'g'), chr(10)), lambda x: length(trim(x, ' ' || chr(9))) > 20), chr(10)) AS prose FROM docs")
def strip_formulas(spark, sf):
    return documents(spark, sf).select("doc_id", chunking.without_formulas(F.col("text")).alias("prose"))


@query("inspect_sample", f"WITH {DOCS} SELECT doc_id, source FROM docs WHERE contains(source, 'src1') ORDER BY doc_id LIMIT 20")
def inspect_sample(spark, sf):
    return documents(spark, sf).filter(F.col("source").contains("src1")).select("doc_id", "source").orderBy("doc_id").limit(20)


@query("count_all", "SELECT count(*) AS n FROM documents")
def count_all(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("n"))


# --- chunks and nodes --------------------------------------------------------------------------------------------
@query("chunk_fixed", "SELECT doc_id, i AS chunk_idx, substr(text, i * 1500 + 1, 1500) AS text FROM (SELECT *, unnest(range(greatest(1, ceil(length(text) / 1500)::INT)))::INT AS i FROM documents)")
def chunk_fixed(spark, sf):
    return chunking.chunk_fixed(table(spark, sf, "documents").select("doc_id", "text"))


@query("chunk_paragraph", f"WITH {DOCS}, p AS (SELECT doc_id, regexp_split_to_array(text, '\\n[ \\t]*\\n') AS l FROM docs), u AS (SELECT doc_id, unnest(range(len(l)))::INT AS chunk_idx, unnest(l) AS t FROM p) SELECT doc_id, chunk_idx, trim(t, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM u WHERE trim(t, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def chunk_paragraph(spark, sf):
    return chunking.chunk_paragraph(documents(spark, sf).select("doc_id", "text"))


@query("chunk_prose")
def chunk_prose(spark, sf):
    return chunking.chunk_prose(documents(spark, sf).select("doc_id", "text"))


@query("chunk_semantic")
def chunk_semantic(spark, sf):
    return chunking.chunk_prose(table(spark, sf, "documents").select("doc_id", "text"), None, 500)


@query("chunk_software")
def chunk_software(spark, sf):
    return chunking.chunk_software(documents(spark, sf).select("doc_id", "text"))


@query("chunk_math")
def chunk_math(spark, sf):
    return chunking.chunk_math(documents(spark, sf).select("doc_id", "text"))


@query("chunk_all")
def chunk_all(spark, sf):
    return chunking.chunk_routed(classify.route(documents(spark, sf))).drop("source")


def _given_chunks(spark, sf):
    docs = documents(spark, sf)
    code = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("a = 1"), F.lit("  "), F.lit("b = 2"))).otherwise(F.array().cast("array<string>"))
    return docs.select("source_path", (F.col("doc_id") % 1_000_000_000 + F.floor(F.col("doc_id") / 1_000_000_000)).cast("int").alias("chunk_idx"), "text", code.alias("code_blocks"), F.lit(False).alias("has_code"))


_NODES = f"""{CLASSIFIED}, given AS (
  SELECT *, (doc_id % 1000000000 + doc_id // 1000000000)::INT AS chunk_idx, labels1 IS NOT NULL AS curated, md5(source_path || '|' || (doc_id % 1000000000 + doc_id // 1000000000)) AS nid FROM labelled
), all_nodes AS (
  SELECT nid AS node_id, NULL AS parent_id, 'prose' AS kind, text, labels, doc_id % 7 = 0 AS has_code, source_path, CASE WHEN curated THEN 'curated' ELSE 'embed' END AS tier FROM given
  UNION ALL
  SELECT md5(source_path || '|' || chunk_idx || '|' || i), nid, 'code', c, 'code', true, source_path, CASE WHEN curated THEN 'curated' ELSE 'embed' END
  FROM given, (VALUES (0, 'a = 1'), (2, 'b = 2')) AS code(i, c) WHERE doc_id % 7 = 0
)"""


@query("build_nodes", f"{_NODES} SELECT node_id, coalesce(parent_id, '') AS parent_id, kind, text, labels, has_code, 'book::' || md5(source_path) AS ref_doc_id, tier FROM all_nodes")
def build_nodes(spark, sf):
    out = nodes.build_nodes(_given_chunks(spark, sf))
    return out.select("node_id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "kind", "text", joined("content_type").alias("labels"), "has_code", "ref_doc_id", "tier")


@query("code_with_parent", f"{_NODES} SELECT c.node_id, p.text AS parent_text FROM all_nodes c JOIN all_nodes p ON c.parent_id = p.node_id")
def code_with_parent(spark, sf):
    out = nodes.build_nodes(_given_chunks(spark, sf))
    parents = out.filter("kind = 'prose'").select(F.col("node_id").alias("parent_id"), F.col("text").alias("parent_text"))
    return out.filter("kind = 'code'").join(parents, "parent_id").select("node_id", "parent_text")


@query("tier_summary", f"{_NODES} SELECT tier, count(*) AS nodes, count(DISTINCT source_path) AS books FROM all_nodes GROUP BY tier")
def tier_summary(spark, sf):
    return nodes.tier_summary(nodes.build_nodes(_given_chunks(spark, sf)))


@query("insert_counts", f"{_NODES} SELECT kind, tier, count(*) AS n FROM all_nodes GROUP BY kind, tier")
def insert_counts(spark, sf):
    path = f"{shared_dir(spark)}/folio-nodes-{uuid.uuid4().hex}"
    nodes.write_nodes(nodes.build_nodes(_given_chunks(spark, sf)), path)
    return spark.read.parquet(path).groupBy("kind", "tier").agg(F.count("*").alias("n"))


@query("checkpoint_roundtrip", "SELECT doc_id, i AS chunk_idx, substr(text, i * 1500 + 1, 1500) AS text FROM (SELECT *, unnest(range(greatest(1, ceil(length(text) / 1500)::INT)))::INT AS i FROM documents)")
def checkpoint_roundtrip(spark, sf):
    path = f"{shared_dir(spark)}/folio-chunks-{uuid.uuid4().hex}"
    build = lambda: chunk_fixed(spark, sf)
    files.checkpoint_or(spark, path, build)  # there is none yet: it is built and written
    return files.read_checkpoint(spark, path, "doc_id long, chunk_idx int, text string")


@query("html_text")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", files.html_text("html").alias("text"))


@query("html_strip_tags", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM pages")
def html_strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", files.strip_tags(F.col("html")).alias("text"))


# --- deduplication -----------------------------------------------------------------------------------------------
@query("exact_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def exact_dedup(spark, sf):
    return dedup.exact_dedup(table(spark, sf, "documents")).select("doc_id")


@query("shingle_counts", "SELECT doc_id, CASE WHEN length(text) >= 5 THEN len(list_distinct(list_transform(range(1, length(text) - 3), lambda i: substr(lower(text), i, 5)))) ELSE 0 END AS n FROM documents")
def shingle_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(dedup.shingles(F.col("text"))).cast("long").alias("n"))


_PAIRS = """sets AS (
  SELECT id, CASE WHEN length(text) >= 5 THEN list_distinct(list_transform(range(1, length(text) - 3), lambda i: hash(substr(lower(text), i, 5)))) ELSE [] END AS s
  FROM (SELECT min(doc_id) AS id, min_by(text, doc_id) AS text FROM documents GROUP BY lower(text))
), near AS (
  SELECT a.id AS x, b.id AS y, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS n
  FROM sets a JOIN sets b ON a.id < b.id AND len(a.s) >= 0.85 * len(b.s) AND len(b.s) >= 0.85 * len(a.s) AND len(a.s) > 0
), pairs AS (
  SELECT x AS id_a, y AS id_b, i / (n - i) AS jaccard FROM near WHERE i >= 0.85 * (n - i)
)"""
# a walk in order of ids over those that have a similar one before them; all others stay
_KEPT = f"""{_PAIRS}, asked AS (SELECT id_b AS id, list(id_a) AS before FROM pairs GROUP BY id_b), gone AS (
  SELECT unnest(list_reduce(list(struct_pack(id := id, before := before) ORDER BY id), lambda acc, x: CASE WHEN len(list_filter(x.before, lambda b: NOT list_contains(acc, b))) > 0 THEN list_append(acc, x.id) ELSE acc END, []::BIGINT[])) AS id FROM asked
), kept AS (SELECT id FROM sets WHERE id NOT IN (SELECT id FROM gone))"""


def _pairs(spark, sf):
    return dedup.near_dup_pairs(table(spark, sf, "documents"))


@query("near_dup_pairs", f"WITH {_PAIRS} SELECT id_a, id_b, round(jaccard, 6) AS jaccard FROM pairs")
def near_dup_pairs(spark, sf):
    return _pairs(spark, sf).select("id_a", "id_b", F.round("jaccard", 6).alias("jaccard"))


@query("text_classes", "SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY lower(text)) AS class_id FROM documents")
def text_classes(spark, sf):
    return dedup.text_classes(table(spark, sf, "documents"))


@query("dedup_greedy", f"WITH {_KEPT} SELECT id FROM kept")
def dedup_greedy(spark, sf):
    return dedup.greedy(table(spark, sf, "documents"))


@query("dedup_stats", f"WITH {_KEPT} SELECT (SELECT count(*) FROM documents) AS n_in, count(*) AS n_kept, (SELECT count(*) FROM documents) - count(*) AS n_removed FROM kept")
def dedup_stats(spark, sf):
    docs = table(spark, sf, "documents")
    return dedup.dedup_stats(docs.select(F.col("doc_id").alias("id")), dedup.greedy(docs))


@query("minhash_signatures")
def minhash_signatures(spark, sf):
    return dedup.minhash(table(spark, sf, "documents"))


@query("lsh_candidates")
def lsh_candidates(spark, sf):
    docs = table(spark, sf, "documents")
    return dedup.lsh_candidates(dedup.minhash(docs), dedup.text_classes(docs))
