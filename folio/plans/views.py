"""Views over the test tables on which the queries run, each in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import patterns as P
from folio.session import table

#: Snippets by doc_id mod 7 that make the classifier's and chunkers' cases occur.
SNIPPETS = [
    "\n```python\ndef add(a, b):\n    return a + b\n```\n",
    "\n    total = total + 1\n\tcount = 0;\n",
    "\n$$x^2 + y^2 = z^2$$\n\\begin{align}a\\end{align}\n",
    "\nThe theorem and the lemma. Proof is clear QED.\n| a | b |\n",
    "\nSELECT name FROM users JOIN orders;\n",
    "\nA neural network needs a loss function and numpy.array.\n",
    "",
]


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'" if "\n" not in s and "\t" not in s else "E'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"


def _paths():
    titles = [t for t, _ in P.LABELS]
    book = F.when(F.col("doc_id") % 50 < len(titles), F.concat(F.lit("books/"), F.element_at(F.array(*map(F.lit, titles)), (F.col("doc_id") % 50 + 1).cast("int")), F.lit(".pdf")))
    return F.coalesce(book, F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")))


PATH_SQL = "CASE WHEN doc_id % 50 < {n} THEN 'books/' || list_extract([{t}], (doc_id % 50 + 1)::INT) || '.pdf' ELSE source || '/' || doc_id || '.pdf' END".format(n=len(P.LABELS), t=", ".join(quoted(t) for t, _ in P.LABELS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with paths, and each document's snippet appended; the snippets alone are documents too."""
    docs = table(spark, sf_dir, "documents")
    snippet = F.element_at(F.array(*map(F.lit, SNIPPETS)), (F.col("doc_id") % 7 + 1).cast("int"))
    long_ = docs.select("doc_id", F.concat("text", snippet).alias("text"), "source", _paths().alias("source_path"))
    alone = docs.select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), snippet.alias("text"), "source", F.concat(F.lit("dev/math/"), F.col("doc_id").cast("string"), F.lit(".PDF")).alias("source_path"))
    return long_.unionByName(alone)


DOCS = f"""docs AS (
  SELECT doc_id, text || list_extract([{", ".join(map(quoted, SNIPPETS))}], (doc_id % 7 + 1)::INT) AS text, source, {PATH_SQL} AS source_path FROM documents
  UNION ALL
  SELECT doc_id + 1000000000, list_extract([{", ".join(map(quoted, SNIPPETS))}], (doc_id % 7 + 1)::INT), source, 'dev/math/' || doc_id || '.PDF' FROM documents
)"""


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")]
    out = None
    for kind, key, name in parts:
        rows = table(spark, sf_dir, kind).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.col(name).alias("entity_name"), F.lit(kind).alias("entity_type"))
        out = rows if out is None else out.unionByName(rows)
    return out


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def edges(rows, a, ka, b, kb, label, weight=None):
        src, tgt = F.concat(F.lit(f"{a}:"), F.col(ka).cast("string")), F.concat(F.lit(f"{b}:"), F.col(kb).cast("string"))
        return rows.select(F.concat(src, F.lit("___"), tgt).alias("rel_id"), src.alias("src_id"), tgt.alias("tgt_id"), F.lit(label).alias("label"), (F.lit(1.0) if weight is None else weight).alias("weight"), F.lit(f"{a} {b}").alias("keywords"))

    supplied = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("w"))
    loop = spark.range(1).select(F.lit("region:0___region:0").alias("rel_id"), F.lit("region:0").alias("src_id"), F.lit("region:0").alias("tgt_id"), F.lit("SELF").alias("label"), F.lit(1.0).alias("weight"), F.lit("region region").alias("keywords"))
    return (
        edges(table(spark, sf_dir, "customer"), "customer", "c_custkey", "nation", "c_nationkey", "IN_NATION")
        .unionByName(edges(table(spark, sf_dir, "supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "IN_NATION"))
        .unionByName(edges(table(spark, sf_dir, "nation"), "nation", "n_nationkey", "region", "n_regionkey", "IN_REGION"))
        .unionByName(edges(supplied, "part", "l_partkey", "supplier", "l_suppkey", "SUPPLIED_BY", F.col("w")))
        .unionByName(loop)
    )


GRAPH = """nodes AS (
  SELECT 'customer:' || c_custkey AS id, c_name AS entity_name, 'customer' AS entity_type FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'part' FROM part
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation' FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, r_name, 'region' FROM region
), ends_ AS (
  SELECT 'customer:' || c_custkey AS src_id, 'nation:' || c_nationkey AS tgt_id, 'IN_NATION' AS label, 1.0::DOUBLE AS weight, 'customer nation' AS keywords FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'IN_NATION', 1.0, 'supplier nation' FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'IN_REGION', 1.0, 'nation region' FROM nation
  UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'SUPPLIED_BY', sum(l_quantity), 'part supplier' FROM lineitem GROUP BY l_partkey, l_suppkey
  UNION ALL SELECT 'region:0', 'region:0', 'SELF', 1.0, 'region region'
), edges AS (SELECT src_id || '___' || tgt_id AS rel_id, * FROM ends_), degree AS (
  SELECT id, count(*) AS degree FROM (SELECT src_id AS id FROM edges UNION ALL SELECT tgt_id FROM edges WHERE src_id <> tgt_id) GROUP BY id
)"""

def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note of each document, of four forms: tags in a line, no front matter, a template, tags in a list."""
    docs = table(spark, sf_dir, "documents")
    kind, key = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    join = lambda *parts: F.concat(*(F.lit(x) if i % 2 == 0 else x for i, x in enumerate(parts)))
    source, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    content = (
        F.when(kind == 0, join("---\ntags: [", lang, ", ", source, "]\n---\n# Concept ", key, "\nSee [[", source, "]] and [[ ", lang, " ]].\nø\n"))
        .when(kind == 1, join("# Concept ", key, "\nLinks [[", source, "]] twice [[", source, "]].\n"))
        .when(kind == 2, F.lit("# ${FOAM_TITLE_SAFE}\n[[nowhere]]\n"))
        .otherwise(join("---\ntags:\n  - ", lang, "\n  - two\n---\n# Concept ", key, "\nno links\n"))
    )
    return docs.select(F.concat(F.lit("notes/"), key, F.lit(".md")).alias("path"), content.alias("content"))


NOTES = """notes AS (SELECT 'notes/' || doc_id || '.md' AS path, CASE doc_id % 4
  WHEN 0 THEN E'---\\ntags: [' || coalesce(lang, '') || ', ' || coalesce(source, '') || E']\\n---\\n# Concept ' || doc_id || E'\\nSee [[' || coalesce(source, '') || ']] and [[ ' || coalesce(lang, '') || E' ]].\\nø\\n'
  WHEN 1 THEN '# Concept ' || doc_id || E'\\nLinks [[' || coalesce(source, '') || ']] twice [[' || coalesce(source, '') || E']].\\n'
  WHEN 2 THEN E'# ${FOAM_TITLE_SAFE}\\n[[nowhere]]\\n'
  ELSE E'---\\ntags:\\n  - ' || coalesce(lang, '') || E'\\n  - two\\n---\\n# Concept ' || doc_id || E'\\nno links\\n' END AS content FROM documents)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's reply for each document, of four forms: entities and a relation, one entity with words around, no JSON, nulls."""
    docs = table(spark, sf_dir, "documents")
    source, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    kind = F.col("doc_id") % 4
    full = F.concat(F.lit('{"entities":[{"name":"'), source, F.lit('","type":"Technology"},{"name":"'), lang, F.lit('","type":"Pet"}],"relations":[{"source":"'), source, F.lit('","target":"'), lang, F.lit('","type":"USES"}]}'))
    one = F.concat(F.lit('Sure: {"entities":[{"name":"'), lang, F.lit('","type":"Concept"}],"relations":[]} done'))
    reply = F.when(kind == 0, full).when(kind == 1, one).when(kind == 2, F.lit("no json at all")).otherwise(F.lit('{"entities":null,"relations":null}'))
    return docs.select(F.col("doc_id").alias("id"), reply.alias("reply"))


REPLIES = """replies AS (SELECT doc_id AS id, CASE doc_id % 4
  WHEN 0 THEN '{"entities":[{"name":"' || coalesce(source, '') || '","type":"Technology"},{"name":"' || coalesce(lang, '') || '","type":"Pet"}],"relations":[{"source":"' || coalesce(source, '') || '","target":"' || coalesce(lang, '') || '","type":"USES"}]}'
  WHEN 1 THEN 'Sure: {"entities":[{"name":"' || coalesce(lang, '') || '","type":"Concept"}],"relations":[]} done'
  WHEN 2 THEN 'no json at all' ELSE '{"entities":null,"relations":null}' END AS reply FROM documents), parsed_replies AS (
  SELECT id, coalesce(from_json(nullif(regexp_extract(reply, '(?s)\\{.*\\}'), ''), '{"entities":[{"name":"VARCHAR","type":"VARCHAR"}],"relations":[{"source":"VARCHAR","target":"VARCHAR","type":"VARCHAR"}]}'), {'entities': [], 'relations': []}) AS r FROM replies
)"""
