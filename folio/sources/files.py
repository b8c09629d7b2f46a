"""File sources and sinks: discovery, extraction, notes, checkpoints, NDJSON."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folio.operators.classify import suffix_kind
from folio.session import by_slices

CHUNKS = "chunk_id string, ref_doc_id string, source_path string, chunk_idx int, route string, text string, code_blocks array<string>, has_code boolean"


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all PDF and EPUB files below a folder, suffixes in any case, sorted; their contents are not read."""
    return _binary(spark, folder).select("path", "length").orderBy("path")


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the same files, in no order."""
    return _binary(spark, folder).select("path", "content")


def _binary(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{[pP][dD][fF],[eE][pP][uU][bB]}").load(folder)


#: What extractors have loaded in this worker, by name: a worker serves many tasks, and a model is as costly as many files.
_LOADED: dict[str, object] = {}


def loaded(name: str, load: Callable[[], object]) -> object:
    """What ``load`` gives, loaded once in each worker process."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def extract(files: DataFrame, extractors: dict[str, Callable], models: dict[str, Callable[[], object]] | None = None) -> DataFrame:
    """(path, content) -> (path, text, error): each file by the extractor of its kind; one that fails or has none gives an empty text and says why.

    An extractor takes a file's bytes and, if ``models`` has a loader for its kind, what that has loaded: once a worker, at the first file that needs it.
    """
    loaders = models or {}

    def run(batches):
        from folio.sources.files import loaded  # the worker's own module, which outlives the task

        for pdf in batches:
            rows = []
            for path, content, kind in zip(pdf["path"], pdf["content"], pdf["kind"], strict=True):
                try:
                    more = (loaded(f"{kind}:{getattr(loaders[kind], '__qualname__', '')}", loaders[kind]),) if kind in loaders else ()
                    rows.append((path, extractors[kind](content, *more), None))
                except Exception as e:  # a broken file is a row with an error
                    rows.append((path, "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content", suffix_kind(F.col("path")).alias("kind")).mapInPandas(run, "path string, text string, error string")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style") and self.silent > 0

    def handle_data(self, data):
        if not self.silent and data.strip():
            self.parts.append(data.strip())


def page_text(html: str | None) -> str:
    p = _Text()
    p.feed(html or "")
    p.close()
    return "\n".join(p.parts)


#: Text nodes of a page, stripped, one a line.
html_text = by_slices(page_text, StringType())  # a type object: a name can be read only by a session


#: Names in an EPUB container and kinds of documents in its manifest.
_CONTAINER, _OPF = "{urn:oasis:names:tc:opendocument:xmlns:container}", "{http://www.idpf.org/2007/opf}"
_PAGES = ("application/xhtml+xml", "text/html", "application/x-dtbook+xml")


def chapters_of(content: bytes) -> list[str]:
    """Texts of an EPUB's documents: those of its spine in their order, then what the manifest has besides. A document that is named but missing is blank.

    The container names the package file, whose folder its links start from; they may be percent-encoded. No package file is an error.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        package = next(r.attrib["full-path"] for r in container.iter(f"{_CONTAINER}rootfile"))
        root, names = ElementTree.fromstring(book.read(package)), set(book.namelist())
        items = {i.attrib["id"]: i.attrib for i in root.iter(f"{_OPF}item") if i.attrib.get("media-type") in _PAGES}
        spine = [r.attrib.get("idref") for r in root.iter(f"{_OPF}itemref")]
        order = list(dict.fromkeys([i for i in spine if i in items] + list(items)))
        texts = []
        for i in order:
            name = posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(items[i]["href"].split("#")[0])))
            texts.append(page_text(book.read(name).decode("utf-8-sig", "replace")) if name in names else "")
        return texts


def epub_text(content: bytes) -> str:
    """The extractor of EPUB files: chapters that are not blank, with a blank line between."""
    return "\n\n".join(t for t in chapters_of(content) if t.strip())


def epub_chapters(files: DataFrame) -> DataFrame:
    """(path, content) -> (path, ord, text): a row for each document of each EPUB, in reading order; a book that can't be read has one row, of null text."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, i, t) for i, t in enumerate(chapters_of(content))]
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError, TypeError):
                    rows.append((path, 0, None))
            yield pd.DataFrame(rows, columns=["path", "ord", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, ord int, text string")


def join_chapters(chapters: DataFrame) -> DataFrame:
    """(path, ord, text) -> a text per book: chapters that are not blank, in order, with a blank line between."""
    kept = chapters.filter(F.trim("text") != "")
    return kept.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def strip_tags(html):
    """Plain text by pattern: scripts, styles and comments go, tags become blanks, runs of white space one."""
    bare = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"[ \t\r\n]+", " "))


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of all Markdown files below a folder."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def write_checkpoint(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(path)


def read_checkpoint(spark: SparkSession, path: str, schema: str = CHUNKS) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def checkpoint_or(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The checkpoint's chunks; where there is none, they are built and written first."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        write_checkpoint(build(), path)
    return read_checkpoint(spark, path)


def write_report(report: DataFrame, path: str) -> None:
    """A summary table as lines of JSON; null fields are left out."""
    report.write.mode("overwrite").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two tables of JSON lines in one folder."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def read_graph(spark: SparkSession, path: str, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """An exported graph, with the schemas it was written with."""
    return spark.read.schema(nodes).json(f"{path}/nodes"), spark.read.schema(edges).json(f"{path}/edges")


def read_json_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """A checkpoint that is one JSON array of chunks."""
    schema = "text string, source_path string, content_type string, metadata struct<has_code: boolean>, code_blocks array<string>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def ndjson(model: str, content, done):
    """One line of a chat stream."""
    return F.to_json(F.struct(F.lit(model).alias("model"), F.struct(F.lit("assistant").alias("role"), content.alias("content")).alias("message"), done.alias("done")))
