"""EPUB containers, loaded models, and texts of pages and chunks against independent loops."""

from __future__ import annotations

import html
import io
import re
import zipfile

from folio.plans import catalog
from folio.session import table
from folio.sources import files
from tests.comparing import TABLES

SF = f"{TABLES}/sf0.001"


def book(documents, spine, package="OEBPS/content.opf", extra=""):
    """An EPUB with documents {id: (href, html or None)}; None: named but missing."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", f'<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="{package}"/></rootfiles></container>')
        items = "".join(f'<item id="{i}" href="{h}" media-type="application/xhtml+xml"/>' for i, (h, _) in documents.items())
        refs = "".join(f'<itemref idref="{i}"/>' for i in spine)
        z.writestr(package, f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}<item id="css" href="s.css" media-type="text/css"/>{extra}</manifest><spine>{refs}</spine></package>')
        folder = package.rpartition("/")[0]
        for h, text in documents.values():
            if text is not None:
                z.writestr((f"{folder}/" if folder else "") + h.replace("%20", " "), text)
    return out.getvalue()


def test_epubs_are_read_in_spine_order(spark, tmp_path):
    page = lambda t: f"<html><head><style>x{{}}</style></head><body><p>{t}</p><p>&eacute; <b>two</b></p></body></html>"
    first = book({"b": ("b.xhtml", page("second")), "a": ("text/a%20one.xhtml", page("first")), "nav": ("nav.xhtml", page("contents")), "blank": ("blank.xhtml", "<p> </p>"), "gone": ("gone.xhtml", None)}, ["a", "b", "blank", "gone", "unknown"])
    (tmp_path / "one.epub").write_bytes(first)
    (tmp_path / "two.EPUB").write_bytes(book({"x": ("x.html", page("root"))}, ["x", "x"], package="p.opf"))
    (tmp_path / "broken.epub").write_bytes(b"no zip at all")
    (tmp_path / "empty.epub").write_bytes(first[:40])
    found = files.contents(spark, str(tmp_path))
    rows = files.epub_chapters(found).collect()
    name = lambda p: p.rsplit("/", 1)[1]
    assert {(name(r.path), r.ord, (r.text or "").split("\n")[0]) for r in rows} == {("one.epub", 0, "first"), ("one.epub", 1, "second"), ("one.epub", 2, ""), ("one.epub", 3, ""), ("one.epub", 4, "contents"), ("two.EPUB", 0, "root"), ("broken.epub", 0, ""), ("empty.epub", 0, "")}
    joined = {name(r.path): r.text for r in files.join_chapters(files.epub_chapters(found)).collect()}
    assert joined == {"one.epub": "first\né\ntwo\n\nsecond\né\ntwo\n\ncontents\né\ntwo", "two.EPUB": "root\né\ntwo"}
    texts = {name(r.path): (r.text, r.error) for r in files.extract(found, {"epub": files.epub_text}).collect()}
    assert texts["one.epub"] == (joined["one.epub"], None) and texts["broken.epub"][0] == "" and "BadZipFile" in texts["broken.epub"][1]


def test_models_are_loaded_once_a_worker(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.pdf").write_bytes(b"%d" % i)
    log = tmp_path / "loads"

    def load():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return "model"

    def read(content, model):
        return f"{model}:{content.decode()}"

    found = files.contents(spark, str(tmp_path)).repartition(6)
    for _ in range(2):
        out = files.extract(found, {"pdf": read}, {"pdf": load}).collect()
        assert sorted(r.text for r in out) == [f"model:{i}" for i in range(6)]
    loads = log.read_text().split()
    assert len(loads) == len(set(loads))


def test_page_texts_by_pattern(spark):
    """The pages' texts again, by cutting at tags."""
    pages = table(spark, SF, "pages").select("page_id", "html").collect()
    got = {r.page_id: r.text for r in catalog.QUERIES["html_text"](spark, SF).collect()}
    for r in pages:
        bare = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style)\b.*?</\1\s*>", "\0", r.html)
        parts = [html.unescape(p).strip() for p in re.split(r"<[^>]*>|\0", bare)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_chunks_hold_all_text_within_the_limit(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    held: dict = {}
    for r in catalog.QUERIES["chunk_semantic"](spark, SF).orderBy("doc_id", "chunk_idx").collect():
        held.setdefault(r.doc_id, []).append(r.text)
    squeeze = lambda t: re.sub(r"\s+", "", t)
    for i, text in docs.items():
        chunks = held.get(i, [])
        assert squeeze("".join(chunks)) == squeeze(text or "") and all(0 < len(c) <= 500 for c in chunks)
