"""EPUB packages: a deterministic writer and a reader of package, spine, navigation and elements."""

from __future__ import annotations

import io
import re
import zipfile
from html import escape
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.html import events

WHEN = (1980, 1, 1, 0, 0, 0)
XML = "application/xhtml+xml"
OASIS = "urn:oasis:names:tc:opendocument:xmlns:container"
XHTML, DC = "http://www.w3.org/1999/xhtml", "http://purl.org/dc/elements/1.1/"
OPF, EPUB = (f"http://www.idpf.org/2007/{x}" for x in ("opf", "ops"))


def tag(name: str, body: str | None = None, **attrs: str) -> str:
    """An element from its name, content and attributes (``__`` stands for a colon, ``_`` for a hyphen, ``class_`` for class)."""
    pairs = "".join(f' {k.rstrip("_").replace("__", ":").replace("_", "-")}="{escape(v)}"' for k, v in attrs.items())
    return f"<{name}{pairs}/>" if body is None else f"<{name}{pairs}>{body}</{name}>"


def document(body: str) -> str:
    return "<?xml version='1.0' encoding='utf-8'?>\n" + body


def page(lang: str, title: str, body: str) -> str:
    return document(tag("html", tag("head", tag("title", escape(title))) + tag("body", body), xmlns=XHTML, xmlns__epub=EPUB, lang=lang))


def package(identifier: str, title: str, lang: str, chapters: list[tuple[str, list[str]]]) -> bytes:
    """A zip with the media type first and stored, then all parts in order of name, with one fixed time."""
    root = "OEBPS/content.opf"
    parts = {"META-INF/container.xml": document(tag("container", tag("rootfiles", tag("rootfile", full_path=root, media_type="application/oebps-package+xml")), version="1.0", xmlns=OASIS))}
    items, spine, nav = [], [], []
    for k, (head, paras) in enumerate(chapters, 1):
        key = f"c{k:04d}"
        name = f"{key}.xhtml"
        parts[f"OEBPS/{name}"] = page(lang, head, tag("h1", escape(head)) + "".join(tag("p", escape(p)) for p in paras))
        items.append(tag("item", id=key, href=name, media_type=XML))
        spine.append(tag("itemref", idref=key))
        nav.append(tag("li", tag("a", escape(head), href=name)))
    parts["OEBPS/nav.xhtml"] = page(lang, "Contents", tag("nav", tag("ol", "".join(nav)), epub__type="toc"))
    items.append(tag("item", id="nav", href="nav.xhtml", media_type=XML, properties="nav"))
    about = tag("dc:identifier", escape(identifier), id="id") + tag("dc:title", escape(title)) + tag("dc:language", lang)
    parts[root] = document(tag("package", tag("metadata", about, xmlns__dc=DC) + tag("manifest", "".join(items)) + tag("spine", "".join(spine)), xmlns=OPF, version="3.0", unique_identifier="id"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype", WHEN), "application/epub+zip", zipfile.ZIP_STORED)
        for name in sorted(parts):
            z.writestr(zipfile.ZipInfo(name, WHEN), parts[name], zipfile.ZIP_DEFLATED)
    return out.getvalue()


def parse(content: bytes) -> list[tuple[str, int, str, bool]]:
    """(href, position in the spine or -1, text of the part, whether it is the navigation) of all manifest items."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = next(ElementTree.fromstring(z.read("META-INF/container.xml")).iter(f"{{{OASIS}}}rootfile")).get("full-path")
        opf, base = ElementTree.fromstring(z.read(root)), root.rpartition("/")[0]
        ns = {"o": OPF}
        order = {r.get("idref"): k for k, r in enumerate(opf.iterfind(".//o:itemref", ns))}
        names = set(z.namelist())
        out = []
        for i in opf.iterfind(".//o:item", ns):
            path = f"{base}/{i.get('href')}" if base else i.get("href")
            text = z.read(path).decode("utf-8", "replace") if path in names and "xml" in i.get("media-type", "") else ""
            out.append((i.get("href"), order.get(i.get("id"), -1), text, "nav" in (i.get("properties") or "").split()))
        return out


def write_packages(paras: DataFrame) -> DataFrame:
    """doc_id and content (a package) of every document of (doc_id, lang, para, text); ten paragraphs are a chapter."""
    return packed(paras.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("para", "text"))).alias("r")))


def packed(rows: DataFrame) -> DataFrame:
    """The same of documents in a row each: doc_id, lang and the paragraphs in order (r)."""

    @F.arrow_udf("binary")
    def build(doc_id: pa.Array, lang: pa.Array, rows: pa.Array) -> pa.Array:
        out = []
        for d, language, r in zip(doc_id.to_pylist(), lang.to_pylist(), rows):
            texts = r.values.field("text").to_pylist() if r.is_valid else []
            out.append(package(f"urn:doc:{d}", f"Document {d}", language or "und", [(f"Part {k // 10 + 1}", texts[k : k + 10]) for k in range(0, len(texts), 10)]))
        return pa.array(out, pa.binary())

    return rows.select("doc_id", build("doc_id", "lang", "r").alias("content"))


PLAIN = re.compile(r"\r|<!|.<\?|</?\w+:|<(?:script|style|template|textarea)\b", re.I | re.S)


def blocks(text: str) -> tuple[str | None, int, str]:
    """The first heading's text, the number of paragraphs, and their text, a line each.

    Well-formed parts whose headings and paragraphs have no elements within go through the XML parser, which is faster; others are read as a browser would.
    """
    try:
        found = [] if PLAIN.search(text) else [(e.tag.rpartition("}")[2].lower(), e) for e in ElementTree.fromstring(text).iter()]
    except ElementTree.ParseError:
        found = []
    own = [(tag, (e.text or "").strip()) for tag, e in found if tag in ("h1", "p")]
    if found and not any(len(e) for tag, e in found if tag in ("h1", "p")):
        return next((t for tag, t in own if tag == "h1" and t), None), sum(tag == "p" for tag, _ in own), "\n".join(t for tag, t in own if tag == "p" and t)
    e = events(text)
    return next((x[4] for x in e if x[0] == "text" and x[1] == "h1"), None), sum(x[0] == "start" and x[1] == "p" for x in e), "\n".join(x[4] for x in e if x[0] == "text" and x[1] == "p")


SPINE = "doc_id bigint, href string, pos int, is_nav boolean, title string, n_blocks int, text string"


def read_packages(files: DataFrame) -> DataFrame:
    """Items of packages (doc_id, content): href, place in the spine, title, number and text of paragraphs."""

    def run(batches):
        kinds = pa.schema([("doc_id", pa.int64()), ("href", pa.string()), ("pos", pa.int32()), ("is_nav", pa.bool_()), ("title", pa.string()), ("n_blocks", pa.int32()), ("text", pa.string())])
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content")):
                for href, pos, text, nav in parse(content.as_py()):
                    title, n, body = blocks(text)
                    rows.append({"doc_id": doc_id, "href": href, "pos": pos, "is_nav": nav, "title": title, "n_blocks": n, "text": body})
                if len(rows) >= 500:  # a batch for each package would cost more than its rows
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return files.select("doc_id", "content").mapInArrow(run, SPINE)
