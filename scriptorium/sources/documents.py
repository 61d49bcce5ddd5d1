"""Scientific pages and DOCX files as unified documents: metadata, sections, tables, figures, references, formulas.

A page's source (a preprint server's, a medical library's, or any other) picks
the rules for its metadata and sections; everything else is read alike.  A file
that cannot be read gives a row with its ``error`` and nothing else, so one bad
file never ends a job.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import structure as S

from .dom import Element, parse

_SECTION = pa.struct([("name", pa.string()), ("content", pa.string()), ("ord", pa.int32()), ("level", pa.int32()), ("parent", pa.string())])
_TABLE = pa.struct([("caption", pa.string()), ("idx", pa.int32()), ("headers", pa.list_(pa.string())), ("data", pa.list_(pa.list_(pa.string())))])
_FIGURE = pa.struct([("caption", pa.string()), ("idx", pa.int32()), ("path", pa.string()), ("alt_text", pa.string())])
_FORMULA = pa.struct([("raw", pa.string()), ("found_as", pa.string()), ("idx", pa.int32())])
_FIELDS = [
    ("source", pa.string()), ("title", pa.string()), ("authors", pa.list_(pa.string())), ("year", pa.int32()), ("journal", pa.string()), ("doi", pa.string()), ("keywords", pa.list_(pa.string())), ("language", pa.string()),
    ("sections", pa.list_(_SECTION)), ("tables", pa.list_(_TABLE)), ("figures", pa.list_(_FIGURE)), ("references", pa.list_(pa.string())), ("formulas", pa.list_(_FORMULA)), ("error", pa.string()),
]
SCHEMA = """source string, title string, authors array<string>, year int, journal string, doi string, keywords array<string>, language string,
sections array<struct<name:string,content:string,ord:int,level:int,parent:string>>, tables array<struct<caption:string,idx:int,headers:array<string>,data:array<array<string>>>>,
figures array<struct<caption:string,idx:int,path:string,alt_text:string>>, references array<string>, formulas array<struct<raw:string,found_as:string,idx:int>>, error string"""

_HEADINGS = {f"h{i}": i for i in range(1, 7)}
# Formulas in pages, in the order in which they are numbered.
MATH_DISPLAY = r"""<script\s+type=["']math/tex;\s*mode=display["']>(.+?)</script>"""
MATH_INLINE = r"""<script\s+type=["']math/tex["']>(.+?)</script>"""
MATHML = r"<math(?:\s[^>]*)?>(.+?)</math>"


def fold(blocks: Iterable[tuple[int | None, str]], nameless: str = "Body") -> list[dict]:
    """Sections of (heading level or None, text) blocks: a section is a heading and the texts up to the next; its parent is the nearest one before of a lower level.

    Texts before the first heading are the section "Preamble", or ``nameless``
    if no heading follows at all.
    """
    out: list[dict] = []
    name, level, held = None, 1, []

    def close(default: str) -> None:
        content = "\n".join(held).strip()
        if content:
            parent = next((s["name"] for s in reversed(out) if s["level"] < level), None) if level > 1 else None
            out.append({"name": name or default, "content": content, "ord": len(out), "level": level, "parent": parent})

    for depth, text in blocks:
        if depth is not None:
            close("Preamble")
            name, level, held = text, depth, []
        elif text:
            held.append(text)
    close(nameless)
    return out


def page_source(url: str | None, page: Element) -> str:
    """arxiv, pubmed or generic: by the address, the generator, then by class names."""
    address = url or ""
    if "arxiv.org" in address or "ar5iv.org" in address:
        return "arxiv"
    if "pubmed" in address or "pmc.ncbi" in address:
        return "pubmed"
    generator = page.find("meta", name="^generator$")
    made_by = (generator.attrs.get("content") or "").lower() if generator is not None else ""
    for source, words in (("arxiv", ("arxiv", "ar5iv")), ("pubmed", ("pubmed", "nlm"))):
        if any(w in made_by for w in words):
            return source
    for source, pattern in (("arxiv", "arxiv|ar5iv"), ("pubmed", "pmc|pubmed")):
        if page.find(cls=pattern) is not None:
            return source
    return "generic"


def _meta(page: Element, name: str) -> list[str]:
    return [v for e in page.find_all("meta", name=f"^{name}$") if (v := (e.attrs.get("content") or "").strip())]


def _listed(text: str) -> list[str]:
    return [x for part in re.split("[,;]", text) if (x := part.strip())]


def _year(text: str) -> int | None:
    found = re.search(r"\d{4}", text)
    return int(found[0]) if found else None


def _person(text: str) -> bool:
    return re.fullmatch(r"[A-Za-z\s\-.]{3,60}", text) is not None


def page_metadata(page: Element, source: str) -> dict:
    out: dict = {"title": "", "authors": [], "year": None, "journal": None, "doi": next(iter(_meta(page, "citation_doi")), None), "keywords": [], "language": None}
    html = page.find("html")
    if source == "pubmed":
        title = page.find("h1", cls="content-title|article-title")
        out["title"] = title.text() if title is not None else ""
        out["authors"] = [t for e in page.find_all(cls="authors-list-item|contrib-group__author") if _person(t := e.text())] or [t for e in page.find_all("span", "a", cls=r"\bauthor\b") if _person(t := e.text())]
        date, journal = page.find(cls="pub.?date|published"), page.find(cls="journal.?title|source")
        out["year"] = _year(date.text()) if date is not None else None
        out["journal"] = journal.text() if journal is not None else None
        out["keywords"] = [t for e in page.find_all(cls="keyword") if (t := e.text())]
        return out
    out["language"] = html.attrs.get("lang") if html is not None else None
    out["keywords"] = [x for v in _meta(page, "keywords")[-1:] for x in _listed(v)]
    if source == "arxiv":
        title = page.find("h1", cls="title")
        named = title.text() if title is not None else next(iter(_meta(page, "citation_title")), "")
        out["title"] = named.replace("Title:", "").strip()
        out["authors"] = _meta(page, "citation_author")
        out["year"] = next((y for v in _meta(page, "citation_date")[:1] if (y := _year(v))), None)
    else:
        title = page.find("title")
        title = title if title is not None else page.find("h1")
        out["title"] = title.text() if title is not None else ""
        out["authors"] = [x for v in _meta(page, "author")[-1:] for x in _listed(v)]
    return out


def _blocks(container: Element | None) -> Iterator[tuple[int | None, str]]:
    for e in container.elements() if container is not None else []:
        if e.tag in _HEADINGS:
            yield _HEADINGS[e.tag], e.text()
        else:
            yield None, e.text(" ")


def page_sections(page: Element, source: str) -> list[dict]:
    if source == "pubmed":
        out: list[dict] = []
        for e in page.find_all("sec"):
            title = e.find("title")
            content = "\n".join(t for c in e.elements() if c.tag not in ("title", "sec") and (t := c.text(" "))).strip()
            if content:
                level, up = 1, e.above("sec")
                while up is not None:
                    level, up = level + 1, up.above("sec")
                parent = next((s["name"] for s in reversed(out) if s["level"] < level), None) if level > 1 else None
                out.append({"name": title.text() if title is not None else f"Section {len(out) + 1}", "content": content, "ord": len(out), "level": level, "parent": parent})
        if out:
            return out
    places = {"arxiv": [("div", "ltx_document|ltx_page_main"), ("article", ""), ("body", "")], "pubmed": [("article", ""), ("body", "")]}.get(source, [("main", ""), ("article", ""), ("body", "")])
    container = next((e for tag, cls in places if (e := page.find(tag, **({"cls": cls} if cls else {}))) is not None), None)
    return fold(_blocks(container))


def page_tables(page: Element) -> list[dict]:
    """Header cells of the head, and every row of the body that is not the header again."""
    out = []
    for i, e in enumerate(page.find_all("table"), 1):
        head, body, caption = e.find("thead"), e.find("tbody"), e.find("caption")
        headers = [c.text() for c in head.find_all("th", "td")] if head is not None else []
        rows = [[c.text() for c in r.find_all("td", "th")] for r in (body if body is not None else e).find_all("tr")]
        data = [r for r in rows if r and r != headers]
        if headers or data:
            out.append({"caption": caption.text() if caption is not None else f"Table {i}", "idx": i, "headers": headers, "data": data})
    return out


def page_figures(page: Element) -> list[dict]:
    out = []
    for i, e in enumerate(page.find_all("figure"), 1):
        caption, image = e.find("figcaption"), e.find("img")
        found = image.attrs if image is not None else {}
        out.append({"caption": caption.text() if caption is not None else f"Figure {i}", "idx": i, "path": found.get("src"), "alt_text": found.get("alt")})
    return out


def page_references(page: Element) -> list[str]:
    """Items (else paragraphs) of the place named for references, or around a heading of that name."""
    place = page.find(id=r"\bref") or page.find(cls=r"\breferences?\b")
    if place is None:
        heading = next((e for e in page.find_all(*_HEADINGS) if re.fullmatch(r"references?", e.text(), re.I)), None)
        place = heading.above("section", "div", "article") if heading is not None else None
    if place is None:
        return []
    items = list(place.find_all("li")) or list(place.find_all("p"))
    return [t for e in items if (t := e.text())]


def page_formulas(html: str) -> list[dict]:
    """MathJax display, then inline, then MathML; each formula once, whatever its spaces and case."""
    out, met = [], set()
    for pattern, kind in ((MATH_DISPLAY, "block"), (MATH_INLINE, "inline"), (MATHML, "block")):
        for m in re.finditer(pattern, html, re.I | re.S):
            raw = m[1].strip()
            key = re.sub(r"\s+", "", raw).strip("$").lower()
            if key not in met:
                met.add(key)
                out.append({"raw": raw, "found_as": kind, "idx": len(out)})
    return out


def read_page(url: str | None, html: str | None) -> dict:
    page = parse(html)
    source = page_source(url, page)
    return {"source": source, **page_metadata(page, source), "sections": page_sections(page, source), "tables": page_tables(page), "figures": page_figures(page), "references": page_references(page), "formulas": page_formulas(html or "")}


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_CORE = {"title": "{http://purl.org/dc/elements/1.1/}title", "author": "{http://purl.org/dc/elements/1.1/}creator", "created": "{http://purl.org/dc/terms/}created", "keywords": "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}keywords"}


def _docx_text(e: ElementTree.Element) -> str:
    return "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else x.text or "" for x in e.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr")).strip()


def read_docx(path: str | None, content: bytes) -> dict:
    """Paragraphs folded by their heading styles, tables with the first row as header, core properties."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else None
        core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else None
    names = {s.get(f"{_W}styleId"): (n.get(f"{_W}val") or "") for s in (styles.iter(f"{_W}style") if styles is not None else []) if (n := s.find(f"{_W}name")) is not None}

    def blocks() -> Iterator[tuple[int | None, str]]:
        for p in body.iterfind(f"{_W}p"):
            style = p.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(f"{_W}val") if style is not None else ""
            depth = re.fullmatch(r"heading ?([1-9])", (names.get(key) or key or "").lower())
            text = _docx_text(p)
            if text:
                yield (int(depth[1]) if depth else 1 if (names.get(key) or "").lower() == "title" else None), text

    tables = []
    for i, t in enumerate(body.iterfind(f"{_W}tbl"), 1):
        rows = [["\n".join(x for p in c.iterfind(f"{_W}p") if (x := _docx_text(p))) for c in r.iterfind(f"{_W}tc")] for r in t.iterfind(f"{_W}tr")]
        if rows:
            tables.append({"caption": f"Table {i}", "idx": i, "headers": rows[0], "data": rows[1:]})
    about = {k: (core.findtext(tag) or "").strip() if core is not None else "" for k, tag in _CORE.items()}
    sections = fold(blocks())
    stem = re.sub(r"\.[^./]*$", "", (path or "").rpartition("/")[2])
    authors = [x for part in re.split(r",|;| and ", about["author"], flags=re.I) if (x := part.strip())]
    return {"source": "docx", "title": about["title"] or stem, "authors": authors, "year": _year(about["created"]), "journal": None, "doi": None, "keywords": _listed(about["keywords"]), "language": None, "sections": sections, "tables": tables, "figures": [], "references": [], "formulas": []}


def _rows(batches: Iterator[pa.RecordBatch], read: Callable[..., dict], keys: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``read`` on every row's columns after the first; what it raises becomes the row's error."""
    for batch in batches:
        out = []
        for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            try:
                out.append({"id": values[0], **read(*values[keys:]), "error": None})
            except Exception as e:  # noqa: BLE001  a file's fault is its row's
                out.append({"id": values[0], "error": f"{type(e).__name__}: {e}"[:500]})
        yield from pa.Table.from_pylist(out, schema).to_batches()


def _typed(found: DataFrame, id_col: str) -> DataFrame:
    """Section, figure and formula types by the library's rules; a DOCX file's references are the entries of its section of that type."""
    sections = F.transform("sections", lambda s: s.withField("section_type", S.section_type(s["name"])))
    figures = F.transform("figures", lambda f: f.withField("figure_type", S.figure_type(f["caption"], F.lit("image"))))
    formulas = F.transform("formulas", lambda m: F.struct(m["raw"].alias("raw"), S.formula_type(m["raw"], m["found_as"]).alias("formula_type"), m["idx"].alias("idx"), S.formula_format(m["raw"]).alias("format")))
    last = F.get(F.filter("sections", lambda s: s["section_type"] == "references"), 0)["content"]
    entries = F.filter(F.transform(F.split(last, "\n"), F.trim), lambda x: x.rlike(r"^\[\d+\]|^\d+\."))
    listed = F.when(last.isNull(), F.col("references")).when(F.size(entries) > 0, entries).otherwise(F.array(last))
    typed = found.withColumns({"sections": sections, "figures": figures, "formulas": formulas})
    return typed.withColumn("references", F.when(F.col("source") == "docx", listed).otherwise(F.col("references"))).withColumnRenamed("id", id_col)


def _read(rows: DataFrame, read: Callable[..., dict], id_col: str) -> DataFrame:
    kind = rows.schema["id"].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    schema = pa.schema([("id", arrow), *_FIELDS])
    return _typed(rows.mapInArrow(lambda batches: _rows(batches, read, 1, schema), f"id {kind.simpleString()}, {SCHEMA}"), id_col)


def read_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One unified document per page (id_col, the SCHEMA's columns with types)."""
    return _read(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), read_page, id_col)


def read_docx_files(files: DataFrame, *, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """One unified document per DOCX file (path, the SCHEMA's columns with types), e.g. of Spark's binaryFile source."""
    return _read(files.select(F.col(path_col).alias("id"), F.col(path_col).alias("path"), F.col(content_col).alias("content")), read_docx, path_col)
