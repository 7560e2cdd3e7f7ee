"""Extractors: one file's bytes into a title, segments, links and pictures; run as ``mapInPandas`` over binary files.

Formats: HTML, Markdown, and the zip-based office formats through the standard library. PDF needs a library that
must be given (``pdf=`` callable); without one such a file fails with a reason instead of giving text.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import glob_regex
from lodestone.session import ship

SCHEMA = "path string, title string, matched boolean, error string, segments array<struct<ord:int,kind:string,heading_path:string,text:string>>, links array<struct<target:string,anchor:string,heading_path:string>>, images array<struct<src:string,alt:string,caption:string,heading_path:string>>"
_INLINE = {"a", "b", "i", "em", "strong", "span", "code", "sub", "sup", "small", "u", "kbd", "q", "cite", "abbr", "mark", "label", "button", "font", "time", "var", "samp"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "source", "col", "wbr", "area", "base", "embed"}
_HEAD = re.compile(r"^h([1-6])$")


def clean(text: str) -> str:
    return " ".join(text.split())


class Node:
    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else ("\n" if c.tag == "br" else c.text()) for c in self.children)

    def all(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.all()


class _Tree(HTMLParser):
    """A forgiving tree: an end tag closes up to its start, or is dropped; a block closes an open paragraph."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.stack = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.stack[-1].tag == "p" and tag not in _INLINE and tag not in _VOID:
            self.stack.pop()
        # an end tag that may be left out is implied by the next of its kind
        closes = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(tag, ())
        while self.stack[-1].tag in closes:
            self.stack.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in _VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.stack[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)


def _simple(selector: str) -> Callable[[Node], bool]:
    """tag, .class, #id, [attr], [attr=value] and their compounds."""
    parts = re.findall(r"^[\w-]+|[.#][\w-]+|\[[\w-]+(?:=[^\]]*)?\]", selector.strip())

    def match(n: Node) -> bool:
        for p in parts:
            if p[0] == ".":
                ok = p[1:] in n.attrs.get("class", "").split()
            elif p[0] == "#":
                ok = n.attrs.get("id") == p[1:]
            elif p[0] == "[":
                name, _, value = p[1:-1].partition("=")
                ok = name in n.attrs and (not value or n.attrs[name] == value.strip("\"'"))
            else:
                ok = n.tag == p.lower()
            if not ok:
                return False
        return bool(parts)

    return match


class _Doc:
    def __init__(self) -> None:
        self.title: str | None = None
        self.matched = True
        self.segments: list[dict] = []
        self.links: list[dict] = []
        self.images: list[dict] = []
        self.stack: list[tuple[int, str]] = []

    def heading(self, level: int, text: str) -> None:
        """SRC09."""
        while self.stack and self.stack[-1][0] >= level:
            self.stack.pop()
        if text:
            self.stack.append((level, text))

    @property
    def path(self) -> str:
        return " > ".join(t for _, t in self.stack)

    def add(self, kind: str, text: str) -> None:
        if text.strip():
            self.segments.append({"ord": len(self.segments), "kind": kind, "heading_path": self.path, "text": text})


def table_text(rows: list[list[str]], caption: str = "") -> str:
    """SRC08: caption, then rows; cells joined by " | ", empty rows dropped."""
    lines = [" | ".join(clean(c) for c in r) for r in rows if any(c.strip() for c in r)]
    return "\n".join(([clean(caption)] if caption.strip() else []) + lines)


def _walk(node: Node, doc: _Doc) -> None:
    """SRC07: headings make the path, pre is code, tables are linearised, a leaf block gives its whole text, a container its inline runs."""
    run: list[str] = []

    def flush() -> None:
        doc.add("body", clean("".join(run)))
        run.clear()

    for c in node.children:
        if isinstance(c, str):
            run.append(c)
            continue
        if c.tag in ("script", "style", "head", "title"):
            continue
        if c.tag in _INLINE or c.tag in _VOID:
            run.append("\n" if c.tag == "br" else c.text())
            _collect(c, doc)
            continue
        flush()
        h = _HEAD.match(c.tag)
        if h:
            doc.heading(int(h[1]), clean(c.text()))
        elif c.tag == "pre":
            doc.add("code", c.text().strip("\n"))
        elif c.tag == "table":
            rows = [[clean(d.text()) for d in r.children if isinstance(d, Node) and d.tag in ("td", "th")] for r in c.all() if r.tag == "tr"]
            caption = next((x.text() for x in c.all() if x.tag == "caption"), "")
            doc.add("body", table_text(rows, caption))
            _collect(c, doc)
        elif c.tag == "figure":
            caption = clean(next((x.text() for x in c.all() if x.tag == "figcaption"), ""))
            _collect(c, doc, caption)
            doc.add("body", caption)
        elif any(isinstance(x, Node) and x.tag not in _INLINE and x.tag not in _VOID for x in c.all() if x is not c):
            _walk(c, doc)
        else:
            doc.add("body", clean(c.text()))
            _collect(c, doc)
    flush()


def _collect(node: Node, doc: _Doc, caption: str = "") -> None:
    """SRC10."""
    for n in node.all():
        if n.tag == "a" and n.attrs.get("href"):
            doc.links.append({"target": n.attrs["href"], "anchor": clean(n.text()), "heading_path": doc.path})
        elif n.tag == "img" and n.attrs.get("src"):
            doc.images.append({"src": n.attrs["src"], "alt": clean(n.attrs.get("alt", "")), "caption": caption, "heading_path": doc.path})


def extract_html(html: str, content: str | None = None, strip: list[str] | None = None) -> _Doc:
    """SRC06: without what the strip selectors match, within the content selector (the body if it matches nothing, which is flagged)."""
    t = _Tree()
    t.feed(html)
    t.close()
    drop = [_simple(s) for s in strip or []]

    def prune(n: Node) -> None:
        n.children = [c for c in n.children if isinstance(c, str) or not any(d(c) for d in drop)]
        for c in n.children:
            if isinstance(c, Node):
                prune(c)

    doc = _Doc()
    nodes = list(t.root.all())
    title = next((clean(n.text()) for n in nodes if n.tag == "title"), "")
    prune(t.root)
    nodes = list(t.root.all())
    title = title or next((clean(n.text()) for n in nodes if n.tag == "h1"), "")
    scope = next((n for n in nodes if _simple(content)(n)), None) if content else None
    doc.matched = scope is not None or not content
    scope = scope or next((n for n in nodes if n.tag == "body"), t.root)
    doc.title = title or None
    _walk(scope, doc)
    return doc


def strip_front_matter(text: str) -> str:
    """SRC18: a block between two lines of three dashes, closed within 64 lines."""
    if not text.startswith("---\n"):
        return text
    end = text.find("\n---", 3)
    if end < 0 or text.count("\n", 0, end) > 64:
        return text
    return text[text.find("\n", end + 1) + 1 :] if "\n" in text[end + 1 :] else ""


def extract_md(text: str) -> _Doc:
    """SRC17."""
    doc, para, code, table = _Doc(), [], None, []

    def inline(s: str) -> str:
        for alt, src in re.findall(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)", s):
            doc.images.append({"src": src, "alt": clean(alt), "caption": "", "heading_path": doc.path})
        s = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", s)
        for anchor, target in re.findall(r"\[([^\]]*)\]\(([^)\s]+)[^)]*\)", s):
            doc.links.append({"target": target, "anchor": clean(anchor), "heading_path": doc.path})
        return re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", s)

    def flush() -> None:
        if para:
            doc.add("body", clean(inline(" ".join(para))))
            para.clear()
        if table:
            doc.add("body", table_text([r for r in table if not all(re.fullmatch(r":?-+:?", c.strip()) for c in r)]))
            table.clear()

    for line in strip_front_matter(text.removeprefix("﻿").replace("\r\n", "\n")).split("\n"):
        if code is not None:
            if line.strip().startswith("```"):
                doc.add("code", "\n".join(code))
                code = None
            else:
                code.append(line)
        elif line.strip().startswith("```"):
            flush()
            code = []
        elif m := re.match(r"^(#{1,6})\s+(.*?)\s*#*$", line):
            flush()
            doc.heading(len(m[1]), clean(inline(m[2])))
            doc.title = doc.title or clean(m[2])[:200]
        elif "|" in line and (table or line.strip().startswith("|")):
            if not table and para:
                flush()
            table.append([inline(c) for c in line.strip().strip("|").split("|")])
        elif not line.strip():
            flush()
        else:
            if table:
                flush()
            para.append(line.strip())
    if code:
        doc.add("code", "\n".join(code))
    flush()
    doc.title = doc.title or (doc.segments[0]["text"][:200] if doc.segments else None)
    return doc


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _cell(e: ET.Element) -> str:
    """SRC16: text of a cell, nested tables included."""
    out = []
    for x in e:
        if _local(x) == "p":
            out.append("".join(t.text or "" for t in x.iter() if _local(t) == "t"))
        elif _local(x) == "tbl":
            out.append(table_text([[_cell(c) for c in r if _local(c) == "tc"] for r in x if _local(r) == "tr"]))
    return clean(" ".join(out))


def extract_docx(data: bytes) -> _Doc:
    """SRC15: the body in order; heading and title styles make the path."""
    doc = _Doc()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(e for e in ET.fromstring(z.read("word/document.xml")) if _local(e) == "body")
        rels = {}
        if "word/_rels/document.xml.rels" in z.namelist():
            rels = {r.attrib["Id"]: r.attrib["Target"] for r in ET.fromstring(z.read("word/_rels/document.xml.rels"))}
    for e in body:
        if _local(e) == "tbl":
            doc.add("body", table_text([[_cell(c) for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]))
        elif _local(e) == "p":
            text = clean("".join((t.text or "") if _local(t) == "t" else "\t" if _local(t) == "tab" else "" for t in e.iter()))
            style = next((_attr(s, "val") or "" for s in e.iter() if _local(s) == "pStyle"), "")
            m = re.match(r"(?i)heading\s*([1-9])", style)
            if m or style.lower() == "title":
                doc.heading(int(m[1]) if m else 1, text)
                doc.title = doc.title or text[:200]
            else:
                doc.add("body", text)
            for h in e.iter():
                if _local(h) == "hyperlink" and _attr(h, "id") in rels:
                    doc.links.append({"target": rels[_attr(h, "id")], "anchor": clean("".join(t.text or "" for t in h.iter() if _local(t) == "t")), "heading_path": doc.path})
                elif _local(h) == "blip" and _attr(h, "embed") in rels:
                    doc.images.append({"src": rels[_attr(h, "embed")], "alt": "", "caption": "", "heading_path": doc.path})
    return doc


def extract_pptx(data: bytes) -> _Doc:
    """SRC19: a heading "Slide i: title" for each slide, its text and tables, then its notes."""
    doc = _Doc()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for i, name in enumerate(names, 1):
            root = ET.fromstring(z.read(name))
            title, texts = "", []
            for sp in root.iter():
                if _local(sp) == "sp":
                    kind = next((_attr(p, "type") or "" for p in sp.iter() if _local(p) == "ph"), "")
                    paras = [clean("".join(t.text or "" for t in p.iter() if _local(t) == "t")) for p in sp.iter() if _local(p) == "p"]
                    if kind in ("title", "ctrTitle"):
                        title = clean(" ".join(paras))
                    else:
                        texts += paras
                elif _local(sp) == "tbl":
                    texts.append(table_text([[clean("".join(t.text or "" for t in c.iter() if _local(t) == "t")) for c in r if _local(c) == "tc"] for r in sp if _local(r) == "tr"]))
            doc.stack = []
            doc.heading(1, f"Slide {i}: {title}" if title else f"Slide {i}")
            doc.title = doc.title or title or None
            for t in texts:
                doc.add("body", t)
            note = f"ppt/notesSlides/notesSlide{i}.xml"
            if note in z.namelist():
                text = clean(" ".join(t.text or "" for t in ET.fromstring(z.read(note)).iter() if _local(t) == "t"))
                doc.heading(2, "Speaker notes")
                doc.add("body", text)
    return doc


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n


def extract_xlsx(data: bytes) -> _Doc:
    """SRC20: each sheet as a table; merged cells repeat their first one's value; the path is the sheet and its first filled cell."""
    doc = _Doc()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        titles = [_attr(s, "name") or "" for s in ET.fromstring(z.read("xl/workbook.xml")).iter() if _local(s) == "sheet"]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for i, name in enumerate(sheets):
            root = ET.fromstring(z.read(name))
            cells: dict[tuple[int, int], str] = {}
            for c in (x for x in root.iter() if _local(x) == "c"):
                ref = c.attrib.get("r", "")
                value = "".join((v.text or "") for v in c.iter() if _local(v) in ("v", "t"))
                if c.attrib.get("t") == "s" and value:
                    value = shared[int(value)]
                if ref and value:
                    cells[(int(re.search(r"\d+", ref)[0]), _column(ref))] = value
            if not cells:
                continue
            for m in (x for x in root.iter() if _local(x) == "mergeCell"):
                a, _, b = m.attrib["ref"].partition(":")
                top = (int(re.search(r"\d+", a)[0]), _column(a))
                for r in range(top[0], int(re.search(r"\d+", b or a)[0]) + 1):
                    for k in range(top[1], _column(b or a) + 1):
                        cells.setdefault((r, k), cells.get(top, ""))
            r0, c0 = min(cells)[0], min(k for _, k in cells)
            rows = [[cells.get((r, k), "") for k in range(c0, max(k for _, k in cells) + 1)] for r in range(r0, max(r for r, _ in cells) + 1)]
            doc.stack = []
            doc.heading(1, titles[i] if i < len(titles) else name)
            doc.title = doc.title or doc.path
            doc.add("body", table_text(rows))
    return doc


def extract(data: bytes, ext: str, content: str | None = None, strip: list[str] | None = None, pdf: Callable[[bytes], _Doc] | None = None) -> _Doc:
    """SRC05: by extension; what isn't known is taken for HTML."""
    ext = ext.lower().lstrip(".")
    if ext == "docx":
        return extract_docx(data)
    if ext == "pptx":
        return extract_pptx(data)
    if ext == "xlsx":
        return extract_xlsx(data)
    if ext == "pdf":
        if pdf is None:
            raise ValueError("no PDF extractor given")
        return pdf(data)
    text = data.decode("utf-8", "replace")
    return extract_md(text) if ext in ("md", "markdown") else extract_html(text, content, strip)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """SRC02: path (below the folder), size, content of every file, at any depth."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder.rstrip("/").removeprefix("file://") + "/"
    return f.select(F.regexp_replace(F.regexp_replace("path", r"^file:(//)?", ""), "^" + re.escape(base), "").alias("path"), F.col("length").alias("size"), "content")


def classified(files: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """SRC01-SRC03: class of each path: excluded beats included; no include takes all."""
    any_of = lambda ps: F.lit(False) if not ps else F.col("path").rlike("|".join(f"(?:{glob_regex(p)})" for p in ps))
    return files.withColumn("class", F.when(any_of(exclude), "excluded").when(any_of(include) if include else F.lit(True), "included").otherwise("other"))


def content_hash(c: Column) -> Column:
    """SRC04."""
    return F.sha2(c, 256)


def data_uri(c: Column) -> tuple[Column, Column]:
    """SRC11: (extension, bytes) of an inline picture; null for anything else or broken base64."""
    kind = F.lower(F.regexp_extract(c, r"(?i)^data:image/([a-z0-9.+-]+);base64,", 1))
    body = F.regexp_replace(F.regexp_extract(c, r"(?is)^data:image/[a-z0-9.+-]+;base64,(.*)$", 1), r"\s", "")
    ok = (kind != "") & body.rlike(r"^[A-Za-z0-9+/]+={0,2}$")
    return F.when(ok, F.when(kind == "jpeg", "jpg").otherwise(kind)), F.when(ok, F.try_to_binary(body, F.lit("base64")))


def extract_all(files: DataFrame, content: str | None = None, strip: list[str] | None = None, pdf: Callable[[bytes], _Doc] | None = None) -> DataFrame:
    """One row of SCHEMA for each file(path, content); a file that can't be read has its error."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_ in it:
            rows = []
            for path, data in zip(pdf_["path"], pdf_["content"]):
                try:
                    d = extract(bytes(data), path.rpartition(".")[2], content, strip, pdf)
                    rows.append((path, d.title, d.matched, None, d.segments, d.links, d.images))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, False, f"{type(e).__name__}: {e}"[:200], [], [], []))
            yield pd.DataFrame(rows, columns=["path", "title", "matched", "error", "segments", "links", "images"])

    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, SCHEMA)
