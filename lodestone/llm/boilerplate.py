"""Main content against page boilerplate: wrappers by union-free regular-expression inference.

Pages of one host come from few templates. The token streams of a host's raw pages are aligned one after
the other: equal tokens stay constants, digits are a class of their own, a mismatch becomes a text slot
or, if one side is empty, an optional one, and runs of blocks of one kind become a constant followed by a
repeated group (the title of a sidebar and its items). Blocks of the page's content container are
the article and serve as counter-examples: no generalisation may cover one. What only one page shows was aligned
with nothing and is no part of a wrapper. The wrappers are then matched against the line streams of all chunks of HTML
documents; hosts share them, as pages are copied between hosts and mix languages.

Wrappers are fitted on all raw pages, whose markup labels their lines. Lines with different first tokens never meet in a template, so each first
token is a task of its own; what is collected are the templates and titles. All chunks and whole texts are classified. Null ids and null or empty texts have
no lines; documents without host use the wrappers of all; without raw pages nothing is found.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from html.parser import HTMLParser
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import cut, ship, table

#: Characters of a line beyond which a template is matched constant by constant, in linear time; it steers speed only.
LONG = 400
SLOT, OPTION = "\0", "\1"
CONTENT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "li", "td", "th", "tr", "table", "blockquote", "figcaption", "dt", "dd", "caption", "code"}
BLOCKS = CONTENT_TAGS | {"div", "section", "nav", "header", "footer", "aside", "main", "article", "ul", "ol", "dl", "body", "form", "figure"}
FRAME_TAGS = {"nav", "header", "footer", "aside", "form"}
VOID = {"br", "img", "hr", "input", "meta", "link"}
MARK = r"(?:[›»•·▸▪◦*–-]\s*)"
_TOKEN = re.compile(r"\d+|[^\W\d_]+|_|[^\w\s]")
_MARKED = re.compile("^" + MARK)
_END = re.compile(r"[.!?;:…]$")


class _Blocks(HTMLParser):
    """The text of each leaf block, in order, with the path of (tag, signature) above it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str, int]] = []
        self.blocks: list[tuple[list[tuple[str, str, int]], str]] = []
        self.text: list[str] = []
        self.skip = self.serial = 0

    def _flush(self) -> None:
        for line in "".join(self.text).split("\n"):
            if line.strip():
                self.blocks.append((list(self.stack), " ".join(line.split())))
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "title", "head"):
            self.skip += tag != "head"
            return
        if tag in VOID:
            self.text.append("\n" if tag == "br" else "")
            return
        if tag in BLOCKS:
            self._flush()
            a = dict(attrs)
            self.serial += 1
            self.stack.append((tag, tag + ("#" + a["id"] if a.get("id") else "") + ("." + a["class"] if a.get("class") else ""), self.serial))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "title"):
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCKS:
            self._flush()
            if any(t == tag for t, _, _ in self.stack):
                while self.stack.pop()[0] != tag:
                    pass

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)


def labelled_lines(html: str) -> list[tuple[str, int, bool, str]]:
    """(signature of the block, position in its run, belongs to the frame, text) of each line of a page. The content container
    is the element directly above most of the text in plain content blocks."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser._flush()
    weight: Counter = Counter()
    for path, text in parser.blocks:
        if path and path[-1][0] in CONTENT_TAGS and path[-1][1] == path[-1][0]:
            above = next((p for p in reversed(path[:-1]) if p[0] not in CONTENT_TAGS | {"ul", "ol", "dl"}), None)
            if above and above[0] not in FRAME_TAGS:
                weight[above[2]] += len(text)
    main = weight.most_common(1)[0][0] if weight else None
    out, run, last = [], 0, None
    for path, text in parser.blocks:
        at = next((i for i, p in enumerate(path) if p[2] == main), -1)
        inner = path[at + 1 :]
        frame = any(t in FRAME_TAGS or (s != t and t not in CONTENT_TAGS) for t, s, _ in inner) or not (path and path[-1][0] in CONTENT_TAGS or (at >= 0 and not inner))
        signature = next((s for t, s, _ in reversed(path) if t not in CONTENT_TAGS), "")
        run = run + 1 if (signature, frame) == last else 0
        last = (signature, frame)
        out.append((signature, run, frame, text))
    return out


def tokens(line: str) -> tuple[str, ...]:
    return tuple("#" if t.isdigit() else t for t in _TOKEN.findall(line))


def expression(template: tuple[str, ...]) -> str:
    """The regular expression of a template: constants, digits, slots, optional slots."""
    out = []
    for t in template:
        out.append(".+?" if t == SLOT else "(?:.+?)?" if t == OPTION else r"\d+" if t == "#" else re.escape(t))
    return r"\s*".join(out)


def pieces(template: tuple[str, ...]) -> list[tuple[int, re.Pattern]]:
    """The constants of a template between its slots, as expressions, each with the least number of characters of the slot before it; the last one ends the line."""
    runs: list[tuple[int, list[str]]] = [(0, [])]
    for t in template:
        if t in (SLOT, OPTION):
            if runs[-1][1]:
                runs.append((0, []))
            runs[-1] = (runs[-1][0] + (t == SLOT), runs[-1][1])
        else:
            runs[-1][1].append(r"\d+?" if t == "#" else re.escape(t))
    return [(least, re.compile(r"\s*".join(run) + (r"\Z" if i == len(runs) - 1 else ""), re.I)) for i, (least, run) in enumerate(runs)]


def fits(parts: list[tuple[int, re.Pattern]], line: str) -> bool:
    """Whether a template (by ``pieces``) covers a line: each constant at its first place, as an earlier end leaves the most to the others."""
    at = 0
    for i, (least, e) in enumerate(parts):
        m = None if at + least > len(line) else e.search(line, at + least) if i else e.match(line)
        if m is None:
            return False
        at = m.end()
    return True


def align(template: tuple[str, ...], line: tuple[str, ...]) -> tuple[str, ...] | None:
    """Both generalised, or None if they have too little in common: the first token, and then either the two behind it or a third
    of the shorter one."""
    if template[0] != line[0]:
        return None
    out: list[str] = []
    same = words = 0
    for tag, i, k, j, m in SequenceMatcher(None, template, line, autojunk=False).get_opcodes():
        if tag == "equal":
            out += template[i:k]
            same += k - i
            words += sum(t.isalpha() for t in template[i:k])
        else:
            # a gap that one of the two can do without is optional
            new = OPTION if all(t == OPTION for t in template[i:k]) or all(t == OPTION for t in line[j:m]) else SLOT
            if not out or out[-1] not in (SLOT, OPTION):
                out.append(new)
    constants = sum(t not in (SLOT, OPTION) for t in template)
    head = next((i for i, (a, b) in enumerate(zip(template, line)) if a != b), min(len(template), len(line)))
    if (same < 0.34 * min(constants, len(line)) and head < 3) or words < 1 or (words < 2 and same < 3):
        return None
    return tuple(out)


def bare(line: str) -> tuple[str, ...]:
    """The tokens of a line without its mark."""
    return tokens(_MARKED.sub("", line, count=1))


def _infer(stream: list[tuple[tuple[str, ...], int]], article: set[str], known: dict[tuple[str, ...], bool]) -> Counter:
    """Align the lines of a stream, all with one first token, one after the other into templates, none of which covers a line of the article. Each with the
    number of pages behind it. ``known``: templates that were compared with the article."""

    def covers(template: tuple[str, ...]) -> bool:
        if template not in known:
            e = re.compile(expression(template), re.I | re.S)
            known[template] = any(e.fullmatch(a) for a in article)
        return known[template]

    templates: list[list] = []
    for line, n in stream:
        for own in templates:
            t = own[0]
            if SLOT not in line and OPTION not in line and re.fullmatch(expression(t), " ".join(line).replace("#", "0"), re.S):
                own[1] += n
                break
            new = t if t == line else align(t, line)
            if new and not covers(new):
                own[:] = new, own[1] + n
                break
        else:
            if not covers(line):
                templates.append([line, n])
    out: Counter = Counter()
    for t, n in templates:
        out[t] += n
    return out


def inferred(lines: Iterable[tuple[str, str, tuple[str, ...], int]], article: set[str]) -> list[tuple[str, ...]]:
    """The templates of frame lines (host, signature, tokens, number of pages) that have one first token, against the lines of articles that begin with it."""
    streams: dict[tuple[str, str], Counter] = defaultdict(Counter)
    for host, sig, t, n in lines:
        streams[(host, sig)][t] += n
    known: dict[tuple[str, ...], bool] = {}
    found: Counter = Counter()
    for _, stream in sorted(streams.items()):
        found.update(_infer(sorted(stream.items(), key=lambda x: (-x[1], x[0])), article, known))
    # then over hosts: names of firms and the like become slots
    general = _infer(sorted(found.items(), key=lambda x: (-x[1], x[0])), article, known)
    # a line of one page alone was aligned with nothing, so nothing was inferred from it
    kept = [t for t, n in general.items() if n > 1]
    slotted = [pieces(t) for t in kept if SLOT in t or OPTION in t]
    return [t for t in kept if SLOT in t or OPTION in t or not any(fits(p, " ".join(t).replace("#", "0")) for p in slotted)]


def is_listing(article: float | Column, every: float | Column) -> bool | Column:
    """Whether a block is a listing, by its lines behind the first one, on all pages, and those of them that are lines of articles too."""
    return (article >= 2) & (article >= 0.03 * every)


class Wrapper:
    """Templates of frame lines, titles of listings with their repeated items."""

    def __init__(self, lines: list[tuple[str, str, int, bool, str, int]]) -> None:
        """``lines``: host, signature, position in the run, frame, text, number of pages; few enough for one machine (``fit`` takes any number)."""
        article: dict[str, set[str]] = defaultdict(set)
        plain: set[tuple[str, ...]] = set()
        lower = lambda t: tuple(x.lower() for x in t)
        for _, _, _, frame, text, _ in lines:
            if not frame and (t := tokens(text)):
                article[t[0].lower()].add(text)
                plain.add(lower(bare(text)))
        seen: dict[str, Counter] = defaultdict(Counter)
        for _, sig, pos, frame, text, n in lines:
            if frame and pos:
                seen[sig]["all"] += n
                seen[sig]["article"] += n * (lower(bare(text)) in plain)
        listing = {s for s, c in seen.items() if is_listing(c["article"], c["all"])}
        self.item_words = max([len(_MARKED.sub("", text, count=1).split()) for _, sig, pos, frame, text, _ in lines if frame and pos and sig in listing], default=0) + 1
        self.items = max([pos for _, sig, pos, frame, _, _ in lines if frame and sig in listing], default=0)
        self.titles: set[tuple[str, ...]] = set()
        by: dict[str, list] = defaultdict(list)
        for host, sig, pos, frame, text, n in lines:
            if frame and (t := bare(text)) and lower(t) not in plain:
                if sig not in listing:
                    by[t[0].lower()].append((host, sig, t, n))
                elif not pos:
                    self.titles.add(lower(t))
        self.templates = sorted(t for head, own in by.items() for t in inferred(own, article[head]))

    @classmethod
    def of(cls, templates: list[tuple[str, ...]], titles: set[tuple[str, ...]], items: int, item_words: int) -> Wrapper:
        self = cls([])
        self.templates, self.titles, self.items, self.item_words = templates, titles, items, item_words
        return self

    def compiled(self) -> Classifier:
        return Classifier(self.templates, self.titles, self.items, self.item_words)


class Classifier:
    def __init__(self, templates: list[tuple[str, ...]], titles: set[tuple[str, ...]], items: int, item_words: int) -> None:
        by: dict[str, list[str]] = defaultdict(list)
        self.long: dict[str, list[list[tuple[int, re.Pattern]]]] = defaultdict(list)
        exact: set[tuple[str, ...]] = set()
        for t in templates:
            if SLOT in t or OPTION in t:
                by[t[0].lower()].append(expression(t))
                self.long[t[0].lower()].append(pieces(t))
            else:
                exact.add(tuple(x.lower() for x in t))
        self.by = {k: re.compile("|".join(f"(?:{e})" for e in v), re.I | re.S) for k, v in by.items()}
        self.exact, self.titles, self.items, self.item_words = exact, titles, items, item_words
        self.longest = max(map(len, exact | titles), default=0)

    def frame(self, text: str) -> list[int]:
        """The numbers of the lines of a text that belong to the frame."""
        out: list[int] = []
        left = self.items  # a text may begin inside a listing: then only marked items count
        inside = False
        for no, raw in enumerate(text.split("\n")):
            line = " ".join(raw.split())
            if not line:
                continue
            marked = _MARKED.match(line)
            bare = line[marked.end() :] if marked else line
            first = _TOKEN.search(bare)
            if first is None:
                left = 0
                continue
            head = "#" if first[0].isdigit() else first[0].lower()
            t = tuple("#" if x[0].isdigit() else x[0].lower() for x in islice(_TOKEN.finditer(bare), self.longest + 1))  # one more than any of them has
            if t in self.titles:
                out.append(no)
                left, inside = self.items, True
                continue
            e = self.by.get(head)
            if t in self.exact or (e is not None and (e.fullmatch(bare) if len(bare) <= LONG else any(fits(p, bare) for p in self.long[head]))):
                out.append(no)
                left = 0
                continue
            if left and (inside or marked) and len(bare.split()) <= self.item_words and not _END.search(bare):
                out.append(no)
                left -= 1
                continue
            left = 0
        return out


def is_html(fmt: Column) -> Column:
    """HTML in any spelling: html, htm, .html, text/html, xhtml, ..."""
    return F.lower(fmt).rlike(r"(^|[^a-z])x?html?([^a-z]|$)")


def fit(pages: DataFrame) -> Wrapper:
    """Wrappers from all pages (host, key, html), as ``Wrapper`` makes them of their lines. Only templates and titles are collected."""
    spark = pages.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = pages.where(F.length("html") > 0).select(F.coalesce("host", F.lit("")).alias("host"), F.xxhash64("host", "key").alias("page"), "html")

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(h, page, *x) for h, page, html in zip(pdf["host"], pdf["page"], pdf["html"]) for x in labelled_lines(html)]
            yield pd.DataFrame(rows, columns=["host", "page", "signature", "pos", "frame", "text"])

    def keyed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """bare: the lower-case tokens without the mark; head: the first token, of an article's line with its mark; words: without the mark."""
        for pdf in it:
            own = [bare(x) for x in pdf["text"]]
            first = [t if frame else tokens(x) for t, frame, x in zip(own, pdf["frame"], pdf["text"])]
            words = [len(_MARKED.sub("", x, count=1).split()) for x in pdf["text"]]
            yield pdf.assign(bare=[" ".join(x.lower() for x in t) for t in own], head=[t[0].lower() if t else None for t in first], words=words)

    def meet(lines: pd.DataFrame, article: pd.DataFrame) -> pd.DataFrame:
        own = [(h, s, bare(x), k) for h, s, x, k in zip(lines["host"], lines["signature"], lines["text"], lines["pages"])]
        return pd.DataFrame({"template": pd.Series([list(t) for t in inferred(own, set(article["line"]))], dtype=object)})

    got = src.repartition(n).mapInPandas(parse, "host string, page bigint, signature string, pos int, frame boolean, text string")
    # digits don't distinguish lines here
    got = got.groupBy("host", "signature", "pos", "frame", F.regexp_replace("text", r"\d+", "0").alias("text")).agg(F.count_distinct("page").alias("pages"))
    lines = cut(got.mapInPandas(keyed, "host string, signature string, pos int, frame boolean, text string, pages bigint, bare string, head string, words int"))
    article = lines.where("NOT frame AND head IS NOT NULL")
    framed = lines.where("frame").join(article.select("bare", F.lit(True).alias("plain")).distinct(), "bare", "left")
    seen = framed.where("pos > 0").groupBy("signature").agg(F.sum("pages").alias("every"), F.coalesce(F.sum(F.when(F.col("plain"), F.col("pages"))), F.lit(0)).alias("article"))
    listing = seen.where(is_listing(F.col("article"), F.col("every"))).select("signature", F.lit(True).alias("listing"))
    framed = cut(framed.join(F.broadcast(listing), "signature", "left"))  # as few as there are kinds of listings
    items, item_words = framed.where("listing").agg(F.max("pos"), F.max(F.when(F.col("pos") > 0, F.col("words")))).first()
    open_ = framed.where("plain IS NULL AND head IS NOT NULL")
    titles = {tuple(x.lower() for x in bare(r[0])) for r in open_.where("listing AND pos = 0").select("text").distinct().toLocalIterator()}
    own = open_.where("listing IS NULL").select("head", "host", "signature", "text", "pages")
    against = article.select(F.col("head").alias("word"), F.col("text").alias("line")).distinct().join(own.select(F.col("head").alias("word")).distinct(), "word", "left_semi")
    met = own.repartition(n, "head").groupBy("head").cogroup(against.repartition(n, "word").groupBy("word")).applyInPandas(meet, "template array<string>")
    return Wrapper.of(sorted(tuple(r[0]) for r in met.toLocalIterator()), titles, items or 0, (item_words or 0) + 1)


def frame_lines(chunks: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """id, line_no, of the frame lines of chunks of HTML documents."""
    docs = documents.where(is_html(F.col("fmt"))).select("doc_id", "source")
    host = F.coalesce(F.regexp_extract("url", r"^\w+://([^/:?#]+)", 1), F.lit(""))
    wrapper = fit(pages.select(host.alias("host"), F.coalesce(F.col("document_id"), F.lit(0)).alias("key"), "html"))
    parts = (wrapper.templates, wrapper.titles, wrapper.items, wrapper.item_words)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Classifier(*parts)
        for pdf in it:
            ids, nos = [], []
            for i, t in zip(pdf["id"], pdf["text"]):
                got = c.frame(t)
                ids += [i] * len(got)
                nos += got
            yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "line_no": pd.Series(nos, dtype="int32")})

    src = chunks.where((F.length("text") > 0) & F.col("id").isNotNull()).select("id", "document_id", "text").join(docs.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
    return src.select("id", "text").dropDuplicates(["id"]).mapInPandas(run, "id bigint, line_no int")


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf, "chunks"), table(spark, sf, "documents"), table(spark, sf, "raw_pages")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return frame_lines(*_inputs(spark, sf)).select(F.col("id").alias("chunk_id"), "line_no").distinct()


def p3_article(spark: SparkSession, sf: str) -> DataFrame:
    """chunk_id, article: the text of each chunk of an HTML document without its frame lines."""
    chunks, documents, pages = _inputs(spark, sf)
    found = frame_lines(chunks, documents, pages).groupBy("id").agg(F.collect_set("line_no").alias("frame"))  # no more than the lines of one text
    docs = documents.where(is_html(F.col("fmt"))).select(F.col("doc_id").alias("document_id"))
    body = chunks.where(F.col("text").isNotNull()).select("id", "document_id", "text").join(docs, "document_id", "left_semi").dropDuplicates(["id"])
    kept = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.col("frame").isNull() | ~F.array_contains("frame", s["i"]))
    return body.join(found, "id", "left").select(F.col("id").alias("chunk_id"), F.array_join(F.transform(kept, lambda s: s["x"]), "\n").alias("article"))


QUERIES = {"p3_found": p3_found, "p3_article": p3_article}
SQL: dict[str, str] = {}
