"""Column functions over text: cleaning, tokens, queries, rules, citations, names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of the index: maximal runs of letters or digits, lower case (TXT05, RK01).
TOKEN = r"[\p{L}\p{N}]+"
MAX_TERMS = 64


def clean(c: Column) -> Column:
    """TXT01: white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-case tokens in order; null for null."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def query_terms(c: Column) -> Column:
    """TXT05: distinct tokens of a query in order, at most 64."""
    return F.slice(F.array_distinct(tokens(c)), 1, MAX_TERMS)


def snippet(c: Column, size: int = 180) -> Column:
    """TXT03: collapsed, cut after ``size`` characters with an ellipsis."""
    x = clean(c)
    return F.when(F.length(x) > size, F.concat(F.substring(x, 1, size), F.lit(" …"))).otherwise(x)


def snippet_around(text: Column, terms: Column, window: int = 12) -> Column:
    """TXT04: ``window`` words around the first that holds a term, " … " where text is cut."""
    w = F.split(clean(text), " ")
    at = F.array_position(F.transform(w, lambda x: F.arrays_overlap(tokens(x), terms)), True)
    start = F.greatest(F.lit(1), at.cast("int") - F.lit(window // 2))
    body = F.array_join(F.slice(w, start, F.lit(window)), " ")
    return F.concat(F.when(start > 1, "… ").otherwise(""), body, F.when(start + window - 1 < F.size(w), " …").otherwise(""))


def risky(pattern: str) -> bool:
    """TXT08: a quantified group that holds a quantifier may take exponential time."""
    depth: list[bool] = []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if ch == "(":
            depth.append(False)
        elif ch in "*+{" and depth:
            depth[-1] = True
        elif ch == ")" and depth:
            inner = depth.pop()
            if inner and pattern[i + 1 : i + 2] in ("*", "+", "{"):
                return True
            if depth and inner:
                depth[-1] = True
        i += 1
    return False


def first_rule(c: Column, rules: list[tuple[str, str]]) -> Column:
    """TXT06: label of the first rule (list order) whose pattern matches, case-insensitively; risky or invalid patterns are skipped."""
    out = []
    for pattern, label in rules:
        try:
            re.compile(pattern)
        except re.error:
            continue
        if not risky(pattern):
            out.append(F.when(c.rlike("(?i)" + pattern), F.lit(label)))
    return F.coalesce(*out, F.lit(None).cast("string"))


def tagged(c: Column, prefix: str = "[GOTCHA] ") -> Column:
    """TXT07: the prefix, once."""
    return F.when(F.startswith(c, F.lit(prefix)), c).otherwise(F.concat(F.lit(prefix), c))


CITATION = r"\[GK\]|\[D:\d+#\d+\]"


def citations(c: Column) -> Column:
    """TXT11: array of (kind, raw, doc_id, chunk_id) in order."""
    return F.transform(
        F.regexp_extract_all(c, F.lit(CITATION), F.lit(0)),
        lambda x: F.struct(
            F.when(x == "[GK]", "gk").otherwise("doc").alias("kind"),
            x.alias("raw"),
            F.regexp_extract(x, r"D:(\d+)#", 1).try_cast("bigint").alias("doc_id"),
            F.regexp_extract(x, r"#(\d+)", 1).try_cast("bigint").alias("chunk_id"),
        ),
    )


def citation_url(doc: Column, chunk: Column, base: str) -> Column:
    """TXT12."""
    return F.concat(F.lit(base.rstrip("/")), F.lit("/documents/"), doc.cast("string"), F.lit("#chunk-"), chunk.cast("string"))


def strip_citations(c: Column) -> Column:
    """TXT15: without tags; spaces before punctuation and doubled ones go."""
    x = F.regexp_replace(c, CITATION, "")
    x = F.regexp_replace(x, r" +([.,;:!?])", "$1")
    return F.trim(F.regexp_replace(x, r" {2,}", " "))


def clean_caption(c: Column) -> Column:
    """TXT16: without a leading figure number."""
    return F.trim(F.regexp_replace(c, r"(?i)^\s*fig(?:ure|\.)?\s*\d+\s*[:.–-]?\s*", ""))


def key_values(c: Column) -> Column:
    """TXT17: "K=V, K2=V2" as a map; pairs without "=" or key are skipped, the last of a key wins."""
    pairs = F.filter(F.split(c, ","), lambda p: F.contains(p, F.lit("=")) & (F.trim(F.substring_index(p, "=", 1)) != ""))
    items = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v")))
    return F.aggregate(items, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))


def name_convention(c: Column) -> Column:
    """TXT21: spelling of an identifier."""
    n = F.regexp_replace(c, "^_+|_+$", "")
    return (
        F.when(n.rlike(r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$") | n.rlike(r"^[A-Z][A-Z0-9]+$"), "SCREAMING_SNAKE")
        .when(n.rlike(r"^[a-z][a-z0-9]*(_[a-z0-9]+)*$"), "snake_case")
        .when(F.contains(n, F.lit("_")), "mixed")
        .when(n.rlike(r"^[A-Z][A-Za-z0-9]*$"), "PascalCase")
        .when(n.rlike(r"^[a-z][A-Za-z0-9]*$"), "camelCase")
        .otherwise("other")
    )


def has_return_annotation(signature: Column, language: Column) -> Column:
    """TXT22: null where the language has no rule."""
    return F.when(language == "python", F.contains(signature, F.lit("->"))).when(language == "typescript", signature.rlike(r"\)\s*:"))


def audience(c: Column) -> Column:
    """TXT24: a JSON list; anything else is the empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def sheet_cell(c: Column) -> Column:
    """TXT32: no control characters, no formula at the start."""
    x = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.when(x.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), x)).otherwise(x)


def slug(c: Column, size: int = 60) -> Column:
    """FN10."""
    x = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(x == "", "untitled").otherwise(F.substring(x, 1, size))


def printable(c: Column) -> Column:
    """FN09."""
    return F.regexp_replace(c, r"\p{C}", "")


def glob_regex(pattern: str) -> str:
    """SRC01: segment-aware glob as an anchored regular expression: ``**/`` any depth, ``**`` anything, ``*`` within a segment, ``?`` one character."""
    out, i = ["^"], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            ch = pattern[i]
            out.append("[^/]*" if ch == "*" else "[^/]" if ch == "?" else re.escape(ch))
            i += 1
    return "".join(out) + "$"
