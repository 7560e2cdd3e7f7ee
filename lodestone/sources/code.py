"""Source code to symbols: Python by its own grammar, VBA by lines, eight brace languages by scopes; style statistics."""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.session import ship

SCHEMA = "key bigint, language string, kind string, name string, qualname string, signature string, docstring string, start_line int, end_line int"
# Suffix and language.
LANGUAGES = {"py": "python", "pyi": "python", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "java": "java", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "bas": "vba", "cls": "vba", "frm": "vba", "vb": "vba"}


def language(path: Column) -> Column:
    """SRC33."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), F.lower(F.substring_index(path, ".", -1)))


def python_symbols(text: str) -> list[tuple]:
    """SRC31, TXT23: functions, classes and methods with signature and docstring; broken source gives none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, out = text.split("\n"), []

    def visit(node: ast.AST, prefix: str, in_class: bool) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                is_class = isinstance(n, ast.ClassDef)
                kind = "class" if is_class else "method" if in_class else "function"
                first = n.body[0].lineno if n.body else n.lineno
                sig = " ".join(" ".join(lines[n.lineno - 1 : max(n.lineno, first - 1)]).split()).rstrip(":")
                out.append(("python", kind, n.name, prefix + n.name, sig, ast.get_docstring(n), n.lineno, n.end_lineno))
                visit(n, prefix + n.name + ".", is_class)
            else:
                visit(n, prefix, in_class)

    visit(tree, "", False)
    return out


_VBA = re.compile(r"(?i)^\s*(?:(?:public|private|friend|static)\s+)*(sub|function|property\s+(?:get|let|set)|type|enum)\s+([A-Za-z_]\w*)(.*)$")


def vba_symbols(text: str) -> list[tuple]:
    """SRC32."""
    out, lines, note = [], text.split("\n"), []
    for i, line in enumerate(lines, 1):
        m = _VBA.match(line)
        if m:
            what = re.sub(r"\s+", " ", m[1].lower())
            end = next((k for k in range(i, len(lines)) if re.match(rf"(?i)^\s*end\s+{what.split()[0]}\b", lines[k])), len(lines) - 1) + 1
            out.append(("vba", what.split()[0], m[2], m[2], " ".join(line.split()), "\n".join(note) or None, i, end))
        note = [*note, line.strip()[1:].strip()] if line.strip().startswith("'") else []
    return out


# The kinds of each brace language.
KINDS = {
    "javascript": ("function", "class", "method"), "typescript": ("function", "class", "method", "interface", "enum"), "go": ("function", "method", "type"), "rust": ("function", "method", "struct", "enum", "trait"),
    "java": ("class", "interface", "enum", "method"), "c": ("function", "struct", "enum", "type"), "cpp": ("function", "method", "class", "struct", "enum", "namespace"),
    "csharp": ("class", "interface", "struct", "enum", "method", "property", "namespace"),
}
_SAME = {"union": "struct", "record": "class"}
_HIDDEN = {lang: re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|" + (r"'(?:\\.|[^'\\\n])'" if lang == "rust" else r"'(?:\\.|[^'\\\n])*'") + (r"|`(?:\\.|[^`\\])*`" if lang in ("javascript", "typescript", "go") else "") + (r"|^[ \t]*#[^\n]*" if lang in ("c", "cpp", "csharp") else ""), re.S | re.M) for lang in KINDS}
_TYPE = re.compile(r"\b(class|struct|union|interface|trait|enum|namespace|record)\s+(?:class\s+|struct\s+)?(?:\w+\s+final\s+)?([A-Za-z_][\w.:]*)(?:\s*<[^{}]*?>)?(?:\s*\([^{}]*\))?([^;{}()=]*)\Z", re.S)
_FUNCTION = {
    "javascript": re.compile(r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^{}]*>)?\([^{}]*\Z", re.S),
    "go": re.compile(r"\bfunc\s+(\([^()]*\)\s*)?([A-Za-z_]\w*)\s*(?:\[[^\]{}]*\]\s*)?\([^{}]*\Z", re.S),
    "rust": re.compile(r"\bfn\s+([A-Za-z_]\w*)[^{};]*\Z", re.S),
    "c": re.compile(r"(~?[A-Za-z_][\w:~]*)\s*\((?:[^;{}()]|\([^;{}()]*\))*\)\s*(?:(?:const|noexcept|override|final|volatile)\b\s*|throws\s+[\w., ]+|->[^{};]*|:[^{};]*|where\s[^{};]*)*\Z", re.S),
}
_FUNCTION["typescript"] = _FUNCTION["javascript"]
_FUNCTION["cpp"] = _FUNCTION["java"] = _FUNCTION["csharp"] = _FUNCTION["c"]
_METHOD = re.compile(r"(?:^|[\s}])(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+|\*\s*)*(#?[A-Za-z_$][\w$]*)\s*(?:<[^{}]*>)?\((?:[^;{}()]|\([^;{}()]*\))*\)\s*(?::[^{};=]*)?\Z", re.S)
_GO_TYPE = re.compile(r"^[ \t]*type\s+([A-Za-z_]\w*)\b(?!\s*\()[^\n{};]*\Z", re.M)
_NO_NAME = {"if", "for", "while", "switch", "return", "catch", "else", "sizeof", "foreach", "using", "lock", "synchronized", "do", "try", "new", "throw", "with", "match", "loop", "function", "super", "this"}


def _head(lang: str, head: str, scope: str | None, body: str) -> tuple[str, str, int] | None:
    """(kind, name, where the name lies in the head) of what a head in front of a brace declares."""
    within = scope in ("class", "struct", "interface", "trait", "enum")
    if lang == "go":
        if m := _GO_TYPE.search(head):
            return "type", m[1], m.start(1)
    elif (m := _TYPE.search(head)) and not (lang == "c" and "(" in m[3]):
        kind = _SAME.get(m[1], m[1])
        if kind in KINDS[lang] and scope != "function":
            return kind, m[2].replace("::", "."), m.start(2)
    m = _FUNCTION[lang].search(head)
    if m and lang == "go":
        return ("method" if m[1] else "function"), m[2], m.start(2)
    if m and lang in ("javascript", "typescript", "rust"):
        return ("method" if within else "function"), m[1], m.start(1)
    if lang in ("javascript", "typescript"):
        m = _METHOD.search(head) if scope == "class" else None
        return ("method", m[1], m.start(1)) if m and m[1] not in _NO_NAME else None
    if m and lang in ("c", "cpp", "java", "csharp") and scope not in ("function", "method", "property", "other"):
        name = m[1].split("::")[-1]
        before = head[: m.start(1)].rstrip()
        if name not in _NO_NAME and not before.endswith((".", "=", "new", ",", "(")) and (lang in ("c", "cpp") or within):
            return ("method" if within or lang in ("java", "csharp") else "function"), m[1].replace("::", "."), m.start(1)
    if lang == "csharp" and within and (m := re.search(r"[\w>\]?]\s+([A-Za-z_]\w*)\s*\Z", head)) and re.match(r"\s*(?:\w+\s+)?(?:get|set|init)\b", body):
        return "property", m[1], m.start(1)
    return None


def _bodyless(lang: str, head: str, scope: str | None) -> tuple[str, str, int] | None:
    """What a statement without braces declares: methods of interfaces, expression bodies, unit structs, aliases, a namespace of a file."""
    within = scope in ("class", "struct", "interface", "enum")
    if lang == "rust" and (m := re.search(r"\b(struct)\s+([A-Za-z_]\w*)", head)):
        return "struct", m[2], m.start(2)
    if lang == "c" and (m := re.search(r"\btypedef\b.*?(?:\(\s*\*\s*(\w+)\s*\)\s*\([^;]*\)|([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)*)\Z", head, re.S)):
        return "type", m[1] or m[2], m.start(1) if m[1] else m.start(2)
    if lang == "csharp" and (m := re.match(r"\s*namespace\s+([\w.]+)\s*\Z", head)):
        return "namespace", m[1], m.start(1)
    if lang in ("java", "csharp") and within:
        call, arrow, _ = head.partition("=>")
        if "=" not in call and (m := re.search(r"[\w>\]?]\s+([A-Za-z_]\w*)\s*(?:<[^<>]*>)?\((?:[^()]|\([^()]*\))*\)\s*(?:throws\s+[\w., ]+)?\Z", call, re.S)):
            return "method", m[1], m.start(1)
        if lang == "csharp" and arrow and (m := re.search(r"[\w>\]?]\s+([A-Za-z_]\w*)\s*\Z", call)):
            return "property", m[1], m.start(1)
    return None


def brace_symbols(text: str, lang: str) -> list[tuple]:
    """Symbols of a brace language: comments and strings are blanked, each brace opens a scope that the head before it names. An open
    scope ends with the text. The docstring is the comment right above."""
    if lang not in KINDS:
        return []
    blank = _HIDDEN[lang].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect.bisect_right(lines, at)
    out: list[list] = []
    scopes: list[tuple[str, str, int]] = []  # kind, qualified name, number of its symbol or -1
    last, typedef = 0, False

    def declare(found: tuple[str, str, int], begin: int, end: int) -> tuple[str, str, int]:
        kind, name, at = found
        start = max(begin + len(blank[begin:end]) - len(blank[begin:end].lstrip()), lines[line(begin + at) - 1])
        above = text[: lines[line(start) - 1]]
        note = re.search(r"(?:^[ \t]*//[^\n]*\n)+\Z|/\*(?:(?!\*/).)*\*/[ \t]*\n\Z", above, re.M | re.S)
        doc = "\n".join(x for x in (re.sub(r"^\s*(?:/{2,}!?|/\*+|\*+/|\*)?\s?|\s*\*+/\s*$", "", part).strip() for part in note[0].splitlines()) if x) if note else None
        parent = scopes[-1][1] if scopes else ""
        out.append([lang, kind, name.split(".")[-1] if kind != "namespace" else name, f"{parent}.{name}" if parent else name, " ".join(text[start:end].split()), doc or None, line(start), line(end)])
        return kind, out[-1][3], len(out) - 1

    for m in re.finditer("[{};]", blank):
        at = m.start()
        head = blank[last:at]
        scope = scopes[-1][0] if scopes else None
        if lang == "go":  # an alias has neither brace nor semicolon
            *done, head_line = head.split("\n")
            base = last
            for part in done:
                if scope is None and (g := _GO_TYPE.search(part)):
                    declare(("type", g[1], g.start(1)), base, base + len(part))
                base += len(part) + 1
        if m[0] == "{":
            found = _head(lang, head, scope, blank[at + 1 : at + 80])
            if found:
                scopes.append(declare(found, last, at))
            else:  # blocks of a function and of unnamed things; what stands in an impl or extern block stands where the block does
                inner = scope if scope is None or re.search(r"\b(?:impl|extern|mod)\b", head) else "other"
                scopes.append((inner or ("other" if lang not in ("rust", "c", "cpp") or re.search(r"[=)]\s*\Z", head) else None), scopes[-1][1] if scopes else "", -1))
        elif m[0] == "}":
            if scopes:
                number = scopes.pop()[2]
                if number >= 0:
                    out[number][7] = line(at)
        elif not typedef and (found := _bodyless(lang, head, scope)):
            declare(found, last, at)
        elif typedef and not scopes and (g := re.search(r"([A-Za-z_]\w*)\s*\Z", head)):
            declare(("type", g[1], g.start(1)), last, at)
        if m[0] == "{" and lang == "c" and re.match(r"\s*typedef\b", head):
            typedef = True
        elif m[0] == ";" and not scopes:
            typedef = False
        last = at + 1
    return [tuple(x) for x in out]


def symbols_of(text: str, lang: str | None) -> list[tuple]:
    if lang == "python":
        return python_symbols(text)
    if lang == "vba":
        return vba_symbols(text)
    return brace_symbols(text, lang) if lang else []


def parse_symbols(files: DataFrame) -> DataFrame:
    """files(key, language, text) to one row of SCHEMA for each symbol."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(k, *s) for k, lang, t in zip(pdf["key"], pdf["language"], pdf["text"]) if t for s in symbols_of(t, lang)]
            yield pd.DataFrame(rows, columns=["key", "language", "kind", "name", "qualname", "signature", "docstring", "start_line", "end_line"])

    ship(files.sparkSession)
    return files.select(F.col("key").cast("bigint").alias("key"), "language", "text").mapInPandas(run, SCHEMA)


# Kinds that are called (a sub is VBA's function) and kinds that are made; others only count by kind.
GROUPS = {"callable": ("function", "method", "sub"), "type": ("class", "struct", "interface", "trait", "enum")}


def style(symbols: DataFrame) -> DataFrame:
    """AG28, AG29: for each language: symbols and their number by kind; for callables and, with the prefix type_, for types: number, commonest naming (the first
    name of ties), its share, number by naming, share with docstring; of callables the share with a declared return type (null without a rule for the
    language), mean and median length; methods per type (0 without types). A group without symbols has nulls beside its number."""
    group = F.when(F.col("kind").isin(*GROUPS["callable"]), "callable").when(F.col("kind").isin(*GROUPS["type"]), "type")
    s = symbols.withColumn("group", group).withColumn("naming", T.name_convention(F.col("name"))).withColumn("lines", F.col("end_line") - F.col("start_line") + 1)
    as_map = lambda k: F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, "k"))))  # noqa: E731 (one entry for each kind or naming)
    kinds = s.groupBy("language", "kind").agg(F.count("*").alias("k")).groupBy("language").agg(F.sum("k").alias("symbols"), as_map("kind").alias("kinds"))
    called, made = F.col("group") == "callable", F.col("group") == "type"
    documented = F.when(F.coalesce("docstring", F.lit("")) != "", 1.0).otherwise(0.0)
    annotated = T.has_return_annotation(F.coalesce("signature", F.lit("")), F.col("language")).cast("int")
    methods = F.count(F.when(F.col("kind") == "method", 1))
    lines = F.when(called, F.col("lines"))
    g = s.groupBy("language").agg(
        F.count(F.when(called, 1)).alias("functions"), F.round(F.avg(F.when(called, documented)), 4).alias("documented"), F.round(F.avg(F.when(called, annotated)), 4).alias("annotated"),
        F.round(F.avg(lines), 4).alias("mean_lines"), F.percentile(lines, 0.5).alias("median_lines"),
        F.count(F.when(made, 1)).alias("types"), F.round(F.avg(F.when(made, documented)), 4).alias("type_documented"), F.coalesce(F.round(F.try_divide(methods, F.count(F.when(made, 1))), 4), F.lit(0.0)).alias("methods_per_type"),
    )
    n = s.where("group IS NOT NULL").groupBy("language", "group", "naming").agg(F.count("*").alias("k"))
    n = n.groupBy("language", "group").agg(F.min_by("naming", F.struct(-F.col("k"), "naming")).alias("naming"), F.round(F.max("k") / F.sum("k"), 4).alias("naming_share"), as_map("naming").alias("namings"))
    fields = ("naming", "naming_share", "namings")
    of = lambda which, prefix: n.where(F.col("group") == which).select("language", *(F.col(c).alias(prefix + c) for c in fields))
    x = g.join(kinds, "language").join(of("callable", ""), "language", "left").join(of("type", "type_"), "language", "left")
    return x.select(
        "language", "symbols", "kinds", "functions", "naming", "naming_share", "namings", "documented", "annotated", "mean_lines", "median_lines",
        "types", "type_naming", "type_naming_share", "type_namings", "type_documented", "methods_per_type",
    )
