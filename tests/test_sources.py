import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.sources import code, documents, stdf, tables


def test_html():
    d = documents.extract_html(
        "<title> T  x </title><nav>menu</nav><main><h1>A</h1><p>one <b>two</b><br>x</p><h2>B</h2><div>run <i>it</i><p>leaf</p>tail</div><pre>  c\n  d</pre>"
        "<table><caption>Cap</caption><tr><th>h1<th>h2</tr><tr><td>1</td><td>2</td></tr><tr><td> </td></tr></table><h1>C</h1><figure><img src='a.png' alt='pic'><figcaption>Fig</figcaption></figure><a href='x.html#y'>go</a></main><footer>f</footer>",
        "main", ["nav", "footer"],
    )
    assert d.title == "T x" and d.matched
    got = [(s["kind"], s["heading_path"], s["text"]) for s in d.segments]
    assert got[:5] == [("body", "A", "one two x"), ("body", "A > B", "run it"), ("body", "A > B", "leaf"), ("body", "A > B", "tail"), ("code", "A > B", "  c\n  d")]
    assert got[5] == ("body", "A > B", "Cap\nh1 | h2\n1 | 2")
    assert got[6:] == [("body", "C", "Fig"), ("body", "C", "go")]
    assert d.links == [{"target": "x.html#y", "anchor": "go", "heading_path": "C"}]
    assert d.images[0]["src"] == "a.png" and d.images[0]["caption"] == "Fig"
    assert not documents.extract_html("<p>x</p>", "#none").matched


def test_markdown():
    d = documents.extract_md("---\na: 1\n---\n# Title #\npara [l](u.md) ![p](i.png)\nmore\n\n```\ncode\n\nx\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n## Sub\nend")
    assert d.title == "Title"
    assert [(s["kind"], s["heading_path"], s["text"]) for s in d.segments] == [("body", "Title", "para l p more"), ("code", "Title", "code\n\nx"), ("body", "Title", "a | b\n1 | 2"), ("body", "Title > Sub", "end")]
    assert documents.strip_front_matter("---\nopen\ntext") == "---\nopen\ntext"


def zipped(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return b.getvalue()


W = 'xmlns:w="urn:w" xmlns:a="urn:a" xmlns:p="urn:p" xmlns:r="urn:r"'


def test_office():
    docx = zipped({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    d = documents.extract(docx, ".DOCX")
    assert d.title == "Head" and [(s["heading_path"], s["text"]) for s in d.segments] == [("Head", "Body text"), ("Head", "a | b")]
    sp = lambda kind, text: f'<p:sp><p:nvPr>{kind}</p:nvPr><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:sp>'
    pptx = zipped({"ppt/slides/slide1.xml": f"<p:sld {W}>" + sp('<p:ph type="title"/>', "Intro") + sp("", "Point") + "</p:sld>", "ppt/notesSlides/notesSlide1.xml": f"<p:n {W}><a:t>say this</a:t></p:n>"})
    d = documents.extract(pptx, "pptx")
    assert [(s["heading_path"], s["text"]) for s in d.segments] == [("Slide 1: Intro", "Point"), ("Slide 1: Intro > Speaker notes", "say this")]
    xlsx = zipped({"xl/workbook.xml": '<wb><sheets><sheet name="S1"/></sheets></wb>', "xl/sharedStrings.xml": "<sst><si><t>x</t></si></sst>", "xl/worksheets/sheet1.xml": '<ws><row><c r="B2" t="s"><v>0</v></c><c r="C2"><v>5</v></c></row><row><c r="B3"><v>7</v></c></row><mergeCells><mergeCell ref="B3:C3"/></mergeCells></ws>'})
    d = documents.extract(xlsx, "xlsx")
    assert [(s["heading_path"], s["text"]) for s in d.segments] == [("S1", "x | 5\n7 | 7")]


def test_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.html").write_text("<h1>T</h1><p>x</p>")
    (tmp_path / "a" / "b" / "y.md").write_text("# M\ny")
    (tmp_path / "z.pdf").write_bytes(b"%PDF")
    (tmp_path / "q.docx").write_bytes(b"no zip")
    files = documents.listing(spark, str(tmp_path))
    assert {r["path"]: r["class"] for r in documents.classified(files, ["**/*.html", "**/*.md"], ["a/b/**"]).collect()} == {"a/x.html": "included", "a/b/y.md": "excluded", "z.pdf": "other", "q.docx": "other"}
    got = {r["path"]: (r["title"], r["error"]) for r in documents.extract_all(files).collect()}
    assert got["a/x.html"] == ("T", None) and got["a/b/y.md"] == ("M", None)
    assert "PDF" in got["z.pdf"][1] and got["q.docx"][1]
    assert all(len(r[0]) == 64 for r in files.select(documents.content_hash(F.col("content"))).collect())


def test_data_uri(spark):
    df = spark.createDataFrame([("data:image/jpeg;base64,QUJD",), ("data:image/png;base64,Q?JD",), ("data:text/plain;base64,QUJD",), (None,), ("x.png",)], "u string")
    ext, body = documents.data_uri(F.col("u"))
    assert [(r[0], bytes(r[1]) if r[1] else None) for r in df.select(ext, body).collect()] == [("jpg", b"ABC"), (None, None), (None, None), (None, None), (None, None)]


def rec(kind, sub, body):
    return struct.pack("<HBB", len(body), kind, sub) + body


def text(s):
    return bytes([len(s)]) + s.encode()


def log():
    far = rec(0, 10, bytes([2, 4]))
    mir = rec(1, 10, bytes(15) + text("LOT7"))
    pir = rec(5, 10, bytes([1, 0]))
    dtr = rec(50, 30, text("COND: T=25"))
    ptr = rec(15, 10, struct.pack("<IBBBBf", 7, 1, 0, 0, 0, 1.5) + text("Vref") + text("") + bytes([0, 0, 0, 0]) + struct.pack("<ff", 1.0, 2.0) + text("V"))
    short = rec(15, 10, struct.pack("<IBBBBf", 7, 1, 0, 0x80, 0, 2.5))
    ftr = rec(15, 20, struct.pack("<IBBB", 9, 1, 0, 0))
    mpr = rec(15, 15, struct.pack("<IBBBBHH", 11, 1, 0, 0, 0, 2, 2) + bytes([0]) + struct.pack("<ff", 3.0, 4.0) + text("Pins") + text("") + bytes(4) + struct.pack("<ff", 0.0, 9.0) + bytes(8) + struct.pack("<HH", 5, 6) + text("A"))
    prr = rec(5, 20, struct.pack("<BBBHHHhhI", 1, 0, 8, 4, 2, 3, -32768, 5, 77) + text("P1"))
    return far + mir + rec(99, 1, b"skip") + pir + dtr + ptr + short + ftr + mpr + prr


def test_stdf(spark):
    rows = list(stdf.records(log()))
    assert [r["rec_type"] for r in rows] == ["MIR", "PIR", "DTR", "PTR", "PTR", "FTR", "MPR", "MPR", "PRR"]
    assert (rows[3]["result"], rows[3]["test_txt"], rows[3]["lo"], rows[3]["hi"], rows[3]["units"]) == (1.5, "Vref", 1.0, 2.0, "V")
    assert rows[4]["test_txt"] is None and rows[4]["test_flg"] & 0x80 and rows[5]["result"] is None
    assert [(r["test_txt"], r["pin"], r["result"]) for r in rows[6:8]] == [("Pins[5]", 5, 3.0), ("Pins[6]", 6, 4.0)]
    assert (rows[8]["x"], rows[8]["y"], rows[8]["part_id"], rows[8]["test_time_ms"]) == (None, 5, "P1", 77)
    df = spark.createDataFrame([("a.std", bytearray(log())), ("b.std", bytearray(b"\x00"))], "path string, content binary")
    got = stdf.parse(df)
    assert got.count() == 9 and got.where("rec_type = 'MIR'").first()["lot"] == "LOT7"
    from lodestone.operators import conditions as C

    named = got.withColumnRenamed("path", "run")
    assert C.sticky_conditions(named).orderBy("ord").first()["cond"] == {"T": "25"}
    assert {r["part"] for r in C.assign_parts(named).where("rec_type = 'PTR'").collect()} == {"P1"}


def test_code(spark):
    py = 'class A:\n    """Doc."""\n    def m(self) -> int:\n        return 1\n\nasync def f(a,\n      b):\n    pass\n'
    got = [(s[1], s[3], s[4], s[5], s[6], s[7]) for s in code.python_symbols(py)]
    assert got == [("class", "A", "class A", "Doc.", 1, 4), ("method", "A.m", "def m(self) -> int", None, 3, 4), ("function", "f", "async def f(a, b)", None, 6, 8)]
    assert code.python_symbols("def (") == []
    vba = "' Adds.\nPublic Function Add(a, b)\n  Add = a\nEnd Function\nSub S()\nEnd Sub"
    assert [(s[1], s[2], s[5], s[6], s[7]) for s in code.vba_symbols(vba)] == [("function", "Add", "Adds.", 2, 4), ("sub", "S", None, 5, 6)]
    c = "// does it\nstatic int f(int a) {\n  if (a) { return 1; }\n  return 0;\n}\n"
    assert [(s[2], s[5], s[6], s[7]) for s in code.brace_symbols(c, "c")] == [("f", "does it", 2, 5)]
    df = spark.createDataFrame([(1, "python", py), (2, "c", c), (3, None, "x"), (4, "python", None)], "key long, language string, text string")
    s = code.parse_symbols(df)
    assert s.count() == 4
    style = {r["language"]: r for r in code.style(s).collect()}
    assert style["python"]["functions"] == 2 and style["python"]["annotated"] == 0.5


def test_style_has_types_kinds_and_unknown_annotations(spark):
    rows = [
        ("python", "class", "Alpha", "class Alpha", "doc", 1, 9), ("python", "class", "beta_b", "class beta_b", None, 1, 9), ("python", "class", "Gamma", "class Gamma", "", 1, 9), ("python", "method", "run_it", "def run_it() -> int", "doc", 1, 3),
        ("python", "method", "runIt", "def runIt()", None, 1, 5), ("python", "function", "go_on", "def go_on()", None, 1, 1), ("c", "function", "f", "int f(int a)", None, 1, 2), ("vba", "enum", "Rec", "Enum Rec", None, 1, 2), ("vba", "type", "T", "Type T", None, 1, 2),
    ]
    s = spark.createDataFrame(rows, "language string, kind string, name string, signature string, docstring string, start_line int, end_line int")
    got = {r["language"]: r.asDict() for r in code.style(s).collect()}
    py = got["python"]
    assert (py["symbols"], py["kinds"], py["functions"], py["types"], py["methods_per_type"]) == (6, {"class": 3, "method": 2, "function": 1}, 3, 3, 0.6667)
    assert (py["naming"], py["naming_share"], py["namings"], py["documented"], py["annotated"]) == ("snake_case", 0.6667, {"snake_case": 2, "camelCase": 1}, 0.3333, 0.3333)
    assert (py["type_naming"], py["type_naming_share"], py["type_namings"], py["type_documented"]) == ("PascalCase", 0.6667, {"PascalCase": 2, "snake_case": 1}, 0.3333)
    assert (py["mean_lines"], py["median_lines"]) == (3.0, 3.0)
    assert got["c"]["annotated"] is None and (got["c"]["types"], got["c"]["type_naming"], got["c"]["methods_per_type"]) == (0, None, 0.0)
    assert got["vba"]["kinds"] == {"enum": 1, "type": 1}
    assert (got["vba"]["functions"], got["vba"]["naming"], got["vba"]["types"], got["vba"]["type_naming"]) == (0, None, 1, "PascalCase")


@pytest.mark.parametrize(("name", "body", "kw"), [("t.csv", "\ufeffa,b,a\n1,x,2\n\n3,,4\n5\n", {}), ("t.tsv", "a\tb\ta\n1\tx\t2\n3\t\t4\n5\n", {}), ("t.txt", "a|b|a\n1|x|2\n3||4\n5\n", {"given": "pipe"})])
def test_tables(spark, tmp_path, name, body, kw):
    p = tmp_path / name
    p.write_text(body)
    df = tables.read_table(spark, str(p), **kw)
    assert df.columns == ["src_row", "a", "b", "a_2"]
    assert [tuple(r) for r in df.orderBy("src_row").collect()] == [(0, "1", "x", "2"), (1, "3", None, "4"), (2, "5", None, None)]
    d = tables.read_dataset(spark, str(p), **kw)
    assert {(r["name"], r["row_idx"], r["src_row"], r["value"]) for r in d.collect()} == {("a", 0, 0, 1.0), ("a", 1, 1, 3.0), ("a", 2, 2, 5.0), ("a_2", 0, 0, 2.0), ("a_2", 1, 1, 4.0)}


def test_fixed_width(spark, tmp_path):
    p = tmp_path / "f.txt"
    p.write_text("ab  cd  \n1   22  \n3   4\n")
    df = tables.read_table(spark, str(p), widths=[4, 4])
    assert [tuple(r) for r in df.orderBy("src_row").collect()] == [(0, "1", "22"), (1, "3", None)]


def test_stream(spark, tmp_path):
    from lodestone.streaming.ingest import event_yield, ingest

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("one")
    (src / "b.txt").write_text("two")
    known = spark.createDataFrame([], "path string, content_hash string")
    seen: list = []
    state = {"known": known}

    def sink(df):
        rows = df.select("path", "content_hash").collect()
        seen.extend(r["path"].rpartition("/")[2] for r in rows)
        state["known"] = state["known"].union(spark.createDataFrame([tuple(r) for r in rows], "path string, content_hash string")) if rows else state["known"]

    for extra in (None, "c.txt"):
        if extra:
            (src / extra).write_text("three")
        ingest(spark, str(src), lambda: state["known"], sink, str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(seen) == ["a.txt", "b.txt", "c.txt"]
    e = tmp_path / "events"
    spark.sql("SELECT timestamp'2024-01-01 01:00:00' AS ts, 'view' AS event_type UNION ALL SELECT timestamp'2024-01-01 02:00:00', 'error' UNION ALL SELECT timestamp'2024-01-09 02:00:00', 'view'").coalesce(1).write.parquet(str(e))
    q = event_yield(spark.readStream.schema("ts timestamp, event_type string").parquet(str(e))).writeStream.format("memory").queryName("y").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["n"], r["good"]) for r in spark.table("y").collect()) == [(1, 1), (2, 1)]


SOURCES = {
    "c":"// does it\nstatic int f(int a) {\n  if (a) { return 1; }\n  return 0;\n}\nstruct P { int x; };\ntypedef struct { int a; } Q;\ntypedef int num;\nenum E { A, B };\nint g(void);\nstruct P h(struct P p) {\n  return p;\n}\nstatic int t[] = { 1, 2 };\n",
    "cpp":"namespace n {\n/* Doc. */\nclass A : public B {\n public:\n  A() : x(1) {}\n  int m() const { for (;;) { } return 1; }\n};\nint A::z(int q) {\n  auto l = [](int a) { return a; };\n  return 0;\n}\nenum class C : int { X };\n}\n",
    "java":"package p;\n/** Doc. */\npublic class A<T> extends B {\n  @Override\n  public int m(int a) throws E {\n    if (a > 1) { x(); }\n    Runnable r = new Runnable() { public void run() { } };\n    return 1;\n  }\n  A(int x) { }\n  abstract void q();\n  enum K { ONE, TWO }\n}\ninterface I { void go(int a); }\n",
    "csharp":"namespace N.M;\npublic class A {\n  public int P { get; set; }\n  public string S => \"x;{\";\n  /// Adds.\n  public int Add(int a, int b) => a + b;\n  ~A() { }\n  void V<T>() where T : class { }\n}\npublic record R(int X);\nstruct T { }\n",
    "javascript":"// one\nfunction f(a) { return () => { g(); } }\nclass A extends B {\n  constructor(x) { super(x) }\n  async go() { if (x) { } }\n  static *gen() { }\n}\nfunction* h() { }\nconst k = (a) => { return a }\n",
    "typescript":"export interface I { a: number; }\nexport abstract class A<T> implements I {\n  private run(a: string): number { return 1 }\n}\nenum E { X }\nexport function f<T>(a: T): Promise<T> { return a }\n",
    "go":"package m\n// T is.\ntype T struct {\n  a int\n}\ntype N int\ntype I interface {\n  Do()\n}\nfunc F(a int) (int, error) {\n  if a > 1 {\n    return 1, nil\n  }\n  return 0, nil\n}\nfunc (t *T) M() { }\n",
    "rust":"/// Doc\npub struct A { x: i32 }\nstruct U;\nenum E { X(i32) }\ntrait T { fn a(&self); fn b(&self) -> i32 { 1 } }\nimpl T for A {\n  fn a(&self) { let c = '{'; match x { _ => {} } }\n}\npub fn f<'a>(x: &'a str) -> &'a str where X: Y { x }\n",
}
WANTED = {
    "c": "function f 2 5, struct P 6 6, type Q 7 7, type num 8 8, enum E 9 9, function h 11 13",
    "cpp": "namespace n 1 13, class n.A 3 7, method n.A.A 5 5, method n.A.m 6 6, function n.A.z 8 11, enum n.C 12 12",
    "java": "class A 3 13, method A.m 5 9, method A.A 10 10, method A.q 11 11, enum A.K 12 12, interface I 14 14, method I.go 14 14",
    "csharp": "namespace N.M 1 1, class A 2 9, property A.P 3 3, property A.S 4 4, method A.Add 6 6, method A.~A 7 7, struct T 11 11",
    "javascript": "function f 2 2, class A 3 7, method A.constructor 4 4, method A.go 5 5, method A.gen 6 6, function h 8 8",
    "typescript": "interface I 1 1, class A 2 4, method A.run 3 3, enum E 5 5, function f 6 6",
    "go": "type T 3 5, type N 6 6, type I 7 9, function F 10 15, method M 16 16",
    "rust": "struct A 2 2, struct U 3 3, enum E 4 4, trait T 5 5, method T.b 5 5, function a 7 7, function f 9 9",
}


@pytest.mark.parametrize("lang", sorted(SOURCES))
def test_symbols_of_brace_languages(lang):
    got = ", ".join(f"{s[1]} {s[3]} {s[6]} {s[7]}" for s in code.brace_symbols(SOURCES[lang], lang))
    assert got == WANTED[lang]
    for cut in range(0, len(SOURCES[lang]), 7):  # broken source gives what can be told, without failing
        code.brace_symbols(SOURCES[lang][:cut], lang)
    assert code.brace_symbols("", lang) == []
