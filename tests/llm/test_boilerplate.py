import random

from lodestone.llm import boilerplate as B


def page(n, rng, host="a"):
    topics = ["Setup", "Wiring", "Cleaning the chuck", "Timing", "Results of run"]
    body = "".join(f"<p>Reading {rng.randrange(999)} of the {rng.choice(topics).lower()} settles after {rng.randrange(99)} ms in case {n}.</p>\n" for _ in range(rng.randrange(2, 6)))
    side = "".join(f"<div class='sb'>{rng.choice(['- ', '› ', ''])}{rng.choice(topics)}</div>\n" for _ in range(3))
    return f"""<html><head><title>x</title><style>.a{{}}</style></head><body><nav>Home | Docs | {rng.choice(['Forum', 'Search'])}</nav>
<div class="crumb">Docs › {rng.choice(topics)} › {rng.choice(topics)}</div>
<main><h2>{rng.choice(topics)}</h2><p>Home the arm before cookies are set in reg {n}.</p><p>Warning: hot.</p>
<div class="ck">We use cookies to {rng.choice(['count visits', 'keep your language', 'be fast'])}. {rng.choice(['Read more.', 'You agree.'])}</div>
<div class="sb">Related topics</div>
{side}{body}<footer>Changed {rng.randrange(28)}.{rng.randrange(12)}.2020 · Page {n}</footer></main></body></html>"""


def lines_of(html):
    got = B.labelled_lines(html)
    return "\n".join(t for *_, t in got), [i for i, x in enumerate(got) if x[2]]


def test_held_out_pages(spark):
    rng = random.Random(4)
    pages = [(f"h{i % 2}", i, page(i, rng)) for i in range(80)]
    train = spark.createDataFrame(pages[:50] + [("h9", 99, None), (None, None, "")], "host string, key long, html string")
    c = B.fit(train).compiled()
    tp = fp = fn = 0
    for _, _, html in pages[50:]:
        text, want = lines_of(html)
        got = set(c.frame(text))
        tp, fp, fn = tp + len(got & set(want)), fp + len(got - set(want)), fn + len(set(want) - got)
    assert tp / (tp + fp) > 0.98 and tp / (tp + fn) > 0.95


def test_article_lines_stay():
    rng = random.Random(5)
    rows = []
    for i in range(40):
        rows += [("h", *x, 1) for x in B.labelled_lines(page(i, rng))]
    c = B.Wrapper([(h, s, p, f, t, n) for h, s, p, f, t, n in rows]).compiled()
    text = "Setup\nHome the arm before cookies are set in reg 7.\nWarning: hot.\n- a list item that ends here.\n› Timing"
    assert c.frame(text) == []
    assert c.frame("› Timing\n- Setup\nIt ends here.\n› Timing") == [0, 1]
    assert c.frame("Related topics\nSetup\nSetup runs for 3 ms and then stops.") == [0, 1]
    assert c.frame("\n\n  \n") == []


def _frame(spark, chunks, docs, pages):
    return B.frame_lines(
        spark.createDataFrame(chunks, "id long, document_id long, text string, label string"),
        spark.createDataFrame(docs, "doc_id long, fmt string, source string, text string"),
        spark.createDataFrame(pages, "document_id long, url string, html string"),
    )


def test_only_html_and_odd_rows(spark):
    rng = random.Random(6)
    pages = [(i, "https://h.example/x", page(i, rng)) for i in range(30)] + [(None, None, None), (5, "", "")]
    text = "Home | Docs | Forum\nReading one.\nChanged 1.2.2020 · Page 3"
    chunks = [(1, 1, text, "x"), (1, 1, text, "x"), (2, 2, text, "x"), (3, 3, None, None), (4, 1, "", None), (None, 1, text, None), (5, None, text, None), (6, 1, "long " * 200_000, None)]
    docs = [(1, "text/HTML", "h", "t"), (2, "pdf", "h", "t"), (3, "htm", None, None)]
    got = {(r["id"], r["line_no"]) for r in _frame(spark, chunks, docs, pages).collect()}
    assert got == {(1, 0), (1, 2)}


def test_empty(spark):
    assert _frame(spark, [], [], []).count() == 0
    assert _frame(spark, [(1, 1, "Home", None)], [(1, "html", "h", "t")], []).count() == 0


def test_formats(spark):
    from pyspark.sql import functions as F

    names = ["html", "HTM", ".html", "text/html", "xhtml", "application/xhtml+xml", "md", "pdf", None, "htmlx", "csv"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    assert [bool(r[0]) for r in df.select(B.is_html(F.col("f"))).collect()] == [True] * 6 + [False] * 5


def test_long_lines():
    notice = " ".join(f"word{'abcdefghij'[i % 10]} of the terms" for i in range(60))  # 1,000 characters and more
    lines = [("h", "div.legal", 0, True, notice, 2), ("h", "div.legal", 0, True, "Only one page says so", 1), ("h", "div.side", 0, True, "Legal notice of Alpha , last seen in May .", 1), ("h", "div.side", 0, True, "Legal notice of Beta , last seen in June .", 1), ("h", "", 0, False, "Legal matters.", 1)]
    c = B.Wrapper(lines).compiled()
    far = "Legal notice of " + "Gamma and Sons " * 60 + ", last seen in July ."
    assert c.frame(f"{notice}\n{notice[:-1]}\n{notice} more\n{far}\n{far} Or not") == [0, 3]
    assert c.frame(" ".join(notice.split()[:36])) == []
    assert c.frame("Only one page says so") == []


def test_pieces_equal_the_expression():
    import re

    rng = random.Random(8)
    for _ in range(3000):
        t = ("a", *(rng.choice(["a", "b", "#", ".", B.SLOT, B.OPTION]) for _ in range(rng.randrange(1, 7))))
        line = "a" + "".join(rng.choice(["a", "b", "1", "22", ".", " "]) for _ in range(rng.randrange(9)))
        line = " ".join(line.split())
        assert B.fits(B.pieces(t), line) == bool(re.fullmatch(B.expression(t), line, re.I | re.S)), (t, line)


def test_lines_of_inferred_expressions_are_not_kept_verbatim():
    rng = random.Random(9)
    rows = [("h", *x, 1) for i in range(40) for x in B.labelled_lines(page(i, rng))]
    w = B.Wrapper(rows)
    inferred = [B.pieces(t) for t in w.templates if B.SLOT in t or B.OPTION in t]
    assert inferred and not [t for t in w.templates if B.SLOT not in t and B.OPTION not in t and any(B.fits(p, " ".join(t).replace("#", "0")) for p in inferred)]


def test_every_page_counts(spark):
    name = lambda i: "x" + "".join("abcdefghij"[int(d)] for d in str(i))
    pages = [("h", i, f"<nav>{name(i // 2)} menu</nav><main><p>Text of the case.</p></main>") for i in range(4_300)]
    got = B.fit(spark.createDataFrame(pages, "host string, key long, html string"))
    assert got.templates == sorted((name(i), "menu") for i in range(2_150))


def test_fit_equals_the_wrapper_of_all_lines(spark):
    import re
    from collections import defaultdict

    rng = random.Random(11)
    pages = [(f"h{i % 3}", i, page(i, rng)) for i in range(60)] + [("h0", 60, "<nav>- </nav><nav>Once only</nav><p>-</p><p>· </p>")]
    shown = defaultdict(set)
    for host, key, html in pages:
        for sig, pos, frame, text in B.labelled_lines(html):
            shown[(host, sig, pos, frame, re.sub("[0-9]+", "0", text))].add(key)
    want = B.Wrapper([(*x, len(keys)) for x, keys in shown.items()])
    got = B.fit(spark.createDataFrame(pages, "host string, key long, html string"))
    assert got.titles and got.items and (got.templates, got.titles, got.items, got.item_words) == (want.templates, want.titles, want.items, want.item_words)
