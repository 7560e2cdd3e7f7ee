import pytest

from lodestone.llm import lookalike as L

SAME = [("Ｆｕｌｌ　ｗｉｄｔｈ！", "Full width!"), ("café", "café"), ("a​b­c﻿", "abc"), ("a b c", "a b c"), ("Рау сосоа", "Pay cocoa"), ("ﬁx ﬂy", "fix fly"), ("5 kΩ", "5 kΩ"), ("3 µA", "3 μA"), ("20 ℃", "20 °C"), ("end  \nx", "end\nx"), ("a\r\nb", "a\nb"), ("е́té", "été"), ("￡5 ￥", "£5 ¥"), ("Ⅱ Ⅻ ⅳ", "II XII iv"), ("faﬅ", "fast"), ("ĳs", "ijs"), ("a⠀bㅤc", "a b c"), ("ѵ Ѵ ɡ Ꭺ", "v V g A"), ("x\u2028y", "x\ny"), ("ｶﾞ", "ガ"), ("na\u0308h", "näh"), ("ë", "ё"), ("a\tb ü", "a b ü")]
DIFFERENT = [("Case", "case"), ("m²", "m2"), ("a–b", "a-b"), ("resume", "résumé"), ("a  b", "a b"), ("a\nb", "a b"), ("x1", "x2"), ("ß", "ss"), ("x…", "x..."), ("№ 1", "No 1"), ("™", "TM"), ("½", "1/2"), ("￣", " \u0304")]


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS form", "1 AS key", "2 AS raw")
    return [r["form"] for r in L.one_form(df).orderBy("doc_id").collect()]


def test_forms(spark):
    a = forms(spark, [x for x, _ in SAME])
    b = forms(spark, [y for _, y in SAME])
    assert a == b
    a = forms(spark, [x for x, _ in DIFFERENT])
    b = forms(spark, [y for _, y in DIFFERENT])
    assert all(x != y for x, y in zip(a, b))


def test_form_is_idempotent_and_null_safe(spark):
    texts = [x for pair in SAME + DIFFERENT for x in pair] + [None, "", "  ", "​"]
    once = forms(spark, texts)
    assert forms(spark, once) == once
    assert once[-4:] == [None, "", "", ""]


def test_pairs(spark):
    rows = [(1, "Test text"), (2, "Теѕt text"), (3, "Test text"), (4, "test text"), (5, None), (6, ""), (7, "​"), (8, " "), (9, "x" * 100_000), (10, "x" * 100_000), (11, "х" + "x" * 99_999), (None, "Test text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_a"], r["doc_b"]) for r in L.lookalike_pairs(df).collect()}
    assert got == {(1, 2), (2, 3), (9, 11), (10, 11)}


def test_hot_copies_make_no_pairs(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "'the same text' AS text")
    assert L.lookalike_pairs(df).count() == 0
    assert L.lookalike_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("c", ["'", '"', "\\", "\x00"])
def test_quotes(spark, c):
    assert forms(spark, [f"a{c}b"]) == ["ab" if c == "\x00" else f"a{c}b"]


def test_hot_forms_of_two_spellings_spread_over_tasks(spark, monkeypatch):
    from lodestone.llm import pairs as Q

    monkeypatch.setattr(Q.expand, "__defaults__", (7,))
    rows = [(i, "one text" if i % 3 else "\u043ene text") for i in range(60)] + [(100, "other"), (101, "\u043ether"), (102, "\u043eth\u0435r")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_a"], r["doc_b"]) for r in L.lookalike_pairs(df).collect()]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x != y and (a < 60) == (b < 60)}
    assert len(got) == len(set(got)) and set(got) == want
