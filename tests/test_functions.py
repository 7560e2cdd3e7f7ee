import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import registry
from lodestone.functions import text as T
from lodestone.operators import reports as R


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("r")).first()["r"]


@pytest.mark.parametrize(("pattern", "path", "ok"), [("**/*.html", "a.html", True), ("**/*.html", "x/y/a.html", True), ("*.html", "x/a.html", False), ("a/**", "a/b/c", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("a.b", "axb", False), ("**/x/**/y.md", "x/y.md", True)])
def test_glob(pattern, path, ok):
    assert bool(re.search(T.glob_regex(pattern), path)) is ok


@pytest.mark.parametrize(("pattern", "bad"), [("(a+)+$", True), ("(a|b)*c", False), ("((ab)*c)*", True), ("[0-9]+x", False), (r"\(a+\)+", False)])
def test_risky(pattern, bad):
    assert T.risky(pattern) is bad


def test_rules_skip_bad_patterns(spark):
    rules = [("(", "broken"), ("(x+)+", "risky"), ("never|nie", "stop"), (".*", "any")]
    assert one(spark, "NEVER open", lambda c: T.first_rule(c, rules)) == "stop"
    assert one(spark, None, lambda c: T.first_rule(c, rules)) is None
    assert one(spark, "[GOTCHA] x", T.tagged) == "[GOTCHA] x"


@pytest.mark.parametrize(("name", "kind"), [("MAX_SIZE", "SCREAMING_SNAKE"), ("a_b1", "snake_case"), ("a_B", "mixed"), ("FooBar", "PascalCase"), ("fooBar", "camelCase"), ("_x", "snake_case"), ("9x", "other")])
def test_naming(spark, name, kind):
    assert one(spark, name, T.name_convention) == kind


def test_key_values(spark):
    assert one(spark, "A=1, B = two ,bad,=x,A=3, C=a=b", T.key_values) == {"A": "3", "B": "two", "C": "a=b"}


def test_citations(spark):
    got = one(spark, "x [GK] y [D:1#2] [D:x#2] z [D:10#20].", T.citations)
    assert [(c["kind"], c["doc_id"], c["chunk_id"]) for c in got] == [("gk", None, None), ("doc", 1, 2), ("doc", 10, 20)]
    assert one(spark, "See [D:1#2] , and [GK] .", T.strip_citations) == "See, and."


def test_small_ones(spark):
    assert one(spark, "a\n\tb  c ", T.clean) == "a b c"
    assert one(spark, "x" * 200, T.snippet) == "x" * 180 + " …"
    assert one(spark, "Figure 3: The chuck", T.clean_caption) == "The chuck"
    assert one(spark, "=1+1", T.sheet_cell) == "'=1+1"
    assert one(spark, "Über den Wolken!", T.slug) == "ber-den-wolken"
    assert one(spark, "???", T.slug) == "untitled"
    assert one(spark, "not json", T.audience) == []
    assert one(spark, '["a","b"]', T.audience) == ["a", "b"]
    assert one(spark, "b A b é", T.query_terms) == ["b", "a", "é"]
    assert one(spark, "one two three four relay six", lambda c: T.snippet_around(c, F.array(F.lit("relay")), 3)) == "… four relay six"


@pytest.mark.parametrize("v", [0.0, 1.5, 100000.0, 1e6, 1234567.0, 1e-5, 0.0001, -2.25, 1e300, float("inf"), 1.204505])
def test_general_format(spark, v):
    assert one(spark, v, R.general, "double") == f"{v:g}"


def test_registry(spark):
    registry.register(" Twice ", "bigint")(lambda s: s * 2)
    assert one(spark, 4, lambda c: registry.call("twice", c), "bigint") == 8
    embed = registry.embedder(lambda texts: [[float(len(t)), 0.0] for t in texts])
    rows = spark.createDataFrame([("abc",), (None,), ("",)], "t string").select(embed(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in rows] == [[1.0, 0.0], None, [0.0, 0.0]]
    p = registry.add_profile(registry.Profile("Spec", instrument=r"for (\w+)", restricts="only"))
    assert registry.profile("SPEC") is p
    f = spark.createDataFrame([("Manual for X9", "only here")], "t string, x string").select(p.facts(F.col("t"), F.col("x")).alias("f")).first()["f"]
    assert (f["instrument"], f["restricts"], f["excludes"]) == ("X9", True, None)
    registry.install_table_functions(spark)
    got = spark.sql("SELECT * FROM code_symbols('python', 'def f(x):\n    return x')").collect()
    assert [(r["kind"], r["name"]) for r in got] == [("function", "f")]
    v = spark.createDataFrame([("m", 3), ("m", 3)], "model string, dim int")
    assert registry.one_model(v) == ("m", 3) and registry.one_model(v.limit(0)) is None
    with pytest.raises(ValueError):
        registry.one_model(v.union(spark.createDataFrame([("n", 3)], "model string, dim int")))


def test_expiry(spark):
    import datetime as d

    df = spark.createDataFrame([(d.datetime(2024, 1, 1, 11, 0),), (d.datetime(2024, 1, 1, 12, 0),), (d.datetime(2024, 1, 1, 13, 0),)], "t timestamp")
    got = [r[0] for r in df.select(R.expires_at(F.col("t"), 0)).collect()]
    assert got == [d.datetime(2024, 1, 2), d.datetime(2024, 1, 2), d.datetime(2024, 1, 3)]
    assert df.select(R.expires_at(F.col("t"), -1)).first()[0] is None
