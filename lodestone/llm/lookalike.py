"""Visually identical text with different characters: one form for all, by SQL that DuckDB runs inside
Arrow partitions.

The form: marks without ink go; every blank becomes a space; full-width forms, ligatures, letters that
are one glyph with a Latin one, and compatibility singletons become the plain character; the result is
composed (NFC). What a reader can see stays: case, accents, super- and subscripts, dashes of different
length, line breaks. Blanks at the end of a line cannot be seen and go. Null texts have a null form, a null id pairs with
nothing, texts that are equal as stored are no pair.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.pairs import expand
from lodestone.session import cut, ship, table

# Letters that share their glyph with another, in pairs.
CYRILLIC = "АA ВB ЕE КK МM НH ОO РP СC ТT ХX ЅS ІI ЈJ ԚQ ԜW ѴV ҮY ӀI ЁË ЇÏ аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv ӏl ёë їï ӕæ ӔÆ әə ӘƏ"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϜF ͿJ οo ϲc ϳj ϹC"
CHEROKEE = "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᏔW ᏃZ"
OTHER = "μµ ‐- ‑- ․. ‧· ⋅· ・· ꞏ· օo ՕO ſs ɡg ǃ! ꞉: ։: ∶: ∕/ ⁄/ ʼ’"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "℃": "°C", "℉": "°F", "ŀ": "l·", "Ŀ": "L·"}
BLANKS = "\t\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u2800\u3000\u3164\uffa0"
BREAKS = "\r\u2028\u2029"
#: Ranges of code points whose compatibility decomposition looks the same: digraphs, Roman numerals, radicals, wide and narrow forms.
SAME_LOOK = ((0x132, 0x134), (0x1C4, 0x1CD), (0x1F1, 0x1F4), (0x2160, 0x2180), (0x2F00, 0x2FD6), (0xFB13, 0xFB18), (0xFF01, 0xFFA0), (0xFFA1, 0xFFDD), (0xFFE0, 0xFFE7))


def decomposed() -> dict[str, str]:
    """The characters of SAME_LOOK and what they stand for. A macron as a character of its own has a blank in its decomposition and is left."""
    out = {}
    for first, after in SAME_LOOK:
        for c in map(chr, range(first, after)):
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and " " not in plain:
                out[c] = plain
    return out


#: Code points without ink, as ranges of a character class.
INKLESS = r"\x{00}-\x{08}\x{0E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}"


def mapping() -> tuple[str, str]:
    """The two sides of translate(): from and to, of equal length."""
    pairs = [(p[0], p[1]) for group in (CYRILLIC, GREEK, CHEROKEE, OTHER) for p in group.split()]
    pairs += [(c, plain) for c, plain in decomposed().items() if len(plain) == 1]
    pairs += [(b, " ") for b in BLANKS] + [(b, "\n") for b in BREAKS]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def form_sql(column: str) -> str:
    """The SQL expression of the form. What is to be replaced is looked for first, and plain ASCII skips all but the blanks."""
    a, b = map(_quoted, mapping())
    long = LIGATURES | {c: plain for c, plain in decomposed().items() if len(plain) > 1}
    inked = f"regexp_replace(replace({column}, chr(13) || chr(10), chr(10)), '[{INKLESS}]', '', 'g')"
    y = f"translate(nfc_normalize({inked}), {a}, {b})"
    for one, several in long.items():
        y = f"replace({y}, '{one}', {_quoted(several)})"
    touched = "".join(chr(c) for c in sorted({*map(ord, mapping()[0]), *map(ord, long)}) if c > 127)
    x = f"CASE WHEN regexp_matches({column}, '[{''.join(long)}]') THEN nfc_normalize({y}) WHEN regexp_matches({column}, '[{touched}\\t\\x0b\\x0c\\r]') THEN nfc_normalize(translate(nfc_normalize({inked}), {a}, {b})) ELSE nfc_normalize({inked}) END"
    x = f"CASE WHEN strlen({column}) = length({column}) THEN translate({inked}, chr(9) || chr(11) || chr(12) || chr(13), '   ' || chr(10)) ELSE {x} END"
    return f"rtrim(CASE WHEN contains({x}, ' ' || chr(10)) THEN regexp_replace({x}, ' +\\n', chr(10), 'g') ELSE {x} END, ' ')"


def in_duckdb(df: DataFrame, sql: str, schema: str) -> DataFrame:
    """Run ``sql`` over the view ``batch`` for each Arrow batch of each partition; one thread, bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        for b in batches:
            if b.num_rows:
                con.register("batch", pa.Table.from_batches([b]))
                yield from con.sql(sql).to_arrow_table().to_batches()
                con.unregister("batch")
        con.close()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def one_form(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, form, changed. Null text gives a null form; text of blanks only gives the empty form."""
    sql = f"SELECT key AS \"{key}\", form, form <> text AS changed FROM (SELECT key, text, {form_sql('text')} AS form FROM batch)"
    return in_duckdb(df.select(F.col(key).alias("key"), F.col(text).alias("text")), sql, f"`{key}` bigint, form string, changed boolean")


def form_hashes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, form (MD5 of the form), raw (MD5 of the text as stored), for texts whose form isn't empty."""
    sql = f"SELECT key AS \"{key}\", md5(form) AS form, md5(text) AS raw FROM (SELECT key, text, {form_sql('text')} AS form FROM batch) WHERE form <> ''"
    src = df.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return in_duckdb(src, sql, f"`{key}` bigint, form string, raw string")


def lookalike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_a < doc_b whose texts differ as stored and share one form. A form takes part only if it has two or more stored texts, found by a
    count with partial aggregation; different texts meet once, and are spread to their documents in parts of bounded size."""
    hashes = cut(form_hashes(df, key, text))  # read several times below
    mixed = hashes.groupBy("form").agg((F.min("raw") != F.max("raw")).alias("mixed")).where("mixed").select("form")
    of = hashes.join(mixed, "form", "left_semi")
    texts = of.select("form", "raw").distinct()  # copies are one here
    a, b = (texts.select("form", F.col("raw").alias(f"raw_{x}")) for x in "ab")
    pairs = a.join(b, "form").where("raw_a < raw_b").select("raw_a", "raw_b")
    every = expand(of.select("raw", key).distinct(), pairs, ["raw"], [key])
    return every.select(F.least(f"{key}_a", f"{key}_b").alias("doc_a"), F.greatest(f"{key}_a", f"{key}_b").alias("doc_b")).where("doc_a < doc_b").distinct()


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike_pairs(table(spark, sf, "documents"))


def p9_form(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text in the one form."""
    return one_form(table(spark, sf, "documents"))


def p9_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document with a text: the class of documents that look the same (its smallest id), its size."""
    h = cut(form_hashes(table(spark, sf, "documents")))
    c = h.groupBy("form").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.count_distinct("raw").alias("stored_texts"))
    return h.join(c, "form").select("doc_id", "class_id", "class_size", "stored_texts")


QUERIES = {"p9_found": p9_found, "p9_form": p9_form, "p9_classes": p9_classes}
_FORMS = f"f AS (SELECT doc_id, text, {form_sql('text')} AS form FROM documents WHERE text <> '')"
SQL = {
    "p9_found": f"WITH {_FORMS} SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id WHERE a.text <> b.text AND a.form <> ''",
    "p9_classes": f"WITH {_FORMS}, c AS (SELECT form, min(doc_id) AS class_id, count(*) AS class_size, count(DISTINCT text) AS stored_texts FROM f WHERE form <> '' GROUP BY form) SELECT doc_id, class_id, class_size, stored_texts FROM f JOIN c USING (form)",
    "p9_form": f"SELECT doc_id, form, form <> text AS changed FROM (SELECT doc_id, text, {form_sql('text')} AS form FROM documents)",
}
