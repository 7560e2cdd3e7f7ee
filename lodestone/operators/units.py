"""Quantities recorded in different units: parse unit strings, settle ambiguities, convert to common units.

A unit string is segmented by dynamic programming over tries: positions of the string are nodes, and the
entries of the tries of prefixes, roots and exponents, signs of products, quotients and square roots, plus written factors
(``1E-3``, ``x10^-6``, ``* 1000``), are edges between states. Dimensions are vectors over the SI base units, so that ``V/A`` is a
resistance; a dimension without a name is named by its base units. All complete segmentations are kept with a score
(exact spelling beats another case). What stays open ("C", "F", "MA") is settled by priors of the field: how its stem's
unambiguous units share out over dimensions, and which order of magnitude its values have. "NA" is nanoampere in a field
of currents and says nothing elsewhere.

A missing unit (null, blank, "-", "n/a", ...) falls back as the caller says; a string that no segmentation
covers has a reading without quantity: its values stay as recorded, and it is listed by ``unread``. Null and non-finite
values convert to null. Units of temperature have offsets, which differences (``V/°C``) don't use; dBm and dBV are logarithmic.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.session import cut, ship

# Names and sizes of the prefixes.
PREFIX_SYMBOLS = {"f": -15, "p": -12, "n": -9, "u": -6, "μ": -6, "m": -3, "c": -2, "d": -1, "k": 3, "M": 6, "G": 9, "T": 12}
PREFIX_WORDS = {"femto": -15, "pico": -12, "nano": -9, "micro": -6, "milli": -3, "centi": -2, "deci": -1, "kilo": 3, "mega": 6, "giga": 9, "tera": 12}
# Spelling, quantity, factor and offset to the base unit, takes prefixes, is a word.
ROOTS = [
    ("V", "voltage", 1.0, 0.0, True, False), ("volt", "voltage", 1.0, 0.0, True, True), ("volts", "voltage", 1.0, 0.0, True, True),
    ("A", "current", 1.0, 0.0, True, False), ("amp", "current", 1.0, 0.0, True, True), ("amps", "current", 1.0, 0.0, True, True),
    ("ampere", "current", 1.0, 0.0, True, True), ("amperes", "current", 1.0, 0.0, True, True),
    ("Hz", "frequency", 1.0, 0.0, True, False), ("hertz", "frequency", 1.0, 0.0, True, True),
    ("s", "time", 1.0, 0.0, True, False), ("sec", "time", 1.0, 0.0, True, True), ("secs", "time", 1.0, 0.0, True, True),
    ("second", "time", 1.0, 0.0, True, True), ("seconds", "time", 1.0, 0.0, True, True), ("min", "time", 60.0, 0.0, False, True),
    ("Ω", "resistance", 1.0, 0.0, True, False), ("Ohm", "resistance", 1.0, 0.0, True, True), ("ohms", "resistance", 1.0, 0.0, True, True),
    ("F", "capacitance", 1.0, 0.0, True, False), ("farad", "capacitance", 1.0, 0.0, True, True), ("farads", "capacitance", 1.0, 0.0, True, True),
    ("°C", "temperature", 1.0, 0.0, False, False), ("degC", "temperature", 1.0, 0.0, False, False), ("deg C", "temperature", 1.0, 0.0, False, False),
    ("C", "temperature", 1.0, 0.0, False, False), ("celsius", "temperature", 1.0, 0.0, False, True),
    ("K", "temperature", 1.0, -273.15, True, False), ("kelvin", "temperature", 1.0, -273.15, True, True), ("degK", "temperature", 1.0, -273.15, False, False),
    ("°F", "temperature", 5 / 9, -160 / 9, False, False), ("degF", "temperature", 5 / 9, -160 / 9, False, False), ("deg F", "temperature", 5 / 9, -160 / 9, False, False),
    ("F", "temperature", 5 / 9, -160 / 9, False, False), ("fahrenheit", "temperature", 5 / 9, -160 / 9, False, True),
    ("W", "power", 1.0, 0.0, True, False), ("watt", "power", 1.0, 0.0, True, True), ("watts", "power", 1.0, 0.0, True, True),
    ("dBm", "power", 10.0, -30.0, False, False), ("dBV", "voltage", 20.0, 0.0, False, False),
    ("%", "ratio", 1.0, 0.0, False, False), ("pct", "ratio", 1.0, 0.0, False, True), ("percent", "ratio", 1.0, 0.0, False, True),
    ("ratio", "ratio", 100.0, 0.0, False, True), ("frac", "ratio", 100.0, 0.0, False, True), ("fraction", "ratio", 100.0, 0.0, False, True),
    ("‰", "ratio", 0.1, 0.0, False, False), ("permille", "ratio", 0.1, 0.0, False, True), ("per mille", "ratio", 0.1, 0.0, False, True),
    ("ppm", "ratio", 1e-4, 0.0, False, False), ("ppb", "ratio", 1e-7, 0.0, False, False),
]
# More roots, spelled exactly so, with the powers of kg, m, s, A, K, mol, cd.
EXACT_ROOTS = [
    ("m", 1.0, (0, 1, 0, 0, 0, 0, 0)), ("g", 1e-3, (1, 0, 0, 0, 0, 0, 0)), ("h", 3600.0, (0, 0, 1, 0, 0, 0, 0)), ("mol", 1.0, (0, 0, 0, 0, 0, 1, 0)), ("cd", 1.0, (0, 0, 0, 0, 0, 0, 1)),
    ("Pa", 1.0, (1, -1, -2, 0, 0, 0, 0)), ("bar", 1e5, (1, -1, -2, 0, 0, 0, 0)), ("N", 1.0, (1, 1, -2, 0, 0, 0, 0)), ("J", 1.0, (1, 2, -2, 0, 0, 0, 0)), ("Wh", 3600.0, (1, 2, -2, 0, 0, 0, 0)),
    ("H", 1.0, (1, 2, -2, -2, 0, 0, 0)), ("T", 1.0, (1, 0, -2, -1, 0, 0, 0)), ("Wb", 1.0, (1, 2, -2, -1, 0, 0, 0)), ("Ah", 3600.0, (0, 0, 1, 1, 0, 0, 0)), ("rad", 1.0, (0, 0, 0, 0, 0, 0, 0)),
]
# The powers of kg, m, s, A, K, mol, cd of each quantity.
DIMENSIONS = {
    "voltage": (1, 2, -3, -1, 0, 0, 0), "current": (0, 0, 0, 1, 0, 0, 0), "frequency": (0, 0, -1, 0, 0, 0, 0), "time": (0, 0, 1, 0, 0, 0, 0), "resistance": (1, 2, -3, -2, 0, 0, 0),
    "capacitance": (-1, -2, 4, 2, 0, 0, 0), "temperature": (0, 0, 0, 0, 1, 0, 0), "power": (1, 2, -3, 0, 0, 0, 0), "ratio": (0, 0, 0, 0, 0, 0, 0),
    "length": (0, 1, 0, 0, 0, 0, 0), "mass": (1, 0, 0, 0, 0, 0, 0), "pressure": (1, -1, -2, 0, 0, 0, 0), "force": (1, 1, -2, 0, 0, 0, 0), "energy": (1, 2, -2, 0, 0, 0, 0),
    "inductance": (1, 2, -2, -2, 0, 0, 0), "charge": (0, 0, 1, 1, 0, 0, 0), "flux density": (1, 0, -2, -1, 0, 0, 0), "magnetic flux": (1, 2, -2, -1, 0, 0, 0),
}
BASES = ("kg", "m", "s", "A", "K", "mol", "cd")
NAMES = {v: k for k, v in DIMENSIONS.items()}
#: Logarithmic units by what a step of a factor of ten is.
LOGARITHMIC = {"dBm": 10.0, "dBV": 20.0}
EXPONENTS = {form: float(n) for n in (-4, -3, -2, -1, 1, 2, 3, 4) for form in (f"^{n}", f"**{n}", f"^({n})", str(n))} | {"^0.5": 0.5, "^1/2": 0.5, "^(1/2)": 0.5, "^-0.5": -0.5, "^-1/2": -0.5, "^(-1/2)": -0.5}
SIGNS = {"/": -1, " / ": -1, " per ": -1, "*": 1, " * ": 1, "·": 1, " · ": 1, "⋅": 1, "×": 1, " x ": 1, ".": 1, " ": 1}
HALVES = {"√": "", "rt": "", "rt(": ")", "√(": ")", "sqrt(": ")", "sqrt ": ""}
MISSING = ("", "-", "--", "n/a", "n.a.", "none", "null", "nan", "?", "unknown")
#: A spelling that means "not available" or, in fields of that quantity, a unit.
OPEN = {"na": ("nA", "current")}
_FRONT = re.compile(r"(?:[x×*·]\s*)?(?:10\s*\^\s*([+-]?\d+)|(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?))(?:\s*[x×*·])?\s+|(?:[x×*·]\s*)?(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*[x×*·]\s*")
_BACK = re.compile(r"\s*[x×*·]\s*(?:10\s*\^\s*([+-]?\d+)|(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?))$")


def _trie(entries: list[tuple[str, object]]) -> dict:
    root: dict = {}
    for spelling, payload in entries:
        node = root
        for ch in spelling.lower():
            node = node.setdefault(ch, {})
        node.setdefault(None, []).append((spelling, payload))
    return root


PREFIXES = _trie([(s, (e, False)) for s, e in PREFIX_SYMBOLS.items()] + [(s, (e, True)) for s, e in PREFIX_WORDS.items()])
ROOT_TRIE = _trie([(r[0], r) for r in ROOTS])
EXACT_TRIE = _trie([(r[0], r) for r in EXACT_ROOTS])
EXPONENT_TRIE = _trie(list(EXPONENTS.items()))
SIGN_TRIE = _trie(list(SIGNS.items()))
HALF_TRIE = _trie(list(HALVES.items()))


def _walk(trie: dict, text: str, at: int) -> Iterator[tuple[int, str, object]]:
    """Entries of the trie that start at a position: (position after, spelling, payload)."""
    node = trie
    for i in range(at, len(text)):
        node = node.get(text[i].lower())
        if node is None:
            return
        for spelling, payload in node.get(None, ()):
            yield i + 1, spelling, payload


#: Raised figures, which normalisation would turn into plain ones.
_RAISED = re.compile("[⁰¹²³⁴⁵⁶⁷⁸⁹⁻]+")


@lru_cache(maxsize=20_000)
def segment(text: str) -> tuple[tuple[str, float, float, bool, float], ...]:
    """All readings of a unit string: (quantity, factor, offset, logarithmic, score), best score first; one for each
    distinct meaning."""
    s = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", _RAISED.sub(lambda m: "^" + unicodedata.normalize("NFKC", m[0]).replace("\u2212", "-"), text))).strip().replace("μ", "μ").replace("µ", "μ").replace("Ω", "Ω").replace("º", "°").replace("° ", "°")
    factor = 1.0
    if s[:2] != "1/":
        if m := _BACK.search(s):
            factor, s = 10.0 ** int(m[1]) if m[1] else float(m[2]), s[: m.start()].strip()
        elif m := _FRONT.match(s):
            factor, s = 10.0 ** int(m[1]) if m[1] else float(m[2] or m[3]), s[m.end() :].strip()
    # nodes: (position, stage) with the ways there; stages: 0 before a factor of the product, 1 prefix, 2 root, 3 exponent
    start = _Way(0.0, factor, (0.0,) * 7, None, 0, 1, "")
    table: dict[tuple[int, int], list[_Way]] = {(0, 0): [start]}
    if s[:2] == "1/":
        table[(2, 0)] = [start._replace(sign=-1)]

    def reach(at: int, stage: int, way: _Way) -> None:
        ways = table.setdefault((at, stage), [])
        if len(ways) < 200:  # far more than a string of this length has
            ways.append(way)

    for at in range(len(s) + 1):
        for way in table.get((at, 0), ()):
            for end, spelling, (e, w) in _walk(PREFIXES, s, at):
                reach(end, 1, way._replace(score=way.score - (0.5 if s[at:end] == spelling or w else 2.0), ten=e, word=w))
            for end, _, close in _walk(HALF_TRIE, s, at):
                if way.power == 1.0:
                    reach(end, 0, way._replace(power=0.5, close=close, score=way.score - 0.1))
        for stage in (0, 1):
            for way in table.get((at, stage), ()):
                for end, spelling, r in _walk(ROOT_TRIE, s, at):
                    if stage == 0 or r[4]:
                        cost = (0.0 if s[at:end] == spelling else 0.2 if r[5] else 1.0) + (0.3 if stage == 1 and way.word != r[5] else 0.0)
                        reach(end, 2, way._replace(score=way.score - cost, root=r))
                for end, spelling, (name, f, dims) in _walk(EXACT_TRIE, s, at):
                    if s[at:end] == spelling:
                        reach(end, 2, way._replace(score=way.score, root=(name, NAMES.get(dims), f, 0.0, True, False)))
        for way in table.get((at, 2), ()):
            for end, _, p in _walk(EXPONENT_TRIE, s, at):
                reach(end, 3, way._replace(power=way.power * p))
        for stage in (2, 3):
            for way in table.get((at, stage), ()):
                done = way.closed()
                if way.close and s[at : at + 1] == way.close:
                    reach(at + 1, 3, way._replace(close=""))
                elif not way.close and done is not None:
                    for end, _, sign in _walk(SIGN_TRIE, s, at):
                        reach(end, 0, done._replace(sign=sign, score=done.score - 0.3))
    best: dict[tuple, float] = {}
    for stage in (2, 3):
        for way in table.get((len(s), stage), ()):
            if not way.close and (meaning := way.meaning()):
                best[meaning] = max(best.get(meaning, -math.inf), way.score)
    return tuple((*k, v) for k, v in sorted(best.items(), key=lambda kv: (-kv[1], kv[0])))


class _Way(NamedTuple):
    """A way to a node: what the closed factors of the product make (factor, dims, how many), and the open one (prefix, root, power, sign)."""

    score: float
    factor: float
    dims: tuple[float, ...]
    root: tuple | None
    ten: int
    sign: int
    close: str
    power: float = 1.0
    word: bool | None = None
    factors: int = 0

    def closed(self) -> _Way | None:
        """With the open factor multiplied in, as a difference where its unit has an offset. A logarithmic unit takes part in no product."""
        name, quantity, f, _, _, _ = self.root
        if name in LOGARITHMIC:
            return None
        dims = DIMENSIONS[quantity] if quantity else next(r[2] for r in EXACT_ROOTS if r[0] == name)
        p = self.power * self.sign
        f = (f / 100 if quantity == "ratio" and name != "rad" else f) * 10.0**self.ten
        return _Way(self.score, self.factor * f**p, tuple(a + p * b for a, b in zip(self.dims, dims)), None, 0, 1, "", factors=self.factors + 1)

    def meaning(self) -> tuple[str, float, float, bool] | None:
        """(quantity, factor, offset, logarithmic) against the base unit of the quantity; for ratios this is percent."""
        name, quantity, f, offset, _, _ = self.root
        if name in LOGARITHMIC:
            return (quantity, f, offset, True) if self.factors == 0 and self.power * self.sign == 1 and self.factor == 1 else None
        if self.factors == 0 and self.power * self.sign == 1 and quantity and name != "rad":
            return quantity, float(f"{f * 10.0**self.ten * self.factor:.14g}"), offset, False
        done = self.closed()
        quantity = NAMES.get(done.dims)
        if quantity is None:
            quantity = " ".join(b if p == 1 else f"{b}^{p:g}" for b, p in zip(BASES, done.dims) if p)
        return quantity, float(f"{done.factor * (100 if quantity == 'ratio' else 1):.14g}"), 0.0, False


def stated(c: Column) -> Column:
    """The text of a unit column, null where it says nothing."""
    t = F.trim(F.regexp_replace(c, r"[\s ]+", " "))
    return F.when(~F.lower(t).isin(*MISSING), t)


def from_name(name: Column) -> Column:
    """A unit given in a field's name: ``x [mV]``, ``x (mV)``, ``x / mV``, ``x in mV``, ``x_mV``; a pin number may follow. Null without one."""
    forms = (r"\[([^\]\[]*[^\]\[\d][^\]\[]*)\](?:\[\d+\])?$", r"\(([^()]+)\)(?:\[\d+\])?$", r" / ((?:1/)?[^/\[]+?)(?:\[\d+\])?$", r" in ([^\[]+?)(?:\[\d+\])?$", r"_((?:1/)?[^_\d\[\]() /][^_\[\]()/]*?)(?:\[\d+\])?$")
    return F.coalesce(*(stated(F.nullif(F.regexp_extract(name, f, 1), F.lit(""))) for f in forms))


def stem(name: Column) -> Column:
    """The field without pin, unit and running number."""
    x = F.regexp_replace(name, r"\[\d+\]$", "")
    return F.lower(F.regexp_replace(x, r"_\d+(?:[ _].*)?$|\s+(?:\[|\(|/|in ).*$", ""))


def readings(pairs: DataFrame) -> DataFrame:
    """One reading for each (unit, stem): quantity, factor, offset, is_log. ``pairs``: unit, stem, n (rows), size (a typical
    absolute value, or null). A unit that can't be read has a row with a null quantity, one of OPEN that means nothing in its field has none.
    Works on distinct pairs only."""

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for r in pdf.itertuples(index=False):
                got = segment(r.unit) or ((None, None, None, False, 0.0),)
                rows += [(r.unit, r.stem, r.n, r.size, len(got), len({g[0] for g in got}), *g) for g in got]
            yield pd.DataFrame(rows, columns=["unit", "stem", "n", "size", "readings", "quantities", "quantity", "factor", "offset", "is_log", "score"])

    ship(pairs.sparkSession)
    c = pairs.mapInPandas(parse, "unit string, stem string, n bigint, size double, readings int, quantities int, quantity string, factor double, offset double, is_log boolean, score double")
    log_size = F.when((F.col("size") > 0) & ~F.col("is_log"), F.log10(F.col("size") * F.col("factor")))
    sure = c.where("quantities = 1 AND score > -1 AND quantity IS NOT NULL").dropDuplicates(["unit", "stem"])
    prior = sure.groupBy("stem", "quantity").agg(F.sum("n").alias("votes"))
    total = sure.groupBy("stem").agg(F.sum("n").alias("total"))
    scale = c.where("readings = 1 AND offset = 0").groupBy("stem").agg((F.sum(log_size * F.col("n")) / F.sum(F.when(log_size.isNotNull(), F.col("n")))).alias("usual"))
    unsure = F.lit(False)
    for spelling, (exact, quantity) in OPEN.items():
        unsure |= (F.lower("unit") == spelling) & (F.col("unit") != exact) & ((F.col("quantity") != quantity) | F.coalesce(F.col("votes") <= F.col("total") / 2, F.lit(True)))
    c = c.join(prior, ["stem", "quantity"], "left").join(total, "stem", "left").join(scale, "stem", "left").where(~unsure)
    belief = F.log((F.coalesce("votes", F.lit(0)) + 0.1) / (F.coalesce("total", F.lit(0)) + 0.9)) * 0.5
    away = F.coalesce(F.abs(log_size - F.col("usual")), F.lit(0.0)) * 0.5
    w = Window.partitionBy("unit", "stem").orderBy(F.desc(F.col("score") + belief - away), "quantity", "factor", "offset")
    return c.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("unit", "stem", "quantity", "factor", "offset", "is_log")


def attach(rows: DataFrame, small: DataFrame, keys: list[str], n: int, limit: int = 50_000, salts: int = 16) -> DataFrame:
    """Left join of a fact table with a table of one row per key: broadcast if it has at most ``limit`` rows, else by salted
    keys, so that a hot key spreads over tasks. Keys aren't null."""
    if n <= limit:
        return rows.join(F.broadcast(small), keys, "left")
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(spread, [*keys, "__salt"], "left").drop("__salt")


READING = ("quantity", "factor", "offset", "is_log")


def to_common(value: Column) -> Column:
    """The value in the common unit, by the columns of READING; a row without reading is in the common unit already, one with an unreadable unit stays as recorded."""
    v = F.when(F.col("is_log"), F.pow(F.lit(10.0), (value + F.col("offset")) / F.col("factor"))).otherwise(value * F.col("factor") + F.col("offset"))
    return F.when(F.col("factor").isNull(), value).otherwise(v)


def differs(tolerance: float = 1e-9) -> Column:
    """The row's unit or scale isn't the common one."""
    return F.coalesce(F.col("is_log") | (F.abs(F.col("factor") - 1) > tolerance) | (F.col("offset") != 0), F.lit(False))


def unread(read: DataFrame) -> DataFrame:
    """kind, unit: the distinct stated units that no segmentation covers, out of ``read_fields``."""
    return read.where("quantity IS NULL").select("kind", "unit").distinct()


def rebase(spark: SparkSession, read: DataFrame, targets: DataFrame) -> DataFrame:
    """Readings against the base units -> against the units of ``targets`` (quantity, common_unit: a row for each quantity, collected)."""
    rows = []
    for q, u in targets.where("quantity IS NOT NULL AND common_unit IS NOT NULL").select("quantity", "common_unit").distinct().collect():
        own = [g for g in segment(u) if g[0] == q and not g[3]]
        if own:
            rows.append((q, own[0][1], own[0][2]))
    t = spark.createDataFrame(rows, "quantity string, tf double, to double")
    r = read.join(F.broadcast(t), "quantity", "left")
    f, o = F.coalesce("tf", F.lit(1.0)), F.coalesce("to", F.lit(0.0))
    return r.select("unit", "stem", "quantity", F.when(F.col("is_log"), F.col("factor")).otherwise(F.col("factor") / f).alias("factor"), F.when(F.col("is_log"), F.col("offset")).otherwise((F.col("offset") - o) / f).alias("offset"), "is_log")


RAW = ("u", "cu", "name")


def raw_fields(id_: Column, units: Column, conditions: Column, name: Column, *rest: Column) -> tuple[Column, ...]:
    """The columns that decide a row's unit, as they are: u, cu, name; never null, so that they join."""
    cu = F.when(F.contains(F.coalesce(conditions, F.lit("")), F.lit('"UNITS"')), F.get_json_object(conditions, "$.UNITS"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return (id_.alias("id"), blank(units).alias("u"), blank(cu).alias("cu"), blank(name).alias("name"), *rest)


def read_fields(spark: SparkSession, fields: list[tuple[str, DataFrame]], targets: DataFrame) -> tuple[DataFrame, int]:
    """(readings by kind and RAW columns with a number ``code``, how many) of tables with the RAW columns and ``value``; ``kind`` keeps the stems of tables apart.

    Facts are only counted by their distinct RAW strings; all parsing is done on these."""
    both = None
    for kind, f in fields:
        one = f.select(F.lit(kind).alias("kind"), *RAW, F.abs("value").alias("v"))
        both = one if both is None else both.unionByName(one)
    log = F.when((F.col("v") > 0) & (F.col("v") < float("inf")), F.log10("v"))
    combos = both.groupBy("kind", *RAW).agg(F.count("*").alias("n"), F.sum(log).alias("s"), F.count(log).alias("k"))
    said = [stated(F.col("u")), stated(F.col("cu")), from_name(F.col("name"))]
    # what a spelling of OPEN hides counts where that means nothing
    sure = [F.when(~F.lower(x).isin(*OPEN), x) for x in said]
    stem_ = F.concat_ws(":", "kind", stem(F.col("name"))).alias("stem")
    combos = combos.select("kind", *RAW, "n", "s", "k", F.coalesce(*said).alias("unit"), F.coalesce(*said[:2]).isNull().alias("named"), F.coalesce(*sure).alias("other"), F.coalesce(*sure[:2]).isNull().alias("other_named"), stem_).where("unit IS NOT NULL")
    combos = cut(combos.withColumn("other", F.when(F.col("other") != F.col("unit"), F.col("other"))))
    pairs = combos.groupBy("unit", "stem").agg(F.sum("n").alias("n"), F.pow(F.lit(10.0), F.try_divide(F.sum("s"), F.sum("k").cast("double"))).alias("size"))
    hidden = combos.where("other IS NOT NULL").select(F.col("other").alias("unit"), "stem").distinct().join(pairs, ["unit", "stem"], "left_anti")
    got = cut(rebase(spark, readings(pairs.unionByName(hidden.select("unit", "stem", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("size")))), targets))
    second = combos.join(got, ["unit", "stem"], "left_anti").where("other IS NOT NULL").select("kind", *RAW, F.col("other").alias("unit"), "stem", F.col("other_named").alias("named"))
    read = combos.select("kind", *RAW, "unit", "stem", "named").unionByName(second).join(got, ["unit", "stem"])
    read = read.where("quantity IS NOT NULL OR NOT named")  # the end of a name is a unit only if it can be read
    read = cut(read.select("kind", *RAW, "unit", F.monotonically_increasing_id().alias("code"), *READING))  # the codes are fixed by being written
    return read, read.count()
