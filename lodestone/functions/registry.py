"""Extension points: named vectorised functions and document profiles that callers register (UD01-UD08)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

_functions: dict[str, tuple[Callable, str]] = {}
_profiles: dict[str, Profile] = {}


def register(name: str, returns: str) -> Callable:
    """Register a function of pandas Series under a name of any case."""

    def keep(f: Callable) -> Callable:
        _functions[name.strip().lower()] = (f, returns)
        return f

    return keep


def call(name: str, *columns: Column) -> Column:
    f, returns = _functions[name.strip().lower()]
    return pandas_udf(f, returns)(*columns)


def embedder(model: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """UD02, TXT26: a column function that turns texts into vectors of length one by a model given by the caller; null stays null."""
    import numpy as np

    def embed(texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        at = [i for i, t in enumerate(texts) if t is not None]
        for i, v in zip(at, model([texts.iloc[i] for i in at]) if at else []):
            x = np.asarray(v, np.float64)
            n = np.linalg.norm(x)
            out[i] = (x / n if n else x).astype(np.float32)
        return pd.Series(out, index=texts.index, dtype="object")

    embed.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return pandas_udf(embed, "array<float>")


@dataclass(frozen=True)
class Profile:
    """TXT29: facts of a document from its title and text: regular expressions for the instrument, what it applies from and excludes, and restricting chunks."""

    name: str
    instrument: str | None = None
    applies_from: str | None = None
    excludes: str | None = None
    restricts: str | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for p in (self.instrument, self.applies_from, self.excludes, self.restricts):
            if p:
                re.compile(p)

    def facts(self, title: Column, text: Column) -> Column:
        both = F.concat_ws("\n", title, text)
        get = lambda p: F.nullif(F.regexp_extract(both, p, 1), F.lit("")) if p else F.lit(None).cast("string")
        return F.struct(get(self.instrument).alias("instrument"), get(self.applies_from).alias("applies_from"), get(self.excludes).alias("excludes"), (text.rlike(self.restricts) if self.restricts else F.lit(False)).alias("restricts"))


def add_profile(p: Profile) -> Profile:
    _profiles[p.name.strip().lower()] = p
    return p


def profile(name: str) -> Profile:
    return _profiles[name.strip().lower()]


def install_table_functions(spark: SparkSession) -> None:
    """UD08: ``code_symbols(language, text)`` as a table function of SQL."""
    from lodestone.sources.code import symbols_of

    @udtf(returnType="kind string, name string, start_line int, end_line int")
    class CodeSymbols:
        def eval(self, language: str, text: str):
            for s in symbols_of(text or "", language):
                yield s[1], s[2], s[6], s[7]

    spark.udtf.register("code_symbols", CodeSymbols)


def one_model(vectors: DataFrame) -> tuple[str, int] | None:
    """RK14, MS08: the model and dimension of a table of vectors; more than one is an error, none is None."""
    found = vectors.select("model", "dim").distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError("vectors of several models or dimensions can't be compared")
    return (found[0][0], int(found[0][1])) if found else None
