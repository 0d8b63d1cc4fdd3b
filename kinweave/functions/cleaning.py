"""Column harmonisation in a fixed order, as one projection."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnClean:
    """What is done to one column; the result replaces it, or is named ``cleaned_name``."""

    name: str
    cleaned_name: str | None = None
    trim: bool = False
    invalid_values: Sequence[str] = ()
    empty_to_null: bool = False
    remove_characters: str | Sequence[str] = ""
    strip_accents: bool = False
    case: str | None = None
    truncate: int | None = None
    cast: str | None = None

    def __post_init__(self):
        if self.case not in (None, "upper", "lower", "title"):
            raise ValueError(f"{self.name}: case is upper, lower or title")
        if self.truncate is not None and self.truncate <= 0:
            raise ValueError(f"{self.name}: truncate must be positive")
        object.__setattr__(self, "cleaned_name", self.cleaned_name or self.name)


@lru_cache
def _accents() -> tuple[str, str]:
    """Precomposed letters of the Latin, Greek and Cyrillic blocks and their base letters, by the decomposition rule."""
    pairs = []
    for i in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(i)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(i):
            pairs.append((chr(i), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@F.pandas_udf(T.StringType())
def _nfkd(values: pd.Series) -> pd.Series:
    def plain(v):
        return None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))

    return values.map(plain)


def strip_accents(c: Column, exact: bool = False) -> Column:
    """Without combining marks. The default is a translation inside the JVM for letters of
    the common scripts; ``exact`` applies full compatibility decomposition in Arrow batches."""
    if exact:
        return _nfkd(c)
    old, new = _accents()
    return F.regexp_replace(F.translate(c, old, new), r"\p{M}", "")


def cleaned(c: Column, spec: ColumnClean) -> Column:
    """The expression of one column."""
    if spec.trim:
        c = F.trim(c)
    if spec.invalid_values:
        c = F.when(~c.isin(list(spec.invalid_values)) | c.isNull(), c)
    if spec.empty_to_null:
        c = F.when(c != "", c)
    if spec.remove_characters:
        c = F.translate(c, "".join(spec.remove_characters), "")
    if spec.strip_accents:
        c = strip_accents(c)
    if spec.case:
        c = {"upper": F.upper, "lower": F.lower, "title": F.initcap}[spec.case](c)
    if spec.truncate:
        c = F.substring(c, 1, spec.truncate)
    if spec.cast:
        c = c.try_cast(spec.cast)
    return c


def clean(df: DataFrame, specs: Sequence[ColumnClean]) -> DataFrame:
    """Apply the configurations in order; several may follow on one column."""
    expressions, names = {c: F.col(f"`{c}`") for c in df.columns}, list(df.columns)
    for spec in specs:
        if spec.name not in expressions:
            raise ValueError(f"no column {spec.name!r}")
        if spec.cleaned_name != spec.name and spec.cleaned_name in expressions:
            raise ValueError(f"{spec.name!r} can't be renamed to {spec.cleaned_name!r}, a column that is there")
        value = cleaned(expressions.pop(spec.name), spec)
        expressions[spec.cleaned_name] = value
        names[names.index(spec.name)] = spec.cleaned_name
    return df.select(*(expressions[n].alias(n) for n in names))
