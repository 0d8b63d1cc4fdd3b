"""Text analysis: from a column to its index terms."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions.cleaning import strip_accents

# Portuguese words that the brazilian analyzer leaves out.
STOP_PT = (
    "a ainda alem ambas ambos antes ao aonde aos apos aquele aqueles as assim com como contra contudo cuja cujas cujo cujos da das de dela dele deles "
    "demais depois desde desta deste dispoe dispoem diversa diversas diversos do dos durante e ela elas ele eles em entao entre essa essas esse esses esta "
    "estas este estes ha isso isto logo mais mas mediante menos mesma mesmas mesmo mesmos na nas nao nem nesse neste nos o os ou outra outras outro outros "
    "pelas pelo pelos perante pois por porque portanto propria proprio quais qual qualquer quando quanto que quem quer se seja sem sendo seu seus sob sobre "
    "sua suas tal tambem teu teus toda todas todo todos tua tuas tudo um uma umas uns"
).split()
# Endings that the light stemmer removes, longest first.
ENDINGS_PT = ("amentos", "imentos", "amento", "imento", "adores", "idades", "mente", "acoes", "acao", "idade", "ador", "istas", "ismos", "ista", "ismo", "osos", "osas", "oso", "osa", "ais", "eis", "oes", "ns", "es", "s", "o", "a", "e")


def standard(c: Column) -> Column:
    """Lower-case runs of letters, marks and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1)


def simple(c: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+)"), 1)


def folding(c: Column) -> Column:
    """Standard terms without accents."""
    return standard(strip_accents(c))


def whitespace(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def keyword(c: Column) -> Column:
    return F.array(c)


def light_stem(word: str) -> str:
    for ending in ENDINGS_PT:
        if word.endswith(ending) and len(word) - len(ending) >= 3:
            return word[: -len(ending)]
    return word


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stemmed(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [light_stem(w) for w in ws])


def brazilian(c: Column) -> Column:
    """Folded terms without stop words, lightly stemmed: near to a full Portuguese stemmer, not equal."""
    return _stemmed(F.filter(folding(c), lambda w: ~w.isin(STOP_PT)))


ANALYZERS: dict[str, Callable[[Column], Column]] = {
    "standard": standard, "simple": simple, "folding": folding, "whitespace": whitespace, "keyword": keyword, "brazilian": brazilian,
}


def custom(definition: dict, analysis: dict) -> Callable[[Column], Column]:
    """An analyzer from char filters, a tokenizer and token filters of an index's settings."""

    def char_filter(c: Column, name: str) -> Column:
        spec = (analysis.get("char_filter") or {}).get(name, {})
        if name == "html_strip" or spec.get("type") == "html_strip":
            return F.regexp_replace(c, r"<[^>]*>", " ")
        if spec.get("type") == "pattern_replace":
            return F.regexp_replace(c, spec["pattern"], spec.get("replacement", ""))
        if spec.get("type") == "mapping":
            for line in spec.get("mappings", ()):
                old, new = (x.strip() for x in line.split("=>"))
                c = F.replace(c, F.lit(old), F.lit(new))
            return c
        raise ValueError(f"unknown char filter {name!r}")

    def token_filter(c: Column, name: str) -> Column:
        spec = (analysis.get("filter") or {}).get(name, {})
        kind = spec.get("type", name)
        if kind in ("lowercase", "uppercase"):
            return F.transform(c, F.lower if kind == "lowercase" else F.upper)
        if kind == "asciifolding":
            return F.transform(c, strip_accents)
        if kind == "trim":
            return F.transform(c, F.trim)
        if kind == "unique":
            return F.array_distinct(c)
        if kind == "length":
            return F.filter(c, lambda w: (F.length(w) >= spec.get("min", 0)) & (F.length(w) <= spec.get("max", 2**31 - 1)))
        if kind == "stop":
            words = spec.get("stopwords", ())
            words = STOP_PT if words in ("_brazilian_", "_portuguese_") else list(words)
            return F.filter(c, lambda w: ~w.isin(list(words))) if words else c
        if kind in ("stemmer", "brazilian_stem"):
            return _stemmed(c)
        raise ValueError(f"unknown token filter {name!r}")

    def analyze(c: Column) -> Column:
        for name in definition.get("char_filter", ()):
            c = char_filter(c, name)
        tokenizer = definition.get("tokenizer", "standard")
        spec = (analysis.get("tokenizer") or {}).get(tokenizer, {})
        if tokenizer == "standard":
            out = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1)
        elif tokenizer == "letter":
            out = F.regexp_extract_all(c, F.lit(r"(\p{L}+)"), 1)
        elif tokenizer == "lowercase":
            out = simple(c)
        elif tokenizer in ("whitespace", "keyword"):
            out = ANALYZERS[tokenizer](c)
        elif spec.get("type") == "pattern":
            out = F.filter(F.split(c, spec.get("pattern", r"\W+")), lambda w: w != "")
        else:
            raise ValueError(f"unknown tokenizer {tokenizer!r}")
        for name in definition.get("filter", ()):
            out = token_filter(out, name)
        return out

    return analyze


def analyzer(name: str | None, analysis: dict | None = None) -> Callable[[Column], Column]:
    """A built-in analyzer, or one that the index's settings define."""
    own = ((analysis or {}).get("analyzer") or {}).get(name or "", None)
    if own is not None:
        return ANALYZERS[own["type"]] if own.get("type") in ANALYZERS else custom(own, analysis or {})
    if (name or "standard") not in ANALYZERS:
        raise ValueError(f"unknown analyzer {name!r}")
    return ANALYZERS[name or "standard"]
