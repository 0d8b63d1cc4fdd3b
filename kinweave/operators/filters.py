"""Filters of the index: which documents a search may return."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.plans.spec import Filter, SpecError
from kinweave.sources.index import ID, TextIndex

_BOUNDS = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


def _term(index: TextIndex, field: str, value) -> Column:
    """Equality of whole values; on a text field, membership of the value in its terms."""
    if isinstance(value, dict):
        value = value.get("value")
    if index.kind(field) == "text":
        return F.array_contains(index.analyze(field, F.col(field)), F.lit(str(value)))
    return index.value(field) == index.literal(field, value)


def _range(index: TextIndex, body: dict) -> Column:
    """``{field, gte, ...}`` without its null bounds, or ``{field: {gte, ...}}``."""
    if "field" in body:
        field, bounds = body["field"], {k: v for k, v in body.items() if k in _BOUNDS and v is not None}
    else:
        field, bounds = next(iter(body.items()))
    out = index.value(field).isNotNull()
    for k, v in bounds.items():
        if k in _BOUNDS:
            out = out & _BOUNDS[k](index.value(field), index.literal(field, v))
    return out


def _all(parts: Sequence[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & F.coalesce(p, F.lit(False))
    return out


def _any(parts: Sequence[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(p, F.lit(False))
    return out


def _listed(x) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


def clause(index: TextIndex, body: dict) -> Column:
    """A raw search clause as a predicate over documents."""
    if len(body) != 1:
        raise SpecError(f"a clause has one kind; got {sorted(body)}")
    kind, arg = next(iter(body.items()))
    if kind == "match_all":
        return F.lit(True)
    if kind == "exists":
        return F.col(arg["field"]).isNotNull()
    if kind == "ids":
        return F.col(ID).isin([str(v) for v in arg["values"]])
    if kind == "range":
        return _range(index, arg)
    if kind == "bool":
        must = [clause(index, c) for k in ("must", "filter") for c in _listed(arg.get(k, []))]
        none = [clause(index, c) for c in _listed(arg.get("must_not", []))]
        some = [clause(index, c) for c in _listed(arg.get("should", []))]
        least = int(arg.get("minimum_should_match", 1 if some and not must else 0))
        hits = sum((F.coalesce(c, F.lit(False)).cast("int") for c in some), F.lit(0))
        return _all(must) & ~_any(none) & (hits >= least)
    if kind not in ("term", "terms", "prefix", "wildcard", "regexp", "match", "match_phrase"):
        raise SpecError(f"unsupported clause {kind!r}")
    field, value = next((k, v) for k, v in arg.items() if k != "boost")
    if kind == "term":
        return _term(index, field, value)
    if kind == "terms":
        return _any([_term(index, field, v) for v in value])
    if isinstance(value, dict):
        value = value.get("value", value.get("query"))
    text = index.kind(field) == "text"
    if kind in ("match", "match_phrase"):
        if not text:
            return _term(index, field, value)
        have, want = index.analyze(field, F.col(field)), index.analyze(field, F.lit(str(value)))
        if kind == "match":
            return F.arrays_overlap(have, want)
        n = F.size(want)
        return F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(have) - n + 1)), lambda i: F.slice(have, i, n) == want) & (F.size(have) >= n)
    if kind == "prefix":
        test = lambda c: c.startswith(str(value))
    else:
        import re

        pattern = str(value) if kind == "regexp" else "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in str(value))
        test = lambda c: F.regexp_like(c, F.lit(f"^(?:{pattern})$"))
    return F.exists(index.analyze(field, F.col(field)), test) if text else test(index.value(field).cast("string"))


def static_predicate(index: TextIndex, filters: Sequence[Filter]) -> Column | None:
    """All filters that don't depend on the source row, as one predicate; None without any."""
    parts = []
    for f in filters:
        if f.query is not None:
            parts.append(clause(index, f.query))
        elif f.range is not None:
            parts.append(_range(index, f.range))
        elif f.term is not None:
            body = {f.term["field"]: f.term["value"]} if "field" in f.term else f.term
            parts.append(_all([_term(index, k, v) for k, v in body.items()]))
    return _all(parts) if parts else None


def dynamic_columns(filters: Sequence[Filter]) -> list[tuple[str, str]]:
    """``(source column, target field)`` pairs that must be equal."""
    return [(f.column["source_column"], f.column["target_column"]) for f in filters if f.column is not None]
