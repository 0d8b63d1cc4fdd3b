"""Similarities of two columns as text, from 0 to 1, and their registry."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exact(a: Column, b: Column) -> Column:
    """1 for equal text, else 0; null on either side is 0."""
    return F.coalesce((a.cast("string") == b.cast("string")).cast("double"), F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    """Share of places that agree; 0 for different lengths, 1 for two empty texts."""
    a, b = a.cast("string"), b.cast("string")
    agree = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    same = F.when(F.length(a) == 0, 1.0).otherwise(agree / F.length(a))
    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).when(F.length(a) != F.length(b), 0.0).otherwise(same)


def jaro_winkler_value(a: str, b: str) -> float:
    """Jaro similarity, raised for up to four equal first letters if above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = bytearray(len(b))
    left = []
    for i, c in enumerate(a):
        at = b.find(c, max(0, i - reach), i + reach + 1)
        while at >= 0 and taken[at]:
            at = b.find(c, at + 1, i + reach + 1)
        if at >= 0:
            taken[at] = 1
            left.append(c)
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro > 0.7:
        prefix = 0
        for x, y in zip(a[:4], b[:4]):
            if x != y:
                break
            prefix += 1
        jaro += prefix * 0.1 * (1 - jaro)
    return jaro


@F.pandas_udf(T.DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple, float] = {}
    out = []
    for pair in zip(a, b):
        value = seen.get(pair)
        if value is None:
            x, y = pair
            value = seen[pair] = 0.0 if x is None or y is None else jaro_winkler_value(x, y)
        out.append(value)
    return pd.Series(out, dtype="float64")


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler in Arrow batches: no built-in has it, and its loop is far slower as expressions."""
    return _jaro_winkler(a.cast("string"), b.cast("string"))


def letter_counts(text: Column) -> Column:
    """Which letters a text has at least once, twice, three and four times (hashed to 32), and how many letters that leaves out."""
    c = text.cast("string")
    zero = F.struct(*(F.lit(0).cast("long").alias(f"l{i}") for i in range(4)))

    def add(acc: Column, letter: Column) -> Column:
        carry, out = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(letter), F.lit(32))), []
        for i in range(4):
            out.append(acc[f"l{i}"].bitwiseOR(carry).alias(f"l{i}"))
            carry = carry.bitwiseAND(acc[f"l{i}"])
        return F.struct(*out)

    told = F.transform(F.array(F.aggregate(F.split(c, ""), zero, add)), lambda t: F.struct(t["l0"].bitwiseOR(F.shiftleft(t["l1"], 32)).alias("low"), t["l2"].bitwiseOR(F.shiftleft(t["l3"], 32)).alias("high")))
    return F.element_at(F.transform(told, lambda t: F.struct(t["low"].alias("low"), t["high"].alias("high"), (F.length(c) - F.bit_count(t["low"]) - F.bit_count(t["high"])).alias("more"), F.length(c).alias("n"))), 1)


def jaro_winkler_most(a: Column, b: Column, of_a: Column, of_b: Column) -> Column:
    """What Jaro-Winkler is at most, from ``letter_counts``: all common letters match in order."""
    common = F.bit_count(of_a["low"].bitwiseAND(of_b["low"])) + F.bit_count(of_a["high"].bitwiseAND(of_b["high"])) + F.least(of_a["more"], of_b["more"])
    jaro = (F.try_divide(common, of_a["n"]) + F.try_divide(common, of_b["n"]) + 1) / 3
    same = lambda k: F.substring(a, 1, k) == F.substring(b, 1, k)
    prefix = F.when(~same(1), 0).when(same(4), 4).when(same(3), 3).when(same(2), 2).otherwise(1)
    return F.when(a == b, 1.0).otherwise(F.coalesce(jaro + prefix * 0.1 * (1 - jaro), F.lit(1.0)))


#: Similarities by name, and those whose cost calls for pruning first.
REGISTRY: dict[str, Callable[[Column, Column], Column]] = {"exact": exact, "overlap": exact, "hamming": hamming, "jaro_winkler": jaro_winkler}
COSTLY = {"jaro_winkler"}
#: Those that never pass 1.
BOUNDED = set(REGISTRY)


def register_similarity(name: str, function: Callable[[Column, Column], Column], costly: bool = False) -> None:
    """Let rules use ``function(source, target)`` by ``name``."""
    REGISTRY[name] = function
    BOUNDED.discard(name)
    if costly:
        COSTLY.add(name)


def similarity(name: str) -> Callable[[Column, Column], Column]:
    if name not in REGISTRY:
        raise KeyError(f"unknown similarity {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name]
