"""The weighted, null-penalised pair score as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.similarity import BOUNDED, COSTLY, similarity
from kinweave.plans.spec import Rule


def score_names(rules: Sequence[Rule]) -> list[str]:
    """``sim_<source column>``; a second rule on the column adds its target's name."""
    names: list[str] = []
    for r in rules:
        name = f"sim_{r.source_column}"
        if name in names:
            name += f"_{r.target_column}"
        while name in names:
            name += "_"
        names.append(name)
    return names


def _null(r: Rule, source: Callable, target: Callable) -> Column:
    return source(r.source_column).isNull() | target(r.target_column).isNull()


def total_score(rules: Sequence[Rule], sims: Sequence[Column], nulls: Sequence[Column]) -> tuple[Column, Column, Column]:
    """Raw, normalised and final score. A null rule adds nothing and takes its penalty off,
    its weight stays in the divisor; only a penalised score may fall below 0."""
    weight = float(sum(r.weight for r in rules))
    raw, punished = F.lit(0.0), F.lit(False)
    for r, sim, null in zip(rules, sims, nulls):
        raw = raw + F.when(null, F.lit(-float(r.penalty))).otherwise(sim * F.lit(float(r.weight)))
        if r.penalty > 0:
            punished = punished | null
    norm = raw / F.lit(weight) if weight > 0 else F.lit(0.0)
    final = F.when(punished, F.least(F.lit(1.0), norm)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), norm)))
    return raw, norm, F.round(final, 6) if rules else F.lit(0.0)


def attainable(rules: Sequence[Rule], source: Callable[[str], Column], threshold: float) -> Column | None:
    """Whether a source row could reach the threshold with full marks on all that it has; None if that can't be told."""
    if not rules or any(r.similarity not in BOUNDED or r.weight < 0 or r.penalty < 0 for r in rules):
        return None
    nulls = [source(r.source_column).isNull() for r in rules]
    return total_score(rules, [F.lit(1.0)] * len(rules), nulls)[2] >= threshold - 1e-6


def score_pairs(
    pairs: DataFrame, rules: Sequence[Rule], source: Callable[[str], Column], target: Callable[[str], Column],
    threshold: float | None = None, debug: bool = False, most: dict[int, Column] | None = None,
) -> DataFrame:
    """``pairs`` with ``match_score``, one ``sim_`` column a rule and, if wanted, a JSON breakdown.

    With a threshold, a pair is dropped before each costly similarity is computed if full
    marks on those to come (or what ``most`` has for a rule's number) couldn't lift it to the threshold; pairs that remain are the same.
    """
    names = score_names(rules)
    nulls = {n: _null(r, source, target) for n, r in zip(names, rules)}
    cheap = [(n, r) for n, r in zip(names, rules) if r.similarity not in COSTLY]
    dear = [(n, r) for n, r in zip(names, rules) if r.similarity in COSTLY]

    def add(df: DataFrame, some: list) -> DataFrame:
        return df.withColumns({n: F.when(nulls[n], F.lit(0.0)).otherwise(similarity(r.similarity)(source(r.source_column), target(r.target_column))) for n, r in some}) if some else df

    for r in rules:
        similarity(r.similarity)
    limits = {names[i]: c for i, c in (most or {}).items()}
    out = add(pairs, cheap)
    if threshold is None:
        out = add(out, dear)
    else:
        # The heaviest first: fewer pairs are left for the others.
        dear.sort(key=lambda x: -x[1].weight)
        for k, one in enumerate(dear):
            best = {n: limits.get(n, F.lit(1.0)) for n, _ in dear[k:]}
            bound = total_score(rules, [best.get(n, F.col(n)) for n in names], [nulls[n] for n in names])[2]
            out = add(out.where(bound >= threshold - 1e-6), [one])
    raw, norm, final = total_score(rules, [F.col(n) for n in names], [nulls[n] for n in names])
    out = out.withColumn("match_score", final)
    if debug:
        rows, running, punished = [], F.lit(0.0), F.lit(False)
        for r, n in zip(rules, names):
            taken = F.when(nulls[n], F.lit(float(r.penalty))).otherwise(F.lit(0.0))
            gained = F.when(nulls[n], F.lit(0.0)).otherwise(F.col(n) * F.lit(float(r.weight)))
            running, punished = running + gained - taken, punished | (taken > 0)
            rows.append(F.struct(
                F.lit(r.source_column).alias("source_column"), F.lit(r.target_column).alias("target_column"), F.lit(r.similarity).alias("similarity"),
                F.lit(float(r.weight)).alias("weight"), F.lit(float(r.penalty)).alias("penalty"), source(r.source_column).cast("string").alias("source_value"),
                target(r.target_column).cast("string").alias("candidate_value"), F.round(F.col(n), 6).alias("current_similarity"), F.round(gained, 6).alias("weighted_contribution"),
                F.round(taken, 6).alias("penalty_applied"), F.round(running, 6).alias("running_raw_score"), F.lit(None).cast("string").alias("error"), nulls[n].alias("is_null"),
            ))
        total = F.struct(F.round(raw, 6).alias("raw_score"), F.lit(round(float(sum(r.weight for r in rules)), 6)).alias("total_weight"), F.round(norm, 6).alias("normalized_score"), punished.alias("any_penalty_applied"), F.array(*rows).alias("rules"))
        out = out.withColumn("score_debug_json", F.to_json(total, {"ignoreNullFields": "false"}))
    return out.withColumns({n: F.round(F.col(n), 6) for n in names}) if names else out


def strong(df: DataFrame, threshold: float) -> DataFrame:
    """Rows that reach the threshold; a null score doesn't."""
    return df.where(F.col("match_score").isNotNull() & (F.col("match_score") >= F.lit(float(threshold))))
