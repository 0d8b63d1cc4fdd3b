"""The cascade: search, score, keep strong pairs, pass on the sources without one."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kinweave.functions.scoring import attainable, score_names, score_pairs, strong
from kinweave.functions.similarity import jaro_winkler_most, letter_counts
from kinweave.operators.search import UNLIMITED, Search
from kinweave.plans.spec import LinkageSpec, Phase
from kinweave.plans.staging import release, staged
from kinweave.sources.index import TextIndex


def candidate_pairs(source: DataFrame, index: TextIndex, spec: LinkageSpec, phase: Phase, on_empty: str = "match_all", more: dict[str, Column] | None = None) -> DataFrame:
    """``source_*`` columns, ``candidate_*`` fields as text (and ``more`` of documents), and ``es_score``."""
    fields = list(dict.fromkeys(f.partition(".")[0] for f in spec.target_columns(phase)))
    return Search(index, phase, spec.filters_of(phase), on_empty).pairs(source, fields, more)


def link_phase(source: DataFrame, index: TextIndex, spec: LinkageSpec, phase: Phase, debug: bool = False, on_empty: str = "match_all", all_pairs: bool = False, seen: Observation | None = None) -> DataFrame:
    """Scored pairs of one phase that reach its threshold (or all of them). ``seen`` gets the number of candidates.
    Sources whose nulls keep every pair below the threshold are not searched."""
    able = None if all_pairs else attainable(phase.rules, lambda c: F.col(f"`{c}`"), phase.strong_match_score_threshold)
    if able is not None:
        source = source.where(able)
    # Where all pairs of a group are scored, letters are counted once a row, before the pairs are made.
    counted = {} if all_pairs or phase.candidate_limit < UNLIMITED else {i: r for i, r in enumerate(phase.rules) if r.similarity == "jaro_winkler"}
    source = source.select("*", *(letter_counts(F.col(f"`{r.source_column}`")).alias(f"_letters{i}") for i, r in counted.items()))
    pairs = candidate_pairs(source, index, spec, phase, on_empty, {f"_letters{i}": letter_counts(F.col(f"`{r.target_column.partition('.')[0]}`")) for i, r in counted.items()})
    if seen is not None:
        pairs = pairs.observe(seen, F.count(F.lit(1)).alias("candidates"))
    at = lambda prefix: lambda c: F.col(f"`{prefix}_{c.partition('.')[0] if prefix == 'candidate' else c}`")
    threshold = None if all_pairs else phase.strong_match_score_threshold
    most = {i: jaro_winkler_most(at("source")(r.source_column).cast("string"), at("candidate")(r.target_column), F.col(f"source__letters{i}"), F.col(f"candidate__letters{i}")) for i, r in counted.items()}
    scored = score_pairs(pairs, phase.rules, at("source"), at("candidate"), threshold, debug, most)
    kept = scored if all_pairs else strong(scored, phase.strong_match_score_threshold)
    lead = [c for c in pairs.columns if c != "es_score" and c not in {f"{end}__letters{i}" for end in ("source", "candidate") for i in counted}]
    tail = ["match_score", *score_names(phase.rules), *(["score_debug_json"] if debug else []), "es_score"]
    return kept.select(*lead, *tail).withColumn("phase_match", F.lit(phase.phase_name))


def remaining(source: DataFrame, linked: DataFrame, id_column: str) -> DataFrame:
    """Source rows whose id is in no linked pair; a null id always remains."""
    ids = linked.select(F.col(f"`source_{id_column}`").alias(id_column)).distinct()
    return source.join(ids, id_column, "left_anti").select(*source.columns)


def best_match_only(linked: DataFrame, id_column: str) -> DataFrame:
    """The highest pair of each source."""
    from pyspark.sql import Window

    names = [c for c in linked.columns if c.startswith("candidate_")]
    order = Window.partitionBy(f"source_{id_column}").orderBy(F.col("match_score").desc(), F.col("es_score").desc(), *names)
    return linked.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


@dataclass
class PhaseResult:
    """What happened to one phase."""

    phase: str
    status: str  # completed, skipped, exhausted
    linked: DataFrame | None = None
    #: Source rows that came in and that are left, candidate pairs, seconds of search and scoring.
    records_in: int | None = None
    remaining: int | None = None
    candidates: int | None = None
    seconds: float | None = None


def cascade(source: DataFrame, index: TextIndex, spec: LinkageSpec, debug: bool = False, on_empty: str = "match_all", observe: Callable | None = None) -> list[PhaseResult]:
    """All phases in order. A disabled phase is skipped; when no source is left the rest
    are exhausted. Each phase's pairs and what remains are written to the shared folder,
    so lineage doesn't grow with the phases."""
    left, results, old = source, [], None
    for phase in spec.blocking_phases:
        if not phase.enabled:
            results.append(PhaseResult(phase.phase_name, "skipped"))
        elif left.isEmpty():
            results.append(PhaseResult(phase.phase_name, "exhausted"))
        else:
            seen, began, before = Observation(), time.time(), left.count()
            linked = staged(link_phase(left, index, spec, phase, debug, on_empty, seen=seen), "linked")
            took = round(time.time() - began, 3)
            left = staged(remaining(left, linked, spec.id_source_table), "remaining")
            results.append(PhaseResult(phase.phase_name, "completed", linked, before, left.count(), int(seen.get["candidates"]), took))
            release(old)
            old = left
        if observe:
            observe(results[-1], left)
    return results
