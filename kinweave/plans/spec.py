"""Declarative plans: linkage phases, index fields, storage, execution, deduplication.

Every class is built from a plain mapping with :func:`build`, which reports missing and
unknown values by name; YAML files go through :func:`load_yaml`.
"""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field, fields
from datetime import datetime
from pathlib import Path
from typing import Any

log = logging.getLogger("kinweave")
CLAUSES = ("must", "should", "filter", "must_not")
QUERIES = ("match", "term", "match_phrase", "prefix")
FIELD_TYPES = ("text", "keyword", "date", "integer", "long", "float", "double", "boolean")


class SpecError(ValueError):
    """A plan that can't be carried out as written."""


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise SpecError(message)


class Plan:
    """Shared printing of the plan classes."""

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def __str__(self) -> str:
        return json.dumps(self.to_dict(), default=str, ensure_ascii=False)


def build(kind: type, values: dict, where: str):
    """``kind(**values)`` for the keys it has; a missing one is named."""
    _require(isinstance(values, dict), f"{where}: a mapping is expected")
    known = {f.name: f for f in fields(kind)}
    unknown = sorted(str(k) for k in values if k not in known)
    if unknown:
        log.warning("%s: %s have no meaning here and are left out", where, unknown)
    try:
        return kind(**{k: v for k, v in values.items() if k in known})
    except TypeError as e:
        raise SpecError(f"{where}: {e}") from e


@dataclass(frozen=True)
class Rule(Plan):
    """One comparison: how it retrieves candidates and how it scores pairs."""

    source_column: str
    target_column: str
    similarity: str
    weight: float
    es_clause_type: str = "should"
    query_type: str = "match"
    penalty: float = 0.0
    is_fuzzy: bool = False
    boost: float | None = None

    def __post_init__(self):
        for name in ("es_clause_type", "query_type"):
            object.__setattr__(self, name, str(getattr(self, name)).lower())
        _require(self.weight >= 0, f"{self.source_column}: weight is negative")
        _require(self.penalty >= 0, f"{self.source_column}: penalty is negative")
        _require(self.boost is None or self.boost > 0, f"{self.source_column}: boost must be positive")
        _require(not self.is_fuzzy or self.query_type == "match", f"{self.source_column}: only match can be fuzzy")


@dataclass(frozen=True)
class Filter(Plan):
    """Exactly one of a raw clause, a column equality, a term or a range."""

    query: dict | None = None
    column: dict | None = None
    term: dict | None = None
    range: dict | None = None

    def __post_init__(self):
        given = [k for k in ("query", "column", "term", "range") if getattr(self, k) is not None]
        _require(len(given) == 1, f"a filter has exactly one of query, column, term, range; got {given}")
        _require(isinstance(getattr(self, given[0]), dict) and getattr(self, given[0]), f"filter {given[0]}: a mapping is expected")
        if self.column is not None:
            _require({"source_column", "target_column"} <= set(self.column), "filter column: source_column and target_column are required")


def _filters(raw) -> tuple[Filter, ...]:
    _require(raw is None or isinstance(raw, (list, tuple)), "indexed_dataset_filter: a list is expected")
    return tuple(f if isinstance(f, Filter) else build(Filter, f, "indexed_dataset_filter") for f in raw or ())


@dataclass(frozen=True)
class Phase(Plan):
    """One retrieval and scoring strategy of the cascade."""

    phase_name: str
    rules: tuple[Rule, ...]
    phase_description: str = ""
    enabled: bool = True
    candidate_limit: int = 10
    strong_match_score_threshold: float = 0.9
    indexed_dataset_filter: tuple[Filter, ...] = ()

    def __post_init__(self):
        _require(bool(self.phase_name), "a phase needs a name")
        rules = tuple(r if isinstance(r, Rule) else build(Rule, r, f"{self.phase_name}.rules[{i}]") for i, r in enumerate(self.rules))
        object.__setattr__(self, "rules", rules)
        object.__setattr__(self, "indexed_dataset_filter", _filters(self.indexed_dataset_filter))
        _require(self.candidate_limit > 0, f"{self.phase_name}: candidate_limit must be positive")
        _require(0 <= self.strong_match_score_threshold <= 1, f"{self.phase_name}: threshold must lie in [0, 1]")


@dataclass(frozen=True)
class LinkageSpec(Plan):
    """Source, target and the ordered phases."""

    source_table: str
    id_source_table: str
    target_es_index: str
    id_target_table: str
    blocking_phases: tuple[Phase, ...]
    workflow_name: str = ""
    workflow_description: str = ""
    extra_target_fields: tuple[str, ...] = ()
    indexed_dataset_filter: tuple[Filter, ...] = ()

    def __post_init__(self):
        raw = self.blocking_phases
        _require(isinstance(raw, (list, tuple)) and len(raw) > 0, "blocking_phases: a non-empty list is required")
        phases = tuple(p if isinstance(p, Phase) else build(Phase, p, f"blocking_phases[{i}]") for i, p in enumerate(raw))
        object.__setattr__(self, "blocking_phases", phases)
        object.__setattr__(self, "extra_target_fields", tuple(self.extra_target_fields or ()))
        object.__setattr__(self, "indexed_dataset_filter", _filters(self.indexed_dataset_filter))
        if not self.workflow_name:
            object.__setattr__(self, "workflow_name", f"linkage_{self.source_table}_{self.target_es_index}")

    def filters_of(self, phase: Phase) -> tuple[Filter, ...]:
        """The workflow's filters, then the phase's."""
        return self.indexed_dataset_filter + phase.indexed_dataset_filter

    def source_columns(self) -> list[str]:
        """Id, rule columns and columns that filters compare with."""
        names = [self.id_source_table]
        for p in self.blocking_phases:
            names += [r.source_column for r in p.rules]
            names += [f.column["source_column"] for f in self.filters_of(p) if f.column]
        return list(dict.fromkeys(names))

    def target_columns(self, phase: Phase | None = None) -> list[str]:
        """Id, compared fields and extra fields, of one phase or of all."""
        names = [self.id_target_table]
        for p in self.blocking_phases if phase is None else (phase,):
            names += [r.target_column for r in p.rules]
        return list(dict.fromkeys([*names, *self.extra_target_fields]))


@dataclass(frozen=True)
class IndexField(Plan):
    """A typed field of the index; ``string`` is another word for ``text``."""

    name: str
    type: str
    index_as: str | None = None
    format: str | None = None
    analyzer: str | None = None
    ignore_above: int | None = None

    def __post_init__(self):
        _require(bool(self.name) and bool(self.type), "an index column needs name and type")
        object.__setattr__(self, "type", {"string": "text"}.get(str(self.type).lower(), str(self.type).lower()))

    def mapping(self) -> dict:
        """The entry of ``mapping.json``; text indexed as both also keeps whole values."""
        out: dict[str, Any] = {"type": self.type}
        if self.type == "text":
            if self.index_as == "keyword":
                out["type"] = "keyword"
            elif self.index_as == "both":
                out["fields"] = {"keyword": {"type": "keyword", "ignore_above": self.ignore_above or 256}}
        if out["type"] == "text" and self.analyzer:
            out["analyzer"] = self.analyzer
        if out["type"] == "keyword" and self.ignore_above:
            out["ignore_above"] = self.ignore_above
        if self.type == "date" and self.format:
            out["format"] = self.format
        return out


@dataclass(frozen=True)
class IndexSpec(Plan):
    """The target table's index: name, settings and fields."""

    source_table: str
    id_field: str
    name: str
    index_columns: tuple[IndexField, ...]
    id_from_source: bool = False
    number_of_shards: int = 1
    number_of_replicas: int = 0
    refresh_interval: str = "1s"
    analysis: dict | None = None

    def __post_init__(self):
        _require(bool(self.id_field), "source_config.id_field is required")
        _require(bool(self.name), "index_config.name is required")
        _require(self.number_of_shards > 0 and self.number_of_replicas >= 0, "shards must be positive, replicas not negative")
        _require(isinstance(self.index_columns, (list, tuple)) and len(self.index_columns) > 0, "index_columns: a non-empty list is required")
        object.__setattr__(self, "index_columns", tuple(c if isinstance(c, IndexField) else build(IndexField, c, f"index_columns[{i}]") for i, c in enumerate(self.index_columns)))

    @classmethod
    def of(cls, raw: dict) -> IndexSpec:
        merged = {**raw.get("source_config", {}), **raw.get("index_config", {}), "index_columns": raw.get("index_columns")}
        return build(cls, merged, "indexing specification")

    def settings(self) -> dict:
        out = {"number_of_shards": self.number_of_shards, "number_of_replicas": self.number_of_replicas, "refresh_interval": self.refresh_interval}
        return out | ({"analysis": self.analysis} if self.analysis else {})


@dataclass(frozen=True)
class Storage(Plan):
    """Where tables are read from or results go to."""

    path: str
    format: str = "parquet"
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        _require(bool(self.path), "a storage path is required")


@dataclass(frozen=True)
class Execution(Plan):
    """How a run is cut into work units and what it leaves behind."""

    job_id: str = ""
    sample_fraction: float | None = None
    sample_seed: int = 42
    audit_log_path: str | None = None
    partition_column: str | None = None
    filter_partitions: tuple[str, ...] = ()
    search_strategy: str = "multisearch"
    msearch_batch_size: int = 100

    def __post_init__(self):
        # All source rows are searched as one join, whichever is named; the batch size has no meaning there.
        _require(str(self.search_strategy).lower() in ("single", "multisearch"), f"unknown search strategy {self.search_strategy!r}")
        _require(int(self.msearch_batch_size) > 0, "msearch_batch_size must be positive")
        if not self.job_id:
            object.__setattr__(self, "job_id", datetime.now().strftime("job_%Y%m%d_%H%M%S"))
        _require(self.sample_fraction is None or 0 < self.sample_fraction <= 1, "sample_fraction must lie in (0, 1]")
        object.__setattr__(self, "filter_partitions", tuple(self.filter_partitions or ()))
        _require(not self.filter_partitions or bool(self.partition_column), "filter_partitions needs partition_column")

    @classmethod
    def of(cls, raw: dict) -> Execution:
        return build(cls, {**raw, **(raw.get("partitioning") or {})}, "execution")


@dataclass(frozen=True)
class DedupSpec(Plan):
    """Which columns of the linked pairs are identified, and the name of the group."""

    id_source_column: str
    id_target_column: str
    output_group_id_column: str = "cluster_id"

    def __post_init__(self):
        _require(bool(self.id_source_column) and bool(self.id_target_column), "both id columns are required")
        _require(self.id_source_column != self.id_target_column, "the id columns must differ")
        _require(bool(self.output_group_id_column), "output_group_id_column is empty")


def load_yaml(path: str | Path) -> dict:
    """A YAML mapping; an empty file is an empty one."""
    import yaml

    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"no such configuration: {path}")
    _require(path.is_file(), f"{path} is not a file")
    _require(path.suffix.lower() in (".yml", ".yaml"), f"{path}: .yml or .yaml is expected")
    try:
        raw = yaml.safe_load(path.read_text(encoding="utf-8"))
    except yaml.YAMLError as e:
        raise SpecError(f"{path}: not valid YAML: {e}") from e
    _require(raw is None or isinstance(raw, dict), f"{path}: a mapping is expected at the top")
    return raw or {}
