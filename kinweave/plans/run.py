"""Runs: work units, their checkpoint, preflight checks and telemetry."""

from __future__ import annotations

import json
import logging
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.similarity import similarity
from kinweave.operators.cascade import cascade
from kinweave.plans.spec import Execution, LinkageSpec, SpecError, Storage
from kinweave.plans.staging import _path, staged
from kinweave.sources.index import TextIndex
from kinweave.sources.tables import PhaseSink, TableSource

log = logging.getLogger("kinweave")
PENDING, PROCESSING, COMPLETED, FAILED = "PENDING", "PROCESSING", "COMPLETED", "FAILED"


# --- work units -----------------------------------------------------------------------


def unit_ids(run: Execution, values: list[str] | None = None) -> dict[str, str | None]:
    """Unit id to partition value: one ``global`` unit, or one of each value."""
    if not run.partition_column:
        return {"global": None}
    values = list(values or run.filter_partitions)
    if not values:
        raise SpecError("no partition values to work on")
    out: dict[str, str | None] = {}
    for v in values:
        name = f"{run.partition_column}_{str(v).strip().replace(' ', '_')}"
        if name in out and out[name] != v:
            raise SpecError(f"partition values {out[name]!r} and {v!r} share the unit id {name!r}")
        out[name] = v
    return out


class Files:
    """Small text files below a folder of any file system: Hadoop's if a session is given, else local ones."""

    def __init__(self, root: str, spark: SparkSession | None = None):
        self.root, self.spark = str(root).rstrip("/"), spark

    def _at(self, name: str):
        return _path(self.spark, f"{self.root}/{name}")

    def read(self, name: str) -> str | None:
        if self.spark is None:
            path = Path(self.root) / name
            return path.read_text(encoding="utf-8") if path.exists() else None
        path, fs = self._at(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replace a file; a reader finds the old content or the new one."""
        part = f"{name}.part"
        if self.spark is None:
            path = Path(self.root) / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.with_name(f"{path.name}.part").write_text(text, encoding="utf-8")
            os.replace(path.with_name(f"{path.name}.part"), path)
            return
        (new, fs), (path, _) = self._at(part), self._at(name)
        out = fs.create(new, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        old = self.read(name)
        if old is not None:
            fs.delete(path, False)
        fs.rename(new, path)

    def append(self, name: str, line: str) -> None:
        """Add a line. Object stores can't append, so there the file is written anew."""
        if self.spark is None:
            path = Path(self.root) / name
            path.parent.mkdir(parents=True, exist_ok=True)
            with open(path, "a", encoding="utf-8") as f:
                f.write(line + "\n")
        else:
            self.write(name, (self.read(name) or "") + line + "\n")

    def aside(self, name: str, new: str) -> None:
        self.write(new, self.read(name) or "")
        if self.spark is None:
            (Path(self.root) / name).unlink()
        else:
            path, fs = self._at(name)
            fs.delete(path, False)


class Checkpoint:
    """The state of each unit, kept as JSON below a path, or in memory without one."""

    def __init__(self, path: str | None, job_id: str, spark: SparkSession | None = None):
        self.files = Files(f"{str(path).rstrip('/')}/{job_id}", spark) if path else None
        self.file = Path(path) / job_id / "state.json" if path and spark is None else None
        self.state: dict[str, str] = {}

    def open(self, units) -> None:
        """Resume: known units keep their state, interrupted ones are pending again."""
        text = self.files.read("state.json") if self.files else None
        if text is not None:
            try:
                self.state = json.loads(text)["units"]
            except (ValueError, KeyError, TypeError):
                self.files.aside("state.json", f"state.corrupt-{int(time.time())}")
        if self.state:
            new = [u for u in units if u not in self.state]
            if new:
                log.warning("units %s are not part of the job that is resumed", new)
            self.state = {u: PENDING if s in (PROCESSING, FAILED) else s for u, s in self.state.items()}
        else:
            self.state = dict.fromkeys(units, PENDING)
        self._save()

    def _save(self) -> None:
        if self.files:
            self.files.write("state.json", json.dumps({"schema_version": "1", "units": self.state}, indent=1))

    def mark(self, unit: str, state: str) -> None:
        self.state[unit] = state
        self._save()

    def pending(self, units=None) -> Iterator[str]:
        """Units to work on, each marked when it is taken. With ``units``, others than those
        stay pending: what an earlier run left of units that are no longer asked for."""
        for unit in [u for u, s in self.state.items() if s == PENDING]:
            if units is not None and unit not in units:
                log.warning("unit %s is pending, but not among the units of this run", unit)
                continue
            self.mark(unit, PROCESSING)
            yield unit


# --- telemetry ---------------------------------------------------------------------------


@dataclass
class Telemetry:
    """Events to the log, and as JSON lines to a folder if there is one."""

    folder: str | None = None
    spark: SparkSession | None = None
    events: list[dict] = field(default_factory=list)

    def record(self, stream: str, **values) -> None:
        event = {**values, "ts": _now(), "schema_version": "1"}
        self.events.append({"stream": stream} | event)
        log.info("%s %s", stream, json.dumps(values, default=str))
        if self.folder:
            Files(self.folder, self.spark).append(f"{stream}.jsonl", json.dumps(event, default=str, ensure_ascii=False))


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


# --- runs -----------------------------------------------------------------------------------


def preflight(source: DataFrame, index: TextIndex, spec: LinkageSpec, run: Execution) -> None:
    """Everything that can be known to be wrong before work begins, in one error."""
    wanted = spec.source_columns() + ([run.partition_column] if run.partition_column else [])
    errors = [f"the source has no column {c!r}" for c in dict.fromkeys(wanted) if c not in source.columns]
    errors += [f"the index has no field {c!r}" for c in index.missing(f.partition(".")[0] for f in spec.target_columns())]
    for p in spec.blocking_phases:
        for r in p.rules:
            try:
                similarity(r.similarity)
            except KeyError as e:
                errors.append(str(e))
    if errors:
        raise SpecError("; ".join(dict.fromkeys(errors)))


def link_frame(source: DataFrame, index: TextIndex, spec: LinkageSpec, output: Storage, run: Execution, telemetry: Telemetry | None = None, debug: bool = False) -> PhaseSink:
    """Link a source frame unit by unit. The first unit that fails ends the run."""
    preflight(source, index, spec, run)
    spark = source.sparkSession
    telemetry = telemetry or Telemetry(run.audit_log_path and os.path.join(run.audit_log_path, spec.workflow_name, run.job_id), spark)
    if run.sample_fraction and run.sample_fraction < 1:
        source = source.sample(False, run.sample_fraction, run.sample_seed)
    if run.partition_column and not run.filter_partitions:
        column = F.col(run.partition_column).cast("string")
        values = sorted(r[0] for r in source.select(column).where(column.isNotNull()).distinct().collect())  # work units
    else:
        values = list(run.filter_partitions)
    units = unit_ids(run, values)
    state = Checkpoint(run.audit_log_path and os.path.join(run.audit_log_path, spec.workflow_name), run.job_id, spark)
    state.open(units)
    sink, began, job_at = PhaseSink(spark, output), time.time(), _now()
    job = {"job_id": run.job_id, "project_name": spec.workflow_name}
    for unit in state.pending(units):
        value, started, unit_at = units[unit], time.time(), _now()
        part = source if value is None else source.where(F.col(run.partition_column) == F.lit(value))
        try:
            links, left = 0, None
            for k, result in enumerate(cascade(part, index, spec, debug), 1):
                about = {**job, "unit_id": unit, "phase_index": k, "phase_name": result.phase, "status": result.status}
                if result.linked is not None:
                    persisting = time.time()
                    saved = sink.write(result.linked.drop("phase_match"), spec.workflow_name, result.phase, run.partition_column, value)
                    persisted = round(time.time() - persisting, 3)
                    links, left = links + saved, result.remaining
                    about |= {"records_in": result.records_in, "candidates_found": result.candidates, "records_out": saved}
                    about |= {"duration_s": round(result.seconds + persisted, 3), "search_duration_s": result.seconds, "persist_duration_s": persisted}
                telemetry.record("phases", **about)
            state.mark(unit, COMPLETED)
            telemetry.record("units", **job, unit_id=unit, started_at=unit_at, completed_at=_now(), status="completed", duration_s=round(time.time() - started, 3), total_links=links, remaining=left)
        except Exception as e:
            state.mark(unit, FAILED)
            telemetry.record("units", **job, unit_id=unit, started_at=unit_at, completed_at=_now(), status="failed", duration_s=round(time.time() - started, 3), error=str(e)[:2000])
            raise
    telemetry.record("job", **job, total_units=len(units), started_at=job_at, completed_at=_now(), duration_s=round(time.time() - began, 3))
    return sink


def link_tables(source: TableSource, index: TextIndex, spec: LinkageSpec, output: Storage, run: Execution) -> PhaseSink:
    """Link a stored source table."""
    problems = source.problems(spec.source_table)
    if problems:
        raise SpecError("; ".join(problems))
    return link_frame(source.read(spec.source_table), index, spec, output, run)


def clustered(pairs: DataFrame, spec, output: Storage, telemetry: Telemetry | None = None) -> None:
    """Deduplicate linked pairs and replace the output table."""
    from kinweave.operators.cluster import deduplicate
    from kinweave.sources.tables import overwrite

    out = staged(deduplicate(pairs, spec), "entities")
    overwrite(out, output)
    if telemetry:
        row = out.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct(spec.output_group_id_column).alias("clusters")).first()
        telemetry.record("dedup", pairs=row["pairs"], clusters=row["clusters"])
