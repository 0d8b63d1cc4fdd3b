"""Command line: ``indexing``, ``linkage`` and ``deduplication`` from YAML files."""

from __future__ import annotations

import argparse
import logging
import os
import sys
import time

from kinweave.plans.run import Telemetry, clustered, link_tables
from kinweave.plans.session import create_session
from kinweave.plans.spec import DedupSpec, Execution, IndexSpec, LinkageSpec, SpecError, Storage, build, load_yaml
from kinweave.sources.index import TextIndex
from kinweave.sources.tables import TableSource

log = logging.getLogger("kinweave")


def _storage(raw: dict, side: str) -> Storage:
    block = raw.get("storage") or {}
    return Storage(block.get(f"{side}_path") or "", block.get(f"{side}_format") or "parquet", block.get(f"{side}_options") or {})


def _spec_of(args, env: dict, key: str) -> dict:
    path = args.spec_config or (env.get("specification") or {}).get(key)
    if not path:
        raise SpecError(f"give --spec-config, or specification.{key}")
    return load_yaml(path)


def _index_path(env: dict, name: str) -> str:
    root = (env.get("index") or {}).get("path") or os.path.join((env.get("storage") or {}).get("output_path") or "", "_indexes")
    return f"{root.rstrip('/')}/{name}"


def run_indexing(args, env: dict) -> None:
    spec = IndexSpec.of(_spec_of(args, env, "indexing_path"))
    spark = create_session("kinweave indexing", (env.get("spark") or {}).get("spark_configs"))
    try:
        source, began = TableSource(spark, _storage(env, "source")), time.time()
        telemetry = Telemetry((env.get("execution") or {}).get("audit_log_path"), spark)
        about = {"source_table": spec.source_table, "index_name": spec.name}
        telemetry.record("indexing", **about, column_count=len(spec.index_columns), event="indexing_start")
        index = TextIndex.over(source.read(spec.source_table), spec)
        telemetry.record("indexing", **about, duration_s=round(time.time() - began, 3), event="index_ensured")
        index.save(_index_path(env, spec.name), spec.id_from_source)
        telemetry.record("indexing", **about, total_duration_s=round(time.time() - began, 3), event="indexing_complete")
    finally:
        spark.stop()


def run_linkage(args, env: dict) -> None:
    spec = build(LinkageSpec, _spec_of(args, env, "linkage_path"), "linkage specification")
    search = {k: v for k, v in (env.get("elasticsearch") or {}).items() if k in ("search_strategy", "msearch_batch_size")}
    run = Execution.of({**search, **(env.get("execution") or {})})
    spark = create_session("kinweave linkage", (env.get("spark") or {}).get("spark_configs"))
    try:
        index = TextIndex.load(spark, _index_path(env, spec.target_es_index))
        link_tables(TableSource(spark, _storage(env, "source")), index, spec, _storage(env, "output"), run)
    finally:
        spark.stop()


def run_deduplication(args, env: dict) -> None:
    spec = build(DedupSpec, env.get("deduplication") or {}, "deduplication")
    spark = create_session(env.get("app_name") or "kinweave deduplication", (env.get("spark") or {}).get("spark_configs"))
    try:
        source = _storage(env, "source")
        pairs = spark.read.format(source.format).option("mergeSchema", "true").options(**source.options).load(source.path)
        audit = (env.get("execution") or {}).get("audit_log_path")
        clustered(pairs, spec, _storage(env, "output"), Telemetry(audit, spark))
    finally:
        spark.stop()


COMMANDS = {"indexing": run_indexing, "linkage": run_linkage, "deduplication": run_deduplication}


def main(argv: list[str] | None = None) -> int:
    """0 if the run ended well, 1 if anything was wrong with it."""
    parser = argparse.ArgumentParser(prog="kinweave", description=__doc__)
    parser.add_argument("--log-level", default=os.environ.get("LOG_LEVEL", "INFO"))
    commands = parser.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        sub = commands.add_parser(name)
        sub.add_argument("--env-config", required=True)
        sub.add_argument("--spec-config")
    args = parser.parse_args(argv)
    logging.basicConfig(level=args.log_level.upper(), format="%(asctime)s %(levelname)s %(name)s %(message)s")
    try:
        COMMANDS[args.command](args, load_yaml(args.env_config))
    except Exception:
        log.exception("%s failed", args.command)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
