"""A training corpus from documents: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import decontaminate, fuzzylines, language, packing, simhash
from kinweave.llm.common import table
from kinweave.plans.staging import staged

#: (name, function): each takes (spark, docs, sf_dir); all but the last return documents.
STAGES = [
    ("language_id", language.stage),
    ("line_dedup", fuzzylines.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("best_fit_packing", packing.stage),
]

#: SQL expresses neither the language model nor the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = staged(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
