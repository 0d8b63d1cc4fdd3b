"""Entities from linked pairs: connected components, joined back to the pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.components import connected_components
from kinweave.plans.spec import DedupSpec


def vertices(pairs: DataFrame, spec: DedupSpec) -> DataFrame:
    """Distinct ids of both sides, as text."""
    side = lambda c: pairs.select(F.col(f"`{c}`").cast("string").alias("id"))
    return side(spec.id_source_column).union(side(spec.id_target_column)).where("id is not null").distinct()


def clusters(pairs: DataFrame, spec: DedupSpec, namespace_ids: bool = False) -> DataFrame:
    """``(id, cluster_id)``; a cluster is named by its smallest id. With ``namespace_ids``
    equal ids of the two sides are different entities, told apart by a prefix."""
    name = lambda c, tag: F.concat(F.lit(tag), F.col(f"`{c}`").cast("string")) if namespace_ids else F.col(f"`{c}`").cast("string")
    edges = pairs.select(name(spec.id_source_column, "s:").alias("src"), name(spec.id_target_column, "t:").alias("dst"))
    loops = edges.where("src is not null and dst is null").select("src", F.col("src").alias("dst"))
    lone = edges.where("src is null and dst is not null").select(F.col("dst").alias("src"), "dst")
    return connected_components(edges.unionByName(loops).unionByName(lone)).withColumnRenamed("component", "cluster_id")


def deduplicate(pairs: DataFrame, spec: DedupSpec, namespace_ids: bool = False) -> DataFrame:
    """The pairs with the cluster of their source id."""
    found = clusters(pairs, spec, namespace_ids).withColumnRenamed("cluster_id", spec.output_group_id_column)
    own = F.col(f"`{spec.id_source_column}`").cast("string")
    key = F.concat(F.lit("s:"), own) if namespace_ids else own
    return pairs.withColumn("_cluster_key", key).join(found.withColumnRenamed("id", "_cluster_key"), "_cluster_key", "left").drop("_cluster_key")
