"""Durable intermediate tables.

Lineage is cut by writing Parquet below the folder that the cluster names in
``spark.checkpoint.dir``: every executor can read it back after another one is
lost. Only where that setting is absent and the master is local (tests, a single
machine) a folder of this process is used; on a cluster its absence is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables, as a URI that executors can open."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_ROOT:
        _OWN_ROOT.append("file://" + tempfile.mkdtemp(prefix="kinweave-"))
    return _OWN_ROOT[0]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def _short_shuffles(spark: SparkSession):
    """Shuffle files of what runs inside go as soon as it ends: the table that it writes stands for them."""
    name, was = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", None
    try:
        was = spark.conf.get(name)
        spark.conf.set(name, "true")
    except Exception:  # a release without this setting leaves them to the garbage collector
        yield
        return
    try:
        yield
    finally:
        spark.conf.set(name, was)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; removed when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/kinweave/{tag}-{uuid.uuid4().hex}"
    with _short_shuffles(spark):
        df.write.parquet(path)
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinweave_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a staged table that nothing will read again."""
    path = getattr(df, "_kinweave_path", None)
    if path:
        p, fs = _path(df.sparkSession, path)
        fs.delete(p, True)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` behind an exchange of its own. An aggregation that is joined on its own key would
    otherwise share a stage with the join, and adaptive execution could not split a hot key there."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
