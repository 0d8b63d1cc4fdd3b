"""Scans and sinks of linkage tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.plans.spec import SpecError, Storage
from kinweave.plans.staging import _path


def _join(root: str, *parts: str) -> str:
    return "/".join([root.rstrip("/"), *(p.strip("/") for p in parts if p)])


class TableSource:
    """Tables below one path, in any format that Spark reads."""

    def __init__(self, spark: SparkSession, storage: Storage):
        self.spark, self.storage, self._values = spark, storage, {}

    def _location(self, table: str) -> str:
        return _join(self.storage.path, table)

    def read(self, table: str, **equal) -> DataFrame:
        """The whole table, or the rows whose columns equal the given values; the reader
        gets those as pushed filters, or prunes partitions by them."""
        df = self.spark.read.format(self.storage.format).options(**self.storage.options).load(self._location(table))
        for column, value in equal.items():
            df = df.where(F.col(column) == F.lit(value))
        return df

    def partitions(self, table: str, column: str) -> list[str]:
        """Distinct values of the column as text, sorted; nulls are left out."""
        key = (table, column)
        if key not in self._values:
            df = self.read(table)
            if column not in df.columns:
                raise SpecError(f"{table} has no column {column!r}")
            found = df.select(F.col(column).cast("string").alias("v")).where("v is not null").distinct().collect()  # work units, driver-run
            self._values[key] = sorted(r["v"] for r in found)
        return self._values[key]

    def problems(self, table: str) -> list[str]:
        """Why the table can't be read, if so; any file system that Hadoop knows is asked."""
        path, fs = _path(self.spark, self._location(table))
        return [] if fs.exists(path) else [f"{self._location(table)} does not exist"]

    def missing(self, table: str, columns: Sequence[str]) -> list[str]:
        have = set(self.read(table).columns)
        return [c for c in columns if c not in have]

    def sample(self, table: str, fraction: float, seed: int = 42) -> DataFrame:
        return self.read(table).sample(False, fraction, seed)


class PhaseSink:
    """Linked pairs by phase: ``<path>/<project>/phase_match=<phase>[/<column>=<value>]``."""

    def __init__(self, spark: SparkSession, storage: Storage):
        self.spark, self.storage = spark, storage

    def location(self, project: str) -> str:
        return _join(self.storage.path, project)

    def write(self, df: DataFrame, project: str, phase: str, partition_column: str | None = None, partition_value: str | None = None) -> int:
        """Overwrite the partitions that ``df`` has, and no others. The count is observed by
        the same job. An empty result removes what an earlier run left of its own partition."""
        keys = ["phase_match"]
        if partition_column:
            keys.append(partition_column if partition_column in df.columns else f"source_{partition_column}")
        from pyspark.sql import Observation

        seen = Observation()
        counted = df.withColumn("phase_match", F.lit(phase)).observe(seen, F.count(F.lit(1)).alias("n"))
        counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(self.storage.format).options(**self.storage.options).partitionBy(*keys).save(self.location(project))
        n = int(seen.get["n"])
        if n == 0:
            target = _join(self.location(project), f"phase_match={phase}", f"{keys[1]}={partition_value}" if len(keys) > 1 and partition_value is not None else "")
            if len(keys) == 1 or partition_value is not None:
                path, fs = _path(self.spark, target)
                fs.delete(path, True)
        return n

    def read(self, project: str) -> DataFrame:
        """All phases; columns that only some have are null in the others."""
        return self.spark.read.format(self.storage.format).option("mergeSchema", "true").options(**self.storage.options).load(self.location(project))


def overwrite(df: DataFrame, storage: Storage) -> None:
    """Replace a table as a whole."""
    df.write.mode("overwrite").format(storage.format).options(**storage.options).save(storage.path)


def union_phases(frames: Sequence[DataFrame | None]) -> DataFrame:
    """All rows of all frames by column name; missing columns are null, None is skipped."""
    some = [f for f in frames if f is not None]
    if not some:
        raise ValueError("no phase has an output")
    out = some[0]
    for f in some[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
