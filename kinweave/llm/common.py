"""What the training-data operators share: table access, batches, words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are handled together, and bytes of text.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20
#: Rows of a broadcast filter, each of 64 bits: a bound on its size.
BUCKETS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded rows and text bytes (a longer text stands alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at, size, sizes = 0, 0, pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, n in enumerate(sizes):
            if i > at and (size + n > BATCH_BYTES or i - at >= BATCH_ROWS):
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        yield batch.slice(at)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list, pa.RecordBatch], dict]], schema: str, column: str = "text") -> DataFrame:
    """Map Arrow batches. ``make()`` runs once in a task and gives the function of a
    batch: from the texts (null or str) and the batch to a dict of output columns."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        fn = make()
        for batch in slices(batches, column):
            out = fn(batch.column(column).to_pylist(), batch)
            yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def masks(ids: DataFrame, *columns: str) -> DataFrame:
    """Which of ``64 * BUCKETS`` values the hashes of ``ids`` take: at most ``BUCKETS`` rows of 64 bits, so they can be broadcast."""
    h = F.xxhash64(*columns)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))
    return F.broadcast(ids.select(F.pmod(h, F.lit(BUCKETS)).cast("int").alias("bucket"), bit.alias("bit")).groupBy("bucket").agg(F.bit_or("bit").alias("mask")))


def marked(rows: DataFrame, held: DataFrame, *columns: str, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: whether the ids of ``held`` may have the row's columns."""
    bucket, mask = f"{name}_bucket", f"{name}_mask"
    joined = rows.withColumn(bucket, F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")).join(held.withColumnsRenamed({"bucket": bucket, "mask": mask}), bucket, "left")
    bit = F.call_function("shiftrightunsigned", F.col(mask), F.shiftrightunsigned(F.xxhash64(*columns), 58).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return joined.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop(bucket, mask)


def only(rows: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """The rows that ``ids`` may hold, without a shuffle: what a join with them needs, and few more
    as long as the ids are few against ``64 * BUCKETS``."""
    name = "held_"
    while any(c.lower().startswith(name) for c in rows.columns):
        name += "_"
    return marked(rows, masks(ids, *columns), *columns, name=name).where(name).drop(name)
