"""Linkage of a stream of source rows against a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kinweave.operators.cascade import cascade
from kinweave.plans.spec import LinkageSpec, Storage
from kinweave.plans.staging import _path, release
from kinweave.sources.index import TextIndex
from kinweave.sources.tables import union_phases


def link_stream(source: DataFrame, index: TextIndex, spec: LinkageSpec, output: Storage, checkpoint: str, **trigger) -> StreamingQuery:
    """Run the cascade on each micro-batch and append its pairs under ``batch=<id>``.

    A batch that is tried again replaces its own folder, so each source row is linked once.
    """

    def link(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            where, found = f"{output.path.rstrip('/')}/batch={number}", [r.linked for r in cascade(batch, index, spec) if r.linked is not None]
            if found:
                union_phases(found).write.mode("overwrite").format(output.format).options(**output.options).save(where)
            else:
                path, fs = _path(batch.sparkSession, where)
                fs.delete(path, True)
            for linked in found:
                release(linked)
        finally:
            batch.unpersist()

    return source.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
