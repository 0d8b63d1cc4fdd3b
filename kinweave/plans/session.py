"""Spark sessions from configuration."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Set unless the configuration says otherwise.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def create_session(app_name: str = "kinweave", configs: dict | None = None) -> SparkSession:
    """A session with the ``spark.`` keys of ``configs``; other keys are ignored."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **(configs or {})}.items():
        if key.startswith("spark."):
            builder = builder.config(key, str(value).lower() if isinstance(value, bool) else str(value))
    return builder.getOrCreate()


@contextmanager
def session(app_name: str = "kinweave", configs: dict | None = None) -> Iterator[SparkSession]:
    spark = create_session(app_name, configs)
    try:
        yield spark
    finally:
        spark.stop()
