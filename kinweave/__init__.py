"""kinweave: record linkage, blocking search and clustering as Spark DataFrame plans."""

__version__ = "0.1.0"
