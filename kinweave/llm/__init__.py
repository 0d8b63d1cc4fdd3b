"""Operators of a training-data pipeline. Nothing else in kinweave imports this package."""
