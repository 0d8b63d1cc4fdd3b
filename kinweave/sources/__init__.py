"""Scans, sinks and the text index tables."""
