"""Specifications, staging and orchestration of linkage plans."""
