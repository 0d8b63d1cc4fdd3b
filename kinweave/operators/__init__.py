"""Relational operators: cleaning, blocking search, scoring, cascade, clustering."""
