"""Column functions: similarity, analysis, normalisation."""
