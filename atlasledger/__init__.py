"""Versioned, content-addressed tile-map catalogues on Spark DataFrames."""
