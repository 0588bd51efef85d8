"""Corpus construction, alignment gating and provenance on PySpark DataFrames."""
