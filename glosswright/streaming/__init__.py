"""Streaming of the corpus-construction engine."""
