"""Operators of the corpus-construction engine."""
