"""Sources of the corpus-construction engine."""
