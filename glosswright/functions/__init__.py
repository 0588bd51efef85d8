"""Functions of the corpus-construction engine."""
