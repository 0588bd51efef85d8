"""Plans of the corpus-construction engine."""
