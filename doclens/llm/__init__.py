"""Corpus operators for preparing language-model training data. Nothing else in doclens imports this package."""
