"""Operators for building language-model training corpora. Nothing else in the package imports this."""
