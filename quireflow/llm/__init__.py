"""Operators that prepare text collections for language-model training. Nothing outside this package imports it."""
