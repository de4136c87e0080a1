"""Operators that prepare text and units for language models. Nothing outside this package imports it."""
