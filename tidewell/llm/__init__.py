"""Corpus operators for large text tables. Nothing else in the library imports this subpackage."""
