"""Quire: a Spark library for document corpora (books, chapters, notes, resources)."""
