"""Cairn: a PySpark engine for append-only archive ledgers and the corpora kept in them."""
