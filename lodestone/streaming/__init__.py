"""Incremental indexing of a watched folder."""
