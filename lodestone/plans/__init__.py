"""The catalog of corpora, files, chunks and vectors, and what changes it."""
