"""Schemas of the catalog's tables and of results."""

from __future__ import annotations

MODELS = "id long, source string, identifier string, dimensions int"
CORPORA = "id long, name string, description string, model_id long, created_at timestamp"
#: path is the displayed name, source_path where the entry came from.
FILES = "id long, corpus_id long, path string, source_path string, description string, mtime double, size long, chunk_count int, token_count long, indexed_at timestamp"
CHUNKS = "id long, corpus_id long, file_id long, text string, position int, start_offset int, end_offset int"
EMBEDDINGS = "corpus_id long, file_id long, chunk_id long, embedding array<float>"
#: The full-text index: a row per term and chunk, with the term's and all tokens of the chunk.
POSTINGS = "corpus_id long, file_id long, chunk_id long, term string, tf int, len int"
TABLES = {"models": MODELS, "corpora": CORPORA, "files": FILES, "chunks": CHUNKS, "embeddings": EMBEDDINGS, "postings": POSTINGS}
CHUNK_STRUCT = "array<struct<text: string, position: int, start_offset: int, end_offset: int>>"
MODEL_SOURCES = ("native", "hf", "local")
#: Columns without which a row can't be read; such rows are left out.
REQUIRED = {
    "models": ("id", "source", "identifier", "dimensions"), "corpora": ("id", "name", "model_id", "created_at"), "files": ("id", "corpus_id", "path", "mtime", "size", "chunk_count", "indexed_at"),
    "chunks": ("id", "file_id", "text", "position"), "embeddings": ("chunk_id", "embedding"), "postings": ("chunk_id", "term", "tf", "len"),
}
