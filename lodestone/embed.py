"""Embedders: a small protocol, a deterministic built-in one, and the registry of model specs."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import InvalidModelSpec, ModelNotCompatible, ModelNotFound
from .operators import bm25


class Embedder(Protocol):
    source: str
    identifier: str
    dimensions: int
    max_input_tokens: int

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of folded tokens and their neighbours, of length one; a text without a
    token is zeros.  It stands for the platform model of the built-in spec, with its sizes."""

    source, identifier, dimensions, max_input_tokens = "native", "native", 512, 512

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts):
            for term, n in bm25.query_terms(text or "").items():
                h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little")
                row[h % self.dimensions] += (1 if h >> 63 else -1) * (1 + np.log(n))
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.where(size > 0, out / np.where(size > 0, size, 1), out)


_REGISTRY: dict[str, Callable[[str], Embedder]] = {"native": lambda _: HashingEmbedder()}


def register(source: str, make: Callable[[str], Embedder]) -> None:
    """Make ``source:<identifier>`` specs resolve through ``make(identifier)``."""
    _REGISTRY[source] = make


def spec_of(source: str, identifier: str) -> str:
    return "native" if source == "native" else f"{source}:{identifier}"


def parse_spec(spec: str) -> tuple[str, str]:
    if spec == "native":
        return "native", "native"
    source, _, rest = spec.partition(":")
    if source not in ("hf", "local") or not rest:
        raise InvalidModelSpec(spec)
    return source, os.path.expanduser(rest) if source == "local" else rest


def resolve(spec: str) -> Embedder:
    source, identifier = parse_spec(spec)
    if source == "local" and not os.path.exists(identifier):
        raise ModelNotFound(identifier)
    if source not in _REGISTRY:
        raise ModelNotCompatible(spec)
    return _REGISTRY[source](identifier)


def select_model_files(names: list[str]) -> list[str]:
    """Files of a hub repository that a model needs: the first package folder, else the first single
    model file, and the tokenizer's files."""
    packages = sorted({n.split(".mlpackage/")[0] + ".mlpackage" for n in names if ".mlpackage/" in n})
    model = [n for n in names if n.startswith(packages[0] + "/")] if packages else sorted(n for n in names if n.endswith(".mlmodel"))[:1]
    wanted = {"vocab.txt", "tokenizer.json", "tokenizer_config.json", "config.json", "special_tokens_map.json"}
    return model + [n for n in names if n in wanted]


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows of length one; zeros stay."""
    v = np.asarray(v, np.float64)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.where(size > 0, v / np.where(size > 0, size, 1), v)


def embed(text, embedder: Embedder, batch: int = 16) -> Column:
    """Vectors of length one (or zero) of a text column: Arrow batches, handed to the embedder in parts."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            rows = [v for a in range(0, len(texts), batch) for v in unit_rows(embedder.embed_batch(texts[a:a + batch]))]
            yield pd.Series(rows, dtype=object)

    return run(text)
