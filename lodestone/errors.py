"""Typed errors."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors with a message for the user."""


class CorpusNotFound(EngineError):
    def __init__(self, name: str):
        super().__init__(f"No corpus is named '{name}'.")


class CorpusAlreadyExists(EngineError):
    def __init__(self, name: str):
        super().__init__(f"There is already a corpus named '{name}'.")


class ConcurrentChange(EngineError):
    def __init__(self):
        super().__init__("The catalog was changed by someone else meanwhile; nothing was done.")


class FileNotIndexed(EngineError):
    def __init__(self, path: str):
        super().__init__(f"The corpus has no entry '{path}'.")


class PathNotFound(EngineError):
    def __init__(self, path: str):
        super().__init__(f"There is no file or folder at '{path}'.")


class ModelNotFound(EngineError):
    def __init__(self, what: str):
        super().__init__(f"The model '{what}' can't be found.")


class ModelNotCompatible(EngineError):
    def __init__(self, what: str):
        super().__init__(f"The model '{what}' can't be used here.")


class ModelLoadFailed(EngineError):
    def __init__(self, why: str):
        super().__init__(f"The model can't be loaded: {why}")


class InvalidModelSpec(EngineError):
    def __init__(self, spec: str):
        super().__init__(f"'{spec}' is no model: use native, hf:<owner/name> or local:<path>.")


class UnsupportedFileType(EngineError):
    def __init__(self, kind: str):
        super().__init__(f"Files of type '{kind}' can't be converted.")


class DimensionMismatch(EngineError):
    def __init__(self, expected: int, found: int):
        super().__init__(f"A vector has {found} dimensions, the corpus {expected}.")


class DatabaseError(EngineError):
    def __init__(self, why: str):
        super().__init__(f"The catalog can't be used: {why}")


class NetworkError(EngineError):
    def __init__(self, why: str):
        super().__init__(f"The network can't be used: {why}")
