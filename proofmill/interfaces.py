"""Extension points: retrievers, pack builders, models, stores, reasoning and validation back ends."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Literal, Protocol

from pyspark.sql import DataFrame

from proofmill.operators.retrieve import Retriever

__all__ = ["ModelAdapter", "PackBuilder", "ReasoningEngine", "Retriever", "StorageBackend", "Validator"]


class PackBuilder(Protocol):
    def __call__(self, results: DataFrame) -> DataFrame: ...


class ModelAdapter(Protocol):
    """Prompts in, JSON replies out; pickled to the executors."""

    def __call__(self, prompts: Iterator[str]) -> Iterator[str]: ...


class StorageBackend(Protocol):
    def store(self, chunks: DataFrame) -> None: ...
    def get(self, document_id: str, chunk_id: str) -> DataFrame: ...
    def delete_document(self, document_id: str) -> None: ...


class ReasoningEngine(Protocol):
    def answer(self, packs: DataFrame, mode: Literal["extract", "compare", "summarize", "explain"]) -> DataFrame: ...


class Validator(Protocol):
    def validate(self, answers: DataFrame, packs: DataFrame) -> DataFrame: ...
