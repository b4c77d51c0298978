"""Model back ends as interfaces over columns, with deterministic stand-ins that need no network.

A real back end subclasses one of these and returns a pandas UDF's column; it is then called in
Arrow batches. Nothing else in the library knows which one is at work.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t


class Embedder(ABC):
    """Texts to vectors."""

    name: str

    @abstractmethod
    def embed(self, text: Column) -> Column: ...


class HashEmbedder(Embedder):
    """Counts of tokens by a hash: equal words are near, at no cost."""

    def __init__(self, width: int = 16) -> None:
        self.name, self.width = f"hash-{width}", width

    def embed(self, text: Column) -> Column:
        return t.hashed_embedding(text, self.width)


class Reranker(ABC):
    """A score in [0, 1] for a query and a text."""

    @abstractmethod
    def score(self, query: Column, text: Column) -> Column: ...


class OverlapReranker(Reranker):
    """The sigmoid of the share of the query's tokens that the text has."""

    def score(self, query: Column, text: Column) -> Column:
        asked = F.array_distinct(t.tokens(query))
        share = F.size(F.array_intersect(asked, t.tokens(text))) / F.greatest(F.size(asked), F.lit(1))
        return F.round(1 / (1 + F.exp(-(4 * share - 2))), 6)


class TextModel(ABC):
    """A prompt to a text."""

    @abstractmethod
    def generate(self, prompt: str, temperature: float = 0.0, max_tokens: int = 512) -> str: ...


class Scripted(TextModel):
    """Answers by a function: tests and offline runs."""

    def __init__(self, answer: Callable[[str], str]) -> None:
        self.answer = answer

    def generate(self, prompt: str, temperature: float = 0.0, max_tokens: int = 512) -> str:
        return self.answer(prompt)


def salvage(raw: str) -> dict | None:
    """The JSON object in an answer, or from its first { to its last }."""
    for x in (raw, raw[raw.find("{") : raw.rfind("}") + 1] if "{" in raw else ""):
        try:
            if isinstance(out := json.loads(x), dict):
                return out
        except ValueError:
            continue
    return None


def generate_object(model: TextModel, prompt: str, temperature: float = 0.0, max_tokens: int = 512) -> dict:
    """An answer's JSON object; an answer without one is given back once for repair."""
    raw = model.generate(prompt, temperature, max_tokens)
    if (out := salvage(raw)) is None:
        out = salvage(model.generate(f"Return the following as one valid JSON object, and nothing else:\n{raw}", 0.0, max_tokens))
    if out is None:
        raise ValueError("the model's answer holds no JSON object")
    return out
