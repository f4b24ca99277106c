"""Embedders, and their use on a text column."""

from __future__ import annotations

import hashlib
import json
import math
import struct
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError, invalid


class Embedder(Protocol):
    name: str
    dimensions: int

    def embed(self, text: str) -> list[float]: ...

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class DeterministicEmbedder:
    """A unit vector that depends on the text's hash alone; for tests and offline use."""

    def __init__(self, dimensions: int = 384, name: str = "deterministic"):
        if dimensions <= 0:
            raise invalid("dimensions must be positive")
        self.dimensions, self.name = dimensions, name

    def embed(self, text: str) -> list[float]:
        base = hashlib.sha256((text or "").encode()).digest()
        raw = [struct.unpack("<i", hashlib.sha256(base + struct.pack("<I", i)).digest()[:4])[0] / 2147483648.0 for i in range(self.dimensions)]
        norm = math.sqrt(sum(x * x for x in raw))
        return [x / norm for x in raw] if norm else raw

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self.embed(t) for t in texts]


class HttpEmbedder:
    """An embedder behind a JSON endpoint; `style` says how requests and answers are laid out (openai or ollama)."""

    def __init__(self, url: str, model: str, dimensions: int, style: str = "openai", key: str | None = None, timeout: float = 30.0):
        if style not in ("openai", "ollama"):
            raise invalid("unknown endpoint style")
        if dimensions <= 0:
            raise invalid("dimensions must be positive")
        self.url, self.name, self.dimensions, self.style, self._key, self.timeout = url, model, dimensions, style, key, timeout

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self._key}"} if self._key else {})
        ask = urllib.request.Request(self.url, json.dumps({"model": self.name, "input": texts}).encode(), head)
        with urllib.request.urlopen(ask, timeout=self.timeout) as got:
            body = json.load(got)
        out = [d["embedding"] for d in sorted(body["data"], key=lambda d: d["index"])] if self.style == "openai" else body["embeddings"]
        if len(out) != len(texts) or any(len(v) != self.dimensions for v in out):
            raise EngineError("DimensionMismatch", "the endpoint's vectors have other dimensions")
        return out


class LocalModelEmbedder:
    """A sentence-transformers model, where that library is installed."""

    def __init__(self, model: str):
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise invalid("sentence-transformers is not installed") from e
        self._model, self.name = SentenceTransformer(model), model
        self.dimensions = int(self._model.get_sentence_embedding_dimension())

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [[float(x) for x in v] for v in self._model.encode(texts)]


def embed_column(embedder: Embedder, text: Column) -> Column:
    """Embeddings of a text column in Arrow batches; null texts embed as empty."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(embedder.embed_batch([t or "" for t in s]))

    return run(text)


def check_model(embedder: Embedder, model: str, dims: int) -> None:
    if embedder.name != model or embedder.dimensions != dims:
        raise invalid("the embedder's model or dimensions differ from the store's")
