"""Embedding surface: any batch embedder as an Arrow UDF, with batching, alignment checks and retries."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from docloom.shipping import ship

# Fixed values.
BATCH = 100
TRIES = 5
RETRIED_STATUS = (408, 409, 429)


class EmbeddingUnavailable(RuntimeError):
    """The provider failed; its details stay out of the message."""


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class CharBucketEmbedder:
    """Deterministic: counts of code points modulo dim, scaled to unit length; a zero vector stays."""

    def __init__(self, dim: int = 128):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % self.dim, minlength=self.dim).astype(float)
            size = np.sqrt((v * v).sum())
            out.append((v / size if size else v).tolist())
        return out


def _transient(error: Exception) -> bool:
    status = getattr(error, "status", None) or getattr(error, "code", None)
    if isinstance(status, int):
        return status in RETRIED_STATUS or status >= 500
    return isinstance(error, (TimeoutError, ConnectionError))


def embed_all(embedder: Embedder, texts: list[str], prefix: str = "", batch: int = BATCH, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Vectors in the order of texts; a batch whose count differs is an error, never a shift."""
    out: list[list[float]] = []
    for i in range(0, len(texts), batch):
        part = [prefix + t for t in texts[i : i + batch]]
        for attempt in range(tries):
            try:
                got = embedder.embed(part)
                break
            except Exception as e:
                if attempt + 1 == tries or not _transient(e):
                    raise EmbeddingUnavailable("the embedding service is unavailable") from e
                sleep(2**attempt * (1 + random.random() / 10))
        if len(got) != len(part):
            raise EmbeddingUnavailable("the embedding service returned another number of vectors")
        out += got
    return out


def embedded(text: Column, embedder: Embedder, prefix: str = "") -> Column:
    ship(SparkSession.active())

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(embed_all(embedder, s.fillna("").tolist(), prefix), index=s.index, dtype=object)

    return run(text)


def embedded_or_error(text: Column, embedder: Embedder, prefix: str = "") -> Column:
    """struct<embedding, error>: a batch that fails, retries included, is tried once more text by text, so that an error stays with its own texts."""

    ship(SparkSession.active())

    @F.pandas_udf("embedding array<float>, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(t: str) -> tuple:
            try:
                return embed_all(embedder, [t], prefix, tries=1)[0], None
            except Exception as e:
                return None, type(e).__name__

        for s in parts:
            s = s.fillna("")
            try:
                rows = [(v, None) for v in embed_all(embedder, s.tolist(), prefix)]
            except Exception:
                rows = [one(t) for t in s]
            yield pd.DataFrame(rows, columns=["embedding", "error"], dtype=object)

    return run(text)


def embed_query(embedder: Embedder, query: str, prefix: str = "") -> list[float]:
    return embed_all(embedder, [query], prefix)[0]
