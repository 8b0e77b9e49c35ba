"""Embedding texts through plug-ins, with retries, fallbacks and a cache."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """A provider: its limits, and vectors for a list of texts."""

    name: str
    dimensions: int
    max_tokens: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class HashEmbedder:
    """Deterministic vectors without a network: hashed words with signs, of unit length (zero for no words)."""

    name: str = "hash"
    dimensions: int = 64
    max_tokens: int = 8192

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
                out[i, h % self.dimensions] += 1 if h >> 63 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=np.zeros_like(out), where=length > 0).tolist()


@dataclass
class Unavailable:
    """A provider that never answers, to rehearse the fall-back to the next one."""

    name: str = "unavailable"
    dimensions: int = 64
    max_tokens: int = 8192

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise OSError("not available")


#: Dimensions and token limits of known providers; their clients are given by the user.
PROVIDERS = {"ollama": (768, 8192), "openai": (1536, 8192), "huggingface": (384, 512), "cohere": (1024, 512)}
_registry: dict[str, Callable[[], Embedder]] = {"hash": HashEmbedder}


def register(name: str, factory: Callable[[], Embedder]) -> None:
    _registry[name] = factory


def create(name: str) -> Embedder:
    if name not in _registry:
        raise ValueError(f"unknown provider {name}; known are {', '.join(sorted(_registry))}")
    return _registry[name]()


def attempt(chain: list[Embedder], texts: list[str], tries: int = 3, base: float = 0.05, wait: Callable[[float], None] = time.sleep) -> tuple[list[list[float]] | None, str, str]:
    """(vectors, provider, error): each provider of the chain up to `tries` times with doubling pauses, then the next."""
    error = "no provider"
    for e in chain:
        for n in range(tries):
            try:
                return e.embed(texts), e.name, ""
            except Exception as x:  # a provider may raise anything
                error = f"{e.name}: {x}"
                if n + 1 < tries:
                    wait(base * 2**n)
    return None, "", error


def embedded(df: DataFrame, key: str, text: str, factory: Callable[[], list[Embedder]], batch: int = 50) -> DataFrame:
    """(key as string, embedding, provider, error): vectors of the texts; a batch that no provider could do has an error.

    Null texts and texts over the first provider's token limit (four characters a token) get an error and no vector. The
    providers are made once for each Python worker.
    """
    schema = pa.schema([("key", pa.string()), ("embedding", pa.list_(pa.float32())), ("provider", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = factory()
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows: list[tuple] = []
            good = []
            for k, t in zip(keys, texts):
                if t is None or -(-len(t) // 4) > chain[0].max_tokens:
                    rows.append((k, None, None, "no text" if t is None else "over the token limit"))
                else:
                    good.append((k, t))
            for at in range(0, len(good), batch):
                part = good[at : at + batch]
                vectors, name, error = attempt(chain, [t for _, t in part])
                rows += [(k, None if vectors is None else vectors[i], name or None, error or None) for i, (k, _) in enumerate(part)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), schema.types)], schema=schema)

    return df.select(F.col(key).cast("string"), text).mapInArrow(run, "key string, embedding array<float>, provider string, error string")


def with_cache(df: DataFrame, key: str, text: str, cache: DataFrame, factory: Callable[[], list[Embedder]], model: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their vectors, what the cache must gain): texts are looked up by (model, SHA-256); each different text that
    is not there is embedded once, however many rows have it."""
    keyed = df.withColumn("text_sha", F.sha2(text, 256))
    held = cache.where(F.col("model") == model).select(F.col("text_sha").alias("_h"), F.col("embedding").alias("_v"))
    wanted = keyed.where(F.col(text).isNotNull()).groupBy("text_sha").agg(F.first(text).alias("_t"))
    missing = wanted.join(held, F.col("text_sha") == F.col("_h"), "left_anti")
    fresh = embedded(missing, "text_sha", "_t", factory).where("embedding is not null").select(F.lit(model).alias("model"), F.col("key").alias("text_sha"), "embedding")
    every = held.unionByName(fresh.select(F.col("text_sha").alias("_h"), F.col("embedding").alias("_v")))
    return keyed.join(every, F.col("text_sha") == F.col("_h"), "left").withColumnRenamed("_v", "embedding").drop("_h"), fresh
