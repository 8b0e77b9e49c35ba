"""Clients of embedding and chat services over HTTP, made in each Python worker; retries and fall-back are those of `embedding`."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass

from quarryline.operators.embedding import register


def post(url: str, body: Mapping, headers: Mapping[str, str] | None = None, timeout: float = 30.0) -> dict:
    """The JSON answer to a JSON request. An answer that is no success raises OSError with its status and text."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        raise OSError(f"{e.code}: {e.read().decode('utf-8', 'replace')[:500]}") from e


@dataclass
class LocalEmbedder:
    """A local model server: one request for each text."""

    base_url: str = ""
    model: str = "nomic-embed-text"
    name: str = "ollama"
    dimensions: int = 768
    max_tokens: int = 8192
    timeout: float = 10.0

    def embed(self, texts: list[str]) -> list[list[float]]:
        base = (self.base_url or os.environ.get("OLLAMA_BASE_URL") or "http://localhost:11434").rstrip("/")
        return [post(f"{base}/api/embeddings", {"model": self.model, "prompt": t}, timeout=self.timeout)["embedding"] for t in texts]


@dataclass
class CloudEmbedder:
    """A hosted service: one request for a batch of texts; the key comes from the environment of the worker."""

    base_url: str = "https://api.openai.com"
    model: str = "text-embedding-3-small"
    key_variable: str = "OPENAI_API_KEY"
    name: str = "openai"
    dimensions: int = 1536
    max_tokens: int = 8192
    timeout: float = 30.0

    def embed(self, texts: list[str]) -> list[list[float]]:
        key = os.environ.get(self.key_variable)
        if not key:
            raise OSError(f"no key: {self.key_variable} is not set")
        answer = post(f"{self.base_url}/v1/embeddings", {"model": self.model, "input": texts}, {"Authorization": f"Bearer {key}"}, self.timeout)
        return [d["embedding"] for d in answer["data"]]


def complete(prompt: str, base_url: str = "", model: str = "qwen2:1.5b", timeout: float = 120.0) -> str:
    """The answer of a local chat model to a prompt (see the prompts that retrieval puts together)."""
    base = (base_url or os.environ.get("OLLAMA_BASE_URL") or "http://localhost:11434").rstrip("/")
    return post(f"{base}/api/generate", {"model": model, "prompt": prompt, "stream": False}, timeout=timeout).get("response", "")


register("ollama", LocalEmbedder)
register("openai", CloudEmbedder)
