"""Configuration: defaults, then a file, then the environment; checked before use."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field

#: Variables of the environment, the setting each gives, and its type.
VARIABLES = {"QUARRYLINE_PROVIDER": ("provider", str), "QUARRYLINE_CHUNK_SIZE": ("chunk_size", int), "QUARRYLINE_CHUNK_OVERLAP": ("chunk_overlap", int), "QUARRYLINE_BATCH_SIZE": ("batch_size", int), "QUARRYLINE_MAX_FILE_SIZE": ("max_file_size", int), "QUARRYLINE_EXCLUDE": ("exclude", list)}


@dataclass(frozen=True)
class Config:
    provider: str = "hash"
    chunk_size: int = 4000
    chunk_overlap: int = 600
    batch_size: int = 50
    max_file_size: int = 1_572_864
    exclude: tuple[str, ...] = field(default=())

    def errors(self) -> list[str]:
        """What keeps the configuration from being used; empty if nothing does."""
        out = []
        if self.chunk_size < 1:
            out.append("chunk_size must be at least 1")
        if not 0 <= self.chunk_overlap < max(1, self.chunk_size):
            out.append("chunk_overlap must be from 0 to below chunk_size")
        if not 1 <= self.batch_size <= 1000:
            out.append("batch_size must be from 1 to 1000")
        if self.max_file_size < 1:
            out.append("max_file_size must be at least 1")
        return out


def merged(base: Mapping, *over: Mapping) -> dict:
    """Nested mappings merged key by key; later ones win, None does not replace a value."""
    out = dict(base)
    for layer in over:
        for k, v in layer.items():
            if isinstance(v, Mapping) and isinstance(out.get(k), Mapping):
                out[k] = merged(out[k], v)
            elif v is not None or k not in out:
                out[k] = v
    return out


def load(path: str | None = None, environment: Mapping[str, str] | None = None) -> Config:
    """Defaults, then the JSON file at path (if any), then the environment. Raises ValueError where errors() is not empty."""
    values: dict = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            values = json.load(f)
    env = os.environ if environment is None else environment
    found = {name: ([x for x in env[k].split(",") if x] if kind is list else kind(env[k])) for k, (name, kind) in VARIABLES.items() if k in env}
    known = {k: v for k, v in merged(values, found).items() if k in Config.__dataclass_fields__}
    config = Config(**(known | ({"exclude": tuple(known["exclude"])} if "exclude" in known else {})))
    if config.errors():
        raise ValueError("; ".join(config.errors()))
    return config


def version_key(version: str) -> tuple[int, ...]:
    """Numbers of a version for comparison; missing and odd parts are 0."""
    return tuple(int(x) if x.isdigit() else 0 for x in (version.split(".") + ["0"] * 4)[:4])


#: Limits of requests and retries that a provider without its own gets.
RATE_LIMITS = {
    "openai": {"requestsPerMinute": 3000, "tokensPerMinute": 1_000_000, "concurrentRequests": 5, "retry": {"maxRetries": 3, "baseDelay": 1000, "maxDelay": 30_000, "jitter": True, "backoffMultiplier": 2}},
    "ollama": {"requestsPerMinute": 60, "concurrentRequests": 2, "retry": {"maxRetries": 2, "baseDelay": 500, "maxDelay": 5000, "jitter": True, "backoffMultiplier": 2}},
    "huggingface": {"requestsPerMinute": 1000, "tokensPerMinute": 300_000, "concurrentRequests": 3, "retry": {"maxRetries": 3, "baseDelay": 2000, "maxDelay": 60_000, "jitter": True, "backoffMultiplier": 2}},
}
#: What each version added. A section is filled only where the one it belongs to is there; () is the whole.
ADDED = {
    ("0.1.0", "0.2.0"): [
        (("providers", "ollama"), {"type": "ollama", "baseUrl": "http://localhost:11434", "model": "nomic-embed-text", "textModel": "qwen2:1.5b", "dimensions": 768, "enabled": True}),
        (("providers", "openai"), {"type": "openai", "model": "text-embedding-3-small", "dimensions": 1536, "maxTokens": 8192, "enabled": True}),
        (("performance", "cache"), {"enabled": True, "maxSize": 100, "ttl": 3600, "type": "memory"}),
    ],
    ("0.2.0", "0.3.0"): [
        (("storage", "compression"), {"enabled": True, "algorithm": "gzip", "level": 6}),
        (("logging",), {"level": "info", "fileLogging": False, "maxFileSize": 10, "maxFiles": 5, "performanceLogging": False, "apiLogging": False}),
    ],
    ("0.3.0", "1.0.0"): [
        (("storage", "backup"), {"enabled": False, "interval": 24, "maxBackups": 7}),
        (("storage", "cleanup"), {"enabled": True, "maxAge": 30, "maxSize": 1024}),
        (("performance", "adaptiveBatching"), True),
    ],
}
#: What a plain list of exclusions became a part of in 0.3.0.
EXCLUSIONS = {
    "extensions": [".exe", ".dll", ".so", ".dylib", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".mp3", ".mp4", ".avi", ".mov", ".zip", ".tar", ".gz", ".rar"],
    "directories": [".git", "node_modules", ".vscode", ".idea", "dist", "build", "target", "bin", "obj"],
    "maxFileSize": 1024 * 1024,
    "minFileSize": 10,
}


def migrated(settings: Mapping, target: str = "1.0.0") -> dict:
    """Settings of an older version with what the versions up to `target` added; what is there stays. The argument is not changed.

    A missing version is 0.1.0. Raises ValueError where no step leads on from a version.
    """
    out = json.loads(json.dumps(settings))
    version = out.get("version") or "0.1.0"
    while version_key(version) < version_key(target):
        step = next((k for k in ADDED if k[0] == version), None)
        if step is None:
            raise ValueError(f"no step leads from version {version} to {target}")
        if step[0] == "0.1.0":
            out.setdefault("providers", {})
        for (*above, last), value in ADDED[step]:
            section = out
            for k in above:
                section = section.get(k) if isinstance(section, dict) else None
            if isinstance(section, dict) and (last not in section or section[last] is None):
                section[last] = json.loads(json.dumps(value))
        providers = [p for p in (out.get("providers") or {}).values() if isinstance(p, dict)]
        for p in providers:
            if step[0] == "0.1.0" and not p.get("rateLimit"):
                p["rateLimit"] = json.loads(json.dumps(RATE_LIMITS.get(p.get("type"), RATE_LIMITS["ollama"])))
            elif step[0] == "0.3.0" and isinstance(retry := (p.get("rateLimit") or {}).get("retry"), dict):
                retry.setdefault("jitter", True)
        if step[0] == "0.2.0" and isinstance(out.get("exclusions"), list):
            out["exclusions"] = {"patterns": out["exclusions"], **json.loads(json.dumps(EXCLUSIONS))}
        version = step[1]
    out["version"] = version if version_key(version) > version_key(target) else target
    return out
