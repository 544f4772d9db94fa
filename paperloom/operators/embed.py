"""Embedding: pluggable vectorised providers behind a cache by content hash."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ensure_importable
from .changes import cache_split

Embed = Callable[[list[str]], np.ndarray]


def hash_vectors(texts: list[str], dimension: int = 8) -> np.ndarray:
    """The offline default: the first bytes of each text's SHA-256, in [0, 1]."""
    rows = [b"".join(hashlib.sha256(t.encode() + bytes([k] if k else [])).digest() for k in range(-(-dimension // 32)))[:dimension] for t in texts]
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(texts), dimension).astype(np.float32) / np.float32(255)


def bag_vectors(texts: list[str], dimension: int = 256) -> np.ndarray:
    """Hashed words, square roots of counts, unit length: a lexical embedding that needs no model."""
    import re
    import zlib

    out = np.zeros((len(texts), dimension), np.float32)
    for k, t in enumerate(texts):
        for w in re.findall(r"\w+", t.lower()):
            h = zlib.crc32(w.encode())
            out[k, h % dimension] += 1
    out = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


#: name -> (vectors of texts, dimension, tokens that a text may have).
PROVIDERS: dict[str, tuple[Embed, int, int]] = {"hash-8": (hash_vectors, 8, 1 << 20), "bag-256": (bag_vectors, 256, 1 << 20)}
#: Short names of local models, with their dimensions; these read 512 tokens.
PRESETS = {f"bge-{size}-en": (f"BAAI/bge-{size}-en-v1.5", n) for size, n in (("small", 384), ("base", 768), ("large", 1024))}
#: service -> (address, model -> (dimension, tokens of a text), what its requests say besides model and input).
SERVICES: dict[str, tuple[str, dict[str, tuple[int, int]], dict]] = {
    "openai": ("https://api.openai.com/v1/embeddings", {"text-embedding-3-small": (1536, 8191), "text-embedding-3-large": (3072, 8191), "text-embedding-ada-002": (1536, 8191)}, {}),
    "voyage": ("https://api.voyageai.com/v1/embeddings", {"voyage-3": (1024, 32_000), "voyage-3-lite": (512, 32_000), "voyage-code-3": (1024, 32_000)}, {"input_type": "document"}),
    "jina": ("https://api.jina.ai/v1/embeddings", {"jina-embeddings-v3": (1024, 8192), "jina-embeddings-v2-base-en": (768, 8192)}, {"task": "retrieval.passage"}),
}
_last_call: dict[str, float] = {}


def _post(url: str, key: str, body: dict) -> dict:
    ask = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    with urllib.request.urlopen(ask, timeout=60) as answer:
        return json.load(answer)


def register_service(service: str, model: str, key: str = "", name: str | None = None, dimensions: int | None = None, per_second: float = 0.0, post: Callable[[str, str, dict], dict] = _post, address: str | None = None) -> str:
    """Registers a remote model under a name (by default its own). Each Python worker asks at most per_second times a
    second (0: as often as it likes); connection errors are tried again by embed_texts(). Returns the name."""
    if service not in SERVICES:
        raise ValueError(f"unknown embedding service {service}; known: {', '.join(sorted(SERVICES))}")
    url, models, more = SERVICES[service]
    if model not in models and dimensions is None:
        raise ValueError(f"{service} has no model {model}; known: {', '.join(sorted(models))}")
    size, tokens = models.get(model, (dimensions, 8192))
    body = {"model": model, **more} | ({"dimensions": dimensions} if dimensions and dimensions != size else {})
    where = address or url

    def embed(texts: list[str]) -> np.ndarray:
        if per_second > 0:
            wait = _last_call.get(where, 0.0) + 1 / per_second - time.monotonic()
            if wait > 0:
                time.sleep(wait)
            _last_call[where] = time.monotonic()
        rows = sorted(post(where, key, body | {"input": texts})["data"], key=lambda r: r["index"])
        return np.array([r["embedding"] for r in rows], np.float32)

    register(name or model, embed, dimensions or size, tokens)
    return name or model


def register_local(model: str = "bge-base-en", name: str | None = None, load: Callable[[str], Any] | None = None) -> str:
    """Registers a model that each Python worker loads once, by a preset's name or its own; vectors have unit length.

    load(model) gives an object with encode(texts, normalize_embeddings=True); by default the sentence-transformers
    library does, which must be installed where tasks run.
    """
    full, size = PRESETS.get(model, (model, 0))

    def embed(texts: list[str]) -> np.ndarray:
        return np.asarray(_loaded(full, load).encode(texts, normalize_embeddings=True), np.float32)

    register(name or model, embed, size, 512)
    return name or model


_models: dict[str, Any] = {}


def _loaded(model: str, load: Callable[[str], Any] | None) -> Any:
    if model not in _models:
        if load is None:
            from sentence_transformers import SentenceTransformer as load
        _models[model] = load(model)
    return _models[model]


def register(name: str, embed: Embed, dimension: int, max_tokens: int = 8192) -> None:
    PROVIDERS[name] = (embed, dimension, max_tokens)


def provider(name: str) -> tuple[Embed, int, int]:
    if name not in PROVIDERS:
        raise ValueError(f"unknown embedding provider {name}; known: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name]


def embed_texts(rows: DataFrame, model: str, text: str = "content", batch: int = 64, attempts: int = 3) -> DataFrame:
    """rows with `vector`, in batches; a batch that fails is tried again, and rows without a vector go."""
    ensure_importable(rows.sparkSession)
    call, _, _ = provider(model)

    def vectors(some: list[str]) -> list:
        for k in range(attempts):
            try:
                return [None if v is None else np.asarray(v, np.float32) for v in call(some)]
            except OSError:
                if k + 1 == attempts:
                    return [None] * len(some)
        return []

    @F.arrow_udf("array<float>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            # texts leave Arrow and vectors enter it a few at a time: what Python holds doesn't grow with the part's rows
            for at in range(0, len(part), 16 * batch):
                some = part.slice(at, 16 * batch)
                yield pa.concat_arrays([pa.array(vectors([t or "" for t in some.slice(k, batch).to_pylist()]), pa.list_(pa.float32())) for k in range(0, len(some), batch)])
            some = part = None  # before the next one is read

    # said to be non-deterministic so that the filter doesn't run it a second time
    return rows.withColumn("vector", run.asNondeterministic()(text)).filter("vector is not null and size(vector) > 0")


def embed_chunks(chunks: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors, rows for the cache). Equal texts are embedded once, those of the cache not at all."""
    split = cache_split(chunks, cache, model)
    hits = split.filter("cached_vector is not null").withColumnRenamed("cached_vector", "vector")
    misses = split.filter("cached_vector is null").drop("cached_vector")
    once = misses.filter("content_hash is not null").groupBy("content_hash").agg(F.any_value("content").alias("content"))
    fresh = embed_texts(once, model).select("content_hash", "vector")
    nameless = embed_texts(misses.filter("content_hash is null"), model)
    done = misses.join(fresh, "content_hash")
    rows = fresh.select(F.lit(model).alias("model_name"), "content_hash", "vector", F.current_timestamp().alias("created_at"))
    return hits.unionByName(done).unionByName(nameless.select(*done.columns)), rows
