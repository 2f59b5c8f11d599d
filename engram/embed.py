"""Embedders: the protocol, deterministic ones for offline use, an HTTP one, and their use in a plan."""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from engram.errors import EmbedderError
from engram.validate import DEFAULT_DIM, check_dim

# Fixed values of the HTTP embedder.
MAX_RETRIES, BASE_DELAY_SECONDS = 3, 0.5
DEFAULT_HOST = "http://localhost:11434"
HOST_VARIABLE = "OLLAMA_HOST"  # the variable that the public server of this interface reads


class Embedder(Protocol):
    dim: int

    def embed(self, text: str) -> list[float]: ...

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]: ...


def check_vectors(vectors: Any, count: int, dim: int) -> list[list[float]]:
    """One finite vector of the right length per text, or an error."""
    if not isinstance(vectors, Sequence) or len(vectors) != count:
        got = len(vectors) if isinstance(vectors, Sequence) else type(vectors).__name__
        raise EmbedderError(f"embedder returned {got} embeddings for {count} texts")
    for i, v in enumerate(vectors):
        if not isinstance(v, Sequence) and not isinstance(v, np.ndarray):
            raise EmbedderError(f"embedding[{i}] must be an array")
        if len(v) != dim:
            raise EmbedderError(f"the embedder gives {len(v)} values where dim={dim} is configured")
        for j, x in enumerate(v):
            if not math.isfinite(x):
                raise EmbedderError(f"embedding[{i}][{j}] must be finite")
    return [[float(x) for x in v] for v in vectors]


class _Base:
    dim: int

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        raise NotImplementedError


@dataclass
class HashingEmbedder(_Base):
    """Words hashed into signed buckets, normalised; the same text always gives the same vector."""

    dim: int = DEFAULT_DIM

    def __post_init__(self) -> None:
        self.dim = check_dim(self.dim, low=1, high=8_192)

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                row[h % self.dim] += 1.0 if h >> 63 else -1.0
            norm = np.linalg.norm(row)
            if norm:
                row /= norm
        return out.tolist()


@dataclass
class KeywordEmbedder(_Base):
    """1 where a keyword occurs, else 0."""

    keywords: Sequence[str]

    def __post_init__(self) -> None:
        self.dim = len(self.keywords)

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        return [[float(k in t.lower()) for k in self.keywords] for t in texts]


@dataclass
class HttpEmbedder(_Base):
    """POST {host}/api/embed with model and input (host: as given, else from the environment, else local); 429 and 5xx are tried again after 0.5, 1 and 2 seconds, network
    errors are not."""

    model: str = "nomic-embed-text"
    host: str = ""
    dim: int = DEFAULT_DIM
    opener: Callable[[urllib.request.Request], Any] | None = field(default=None, repr=False)
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)

    def __post_init__(self) -> None:
        self.dim = check_dim(self.dim)
        host = self.host or os.environ.get(HOST_VARIABLE, "").strip() or DEFAULT_HOST
        self.host = host if "://" in host else f"http://{host}"

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        if not texts:
            return []
        body = json.dumps({"model": self.model, "input": list(texts)}).encode()
        request = urllib.request.Request(f"{self.host.rstrip('/')}/api/embed", body, {"Content-Type": "application/json"})
        answer = self._answer(request)
        if not isinstance(answer, dict) or not isinstance(answer.get("embeddings"), list):
            raise EmbedderError('the embedding server answered without a list of embeddings')
        return check_vectors(answer["embeddings"], len(texts), self.dim)

    def _answer(self, request: urllib.request.Request) -> Any:
        for attempt in range(MAX_RETRIES + 1):
            try:
                with (self.opener or urllib.request.urlopen)(request) as response:
                    return json.loads(response.read())
            except urllib.error.HTTPError as e:
                if (e.code == 429 or e.code >= 500) and attempt < MAX_RETRIES:
                    self.sleep(BASE_DELAY_SECONDS * 2**attempt)
                    continue
                raise EmbedderError(f"the embedding server refused: {e.code} {e.reason}") from e
            except (OSError, ValueError) as e:
                raise EmbedderError(f"no answer from the embedding server at {self.host}: {e}") from e
        raise EmbedderError(f"the embedding server at {self.host} kept failing")


class LocalEmbedder(_Base):
    """A model loaded once, at first use; a failed load is tried again at the next use. ``load`` returns a function from
    one text to its vectors by token (they are averaged and normalised)."""

    def __init__(self, load: Callable[[], Callable[[str], Any]], dim: int = DEFAULT_DIM):
        self.dim, self._load, self._model = check_dim(dim), load, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_model": None}

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        if not texts:
            return []
        if self._model is None:
            try:
                self._model = self._load()
            except Exception as e:
                raise EmbedderError(f"the embedding model failed to load: {e}") from e
        out = []
        for text in texts:
            v = np.asarray(self._model(text), dtype=np.float64)
            v = v.mean(axis=0) if v.ndim == 2 else v
            out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
        return check_vectors(out, len(texts), self.dim)

    def close(self) -> None:
        self._model = None


def onnx_loader(folder: str, max_tokens: int = 512) -> Callable[[], Callable[[str], Any]]:
    """Loads model.onnx and tokenizer.json from a folder; the model gives one vector for each token of a text."""

    def load() -> Callable[[str], Any]:
        import onnxruntime
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(os.path.join(folder, "tokenizer.json"))
        tokenizer.enable_truncation(max_tokens)
        session = onnxruntime.InferenceSession(os.path.join(folder, "model.onnx"))
        names = {i.name for i in session.get_inputs()}

        def run(text: str):
            found = tokenizer.encode(text)
            ids = np.array([found.ids], dtype=np.int64)
            feed = {"input_ids": ids, "attention_mask": np.ones_like(ids), "token_type_ids": np.zeros_like(ids)}
            return session.run(None, {k: v for k, v in feed.items() if k in names})[0][0]

        return run

    return load


def create_embedder(config: dict) -> Embedder:
    """By engine: http (model, host, dim), hashing (dim), local (model: a folder with model.onnx and tokenizer.json, dim)."""
    engine = config.get("engine")
    rest = {k: v for k, v in config.items() if k != "engine" and v is not None}
    if engine == "http":
        return HttpEmbedder(**{k: v for k, v in rest.items() if k in ("model", "host", "dim")})
    if engine == "hashing":
        return HashingEmbedder(**{k: v for k, v in rest.items() if k == "dim"})
    if engine == "local":
        if not rest.get("model"):
            raise EmbedderError("a local embedder needs the folder of its model")
        return LocalEmbedder(onnx_loader(rest["model"]), rest.get("dim", DEFAULT_DIM))
    raise EmbedderError(f"unknown embedder engine {engine!r}")


def with_embeddings(rows: DataFrame, embedder: Embedder, text_col: str = "text", name: str = "embedding") -> DataFrame:
    """Adds the vector of each text, in Arrow batches; vectors are checked, a null text gives a null vector."""
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            some = [t for t in texts if t is not None]
            found = iter(check_vectors(embedder.embed_batch(some), len(some), embedder.dim) if some else [])
            vectors = pa.array([None if t is None else next(found) for t in texts], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*b.columns, vectors], names=[*b.schema.names, name])

    return rows.mapInArrow(step, schema)
