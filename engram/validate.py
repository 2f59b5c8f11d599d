"""Rules for arguments and single records; everything here runs on the driver before any work is started."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from engram.errors import InvalidArgumentError
from engram.functions.text import JS_SPACE

# Limits.
TEXT_LIMIT_BYTES = 65_536
METADATA_LIMIT_BYTES = 16_384
MIN_DIM, MAX_DIM, DEFAULT_DIM = 64, 4_096, 768
MAX_SESSION_DIM = 8_192
DEFAULT_RECALL_LIMIT, MAX_RECALL_LIMIT = 10, 1_000
DEFAULT_SEARCH_LIMIT, MAX_SEARCH_LIMIT = 5, 20
MAX_FILTERED_CANDIDATES = 5_000

STRING_FIELDS = {
    "sourceKind": "source_kind",
    "sourceUri": "source_uri",
    "entryId": "entry_id",
    "parentId": "parent_id",
    "timestamp": "timestamp",
}
INTEGER_FIELDS = {"lineNumber": "line_number", "lineStart": "line_start", "lineEnd": "line_end"}
_ABSENT = object()


def _is_int(value: Any) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()


def check_dim(dim: Any, low: int = MIN_DIM, high: int = MAX_DIM) -> int:
    if not _is_int(dim) or not low <= dim <= high:
        raise InvalidArgumentError(f"Embedding dim must be an integer in [{low}, {high}]. Received: {dim}")
    return int(dim)


def check_project(project_id: Any, what: str = "project_id") -> str:
    """A project id must not be blank; it is used as it is, without trimming."""
    if not isinstance(project_id, str) or not project_id.strip(JS_SPACE):
        raise InvalidArgumentError(f"{what} must be a non-empty string")
    return project_id


def check_limit(limit: Any, highest: int, what: str) -> int:
    if not _is_int(limit) or limit <= 0 or limit > highest:
        raise InvalidArgumentError(f"{what} must be a positive integer <= {highest}, got {limit}")
    return int(limit)


def check_embedding(embedding: Any, dim: int) -> list[float]:
    if not isinstance(embedding, Sequence) or isinstance(embedding, (str, bytes)):
        raise InvalidArgumentError("embedding must be an array")
    if len(embedding) != dim:
        raise InvalidArgumentError(f"embedding must have dimension {dim}, got {len(embedding)}")
    for i, x in enumerate(embedding):
        if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x):
            raise InvalidArgumentError(f"embedding[{i}] must be finite")
    return [float(x) for x in embedding]


def _json_value(value: Any, path: str, inside: tuple[int, ...]) -> Any:
    """A copy that json.dumps takes; anything else names its path. Objects below the root may offer ``to_json``."""
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, (int, float)):
        if not math.isfinite(value):
            raise InvalidArgumentError(f"metadata.{path} must be a finite number")
        return value
    if id(value) in inside:
        raise InvalidArgumentError(f"metadata.{path} must not be cyclic")
    inside = (*inside, id(value))
    hook = getattr(value, "to_json", None)
    if callable(hook):
        return _json_value(hook(), path, inside)
    if isinstance(value, (list, tuple)):
        return [_json_value(v, f"{path}[{i}]", inside) for i, v in enumerate(value)]
    if isinstance(value, Mapping) and all(isinstance(k, str) for k in value):
        return {k: _json_value(v, f"{path}.{k}", inside) for k, v in value.items()}
    raise InvalidArgumentError(f"metadata.{path} must be JSON-serializable, got {type(value).__name__}")


def metadata_json(metadata: Any) -> str:
    """Compact JSON in the order of insertion, within the limit."""
    if not isinstance(metadata, Mapping) or not all(isinstance(k, str) for k in metadata):
        raise InvalidArgumentError("metadata must be a JSON-serializable object")
    clean = {k: _json_value(v, k, (id(metadata),)) for k, v in metadata.items()}
    text = json.dumps(clean, separators=(",", ":"), ensure_ascii=False)
    if len(text.encode()) > METADATA_LIMIT_BYTES:
        raise InvalidArgumentError(f"metadata JSON must be <= {METADATA_LIMIT_BYTES} bytes")
    return text


def normalize_chunk(chunk: Any, project_id: str) -> dict:
    """One input record as it is stored (without times and embedding).

    Only ``text`` is required. An absent field is null in the store; a field given as None is an error.
    """
    if not isinstance(chunk, Mapping):
        raise InvalidArgumentError("chunk must be an object")
    check_project(project_id)
    text = chunk.get("text")
    if not isinstance(text, str):
        raise InvalidArgumentError("chunk.text must be a string")
    text = text.strip(JS_SPACE)
    if not text:
        raise InvalidArgumentError("chunk.text must be non-empty after trim")
    if len(text.encode("utf-8", "surrogatepass")) > TEXT_LIMIT_BYTES:
        raise InvalidArgumentError(f"chunk.text must be <= {TEXT_LIMIT_BYTES} bytes")
    chunk_id = chunk.get("chunkId", _ABSENT)
    if chunk_id is not _ABSENT and not isinstance(chunk_id, str):
        raise InvalidArgumentError("chunk.chunkId must be a string")
    if chunk_id == "":
        raise InvalidArgumentError("chunk.chunkId must be non-empty")
    out = {"project_id": project_id, "chunk_id": str(uuid.uuid4()) if chunk_id is _ABSENT else chunk_id, "text": text}
    for field, column in STRING_FIELDS.items():
        value = chunk.get(field, _ABSENT)
        if value is not _ABSENT and not isinstance(value, str):
            raise InvalidArgumentError(f"chunk.{field} must be a string")
        out[column] = None if value is _ABSENT else value
    for field, column in INTEGER_FIELDS.items():
        value = chunk.get(field, _ABSENT)
        if value is not _ABSENT and not _is_int(value):
            raise InvalidArgumentError(f"chunk.{field} must be an integer")
        out[column] = None if value is _ABSENT else int(value)
    metadata = chunk.get("metadata", _ABSENT)
    out["metadata_json"] = None if metadata is _ABSENT else metadata_json(metadata)
    return out
