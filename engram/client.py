"""The client: store, recall, forget, status."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.embed import Embedder, check_vectors, create_embedder, with_embeddings
from engram.errors import EngramError, InvalidArgumentError
from engram.functions.text import JS_SPACE, iso_now, js_trim
from engram.functions.vectors import is_valid
from engram.operators.recall import ranked, top_k
from engram.operators.state import CHUNK_KEY, last_write
from engram.session import cut
from engram.sources.config import load_config, private_dir
from engram.sources.store import CHUNK_SCHEMA, SnapshotTable
from engram.validate import (
    DEFAULT_RECALL_LIMIT,
    MAX_RECALL_LIMIT,
    METADATA_LIMIT_BYTES,
    TEXT_LIMIT_BYTES,
    check_dim,
    check_embedding,
    check_limit,
    check_project,
    normalize_chunk,
)

PUBLIC = [c for c in CHUNK_SCHEMA.names if c not in ("created_at", "updated_at", "embedding")]


class ChunkStore:
    """Chunks with their vectors, by (project_id, chunk_id)."""

    def __init__(self, spark: SparkSession, path: str, dim: int):
        self.spark, self.dim = spark, check_dim(dim)
        self.table = SnapshotTable(spark, path, CHUNK_SCHEMA, self.dim)

    def put(self, chunks: DataFrame) -> DataFrame:
        """Upsert chunks (columns of the store but the times, plus ``ordinal`` for the order within the batch); all get one
        write time, created_at of known chunks stays, the last of equal keys wins. Broken rows fail the batch."""
        self.check(chunks)
        now = self.spark.range(1).select(iso_now().alias("now")).collect()[0]["now"]
        batch = chunks.withColumn("created_at", F.lit(now)).withColumn("updated_at", F.lit(now))
        if "ordinal" in batch.columns:
            batch = last_write(batch, ("project_id", "chunk_id"), "ordinal")
        batch = batch.select([F.col(f.name).cast(f.dataType) for f in CHUNK_SCHEMA])
        known = self.table.read().select(*CHUNK_KEY, F.col("created_at").alias("_old"))  # only keys and times are read
        batch = batch.join(known, list(CHUNK_KEY), "left").withColumn("created_at", F.coalesce("_old", "created_at"))
        return self.table.upsert(batch)

    def check(self, chunks: DataFrame) -> None:
        """Raises for the first rule that a row breaks; vectors are looked at where there are any."""
        text = js_trim(F.col("text"))
        rules = [
            (F.col("chunk_id").isNull() | (F.col("chunk_id") == ""), "chunk_id must be a non-empty string"),
            (F.col("project_id").isNull() | (js_trim(F.col("project_id")) == ""), "project_id must be a non-empty string"),
            (text.isNull() | (text == ""), "text must be non-empty"),
            (F.octet_length("text") > TEXT_LIMIT_BYTES, f"text must be <= {TEXT_LIMIT_BYTES} bytes"),
            (F.octet_length("metadata_json") > METADATA_LIMIT_BYTES, f"metadata JSON must be <= {METADATA_LIMIT_BYTES} bytes"),
            (F.col("metadata_json").isNotNull() & ~F.schema_of_variant(F.try_parse_json("metadata_json")).startswith("OBJECT"), "metadata must be a JSON object"),
            (F.col("metadata_json").isNotNull() & F.try_parse_json("metadata_json").isNull(), "metadata must be valid JSON"),
            *([(~is_valid(F.col("embedding").cast("array<float>"), self.dim), f"embedding must have {self.dim} finite values")] if "embedding" in chunks.columns else []),
        ]
        broken = F.coalesce(*[F.when(bad, F.lit(message)) for bad, message in rules])
        if found := chunks.select(broken.alias("broken")).where("broken is not null").limit(1).collect():
            raise InvalidArgumentError(found[0]["broken"])

    def search(self, embedding: Sequence[float], *, project_id: str, limit: int) -> DataFrame:
        """The nearest chunks of the project with distance, score and rank."""
        check_project(project_id)
        check_limit(limit, MAX_RECALL_LIMIT, "limit")
        query = check_embedding(embedding, self.dim)
        return ranked(top_k(self.table.read(project_id), query, limit, where=F.col("project_id") == project_id, ties=["chunk_id"]), "chunk_id")

    def delete(self, project_id: str, chunk_ids: Sequence[str]) -> int:
        """How many chunks of the project went away."""
        check_project(project_id)
        if not isinstance(chunk_ids, Sequence) or isinstance(chunk_ids, str):
            raise InvalidArgumentError("chunk_ids must be an array")
        if not chunk_ids:
            raise InvalidArgumentError("chunk_ids must not be empty")
        if any(not isinstance(c, str) or not c for c in chunk_ids):
            raise InvalidArgumentError("chunk_ids must be non-empty strings")
        gone = self.spark.createDataFrame([(project_id, c) for c in dict.fromkeys(chunk_ids)], "project_id string, chunk_id string")
        hit = self.table.read(project_id).join(gone, list(CHUNK_KEY), "left_semi").select(*CHUNK_KEY).collect()  # at most the ids given
        count = len(hit)
        if count:
            self.table.delete(self.spark.createDataFrame(hit, "project_id string, chunk_id string"))
        return count


class Client:
    """Project-scoped memory over a snapshot store."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder, *, owns_embedder: bool = False):
        self.spark, self.embedder, self._owns, self._open = spark, embedder, owns_embedder, True
        self.store_ = ChunkStore(spark, path, embedder.dim)

    @classmethod
    def create(cls, spark: SparkSession, base_dir: str, embedder: Embedder | None = None) -> Client:
        data = private_dir(os.path.join(base_dir, "data"))
        own = embedder is None
        return cls(spark, os.path.join(data, "chunks"), embedder or create_embedder(load_config(base_dir)["embedder"]), owns_embedder=own)

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    def close(self) -> None:
        """Closes what the client made itself; an embedder that was handed in stays open."""
        if self._open and self._owns and hasattr(self.embedder, "close"):
            self.embedder.close()
        self._open = False

    def store(self, chunks: Sequence[Mapping[str, Any]] | DataFrame, *, project_id: str) -> DataFrame:
        """Store records (or a DataFrame with the columns of the store); everything is checked before anything is embedded.
        Returns all records of the batch in their order, with ``metadata`` as a variant."""
        self._check_open()
        check_project(project_id)
        if isinstance(chunks, DataFrame):
            rows = _input_rows(chunks, project_id)
            self.store_.check(rows)
            rows = cut(with_embeddings(cut(rows), self.embedder))  # ids and vectors are made once
        else:
            if not isinstance(chunks, Sequence) or isinstance(chunks, (str, bytes)):
                raise InvalidArgumentError("chunks must be an array")
            if not chunks:
                raise InvalidArgumentError("chunks must not be empty")
            clean = [normalize_chunk(c, project_id) for c in chunks]
            vectors = self.embedder.embed_batch([c["text"] for c in clean])
            if len(vectors) != len(clean):
                raise InvalidArgumentError(f"embedder returned {len(vectors)} embeddings for {len(clean)} chunks")
            vectors = check_vectors(vectors, len(clean), self.embedder.dim)
            schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CHUNK_SCHEMA if f.name not in ("created_at", "updated_at", "embedding"))
            data = [(*[c[n] for n in PUBLIC], i, v) for i, (c, v) in enumerate(zip(clean, vectors))]
            rows = self.spark.createDataFrame(data, f"{schema}, ordinal long, embedding array<double>")
        self.store_.put(rows)
        return _public(rows.orderBy("ordinal"))

    def recall(self, query: str, *, project_id: str, limit: int = DEFAULT_RECALL_LIMIT) -> DataFrame:
        """The chunks of the project nearest to the query, with their score, best first."""
        self._check_open()
        if not isinstance(query, str) or not query.strip(JS_SPACE):
            raise InvalidArgumentError("query must be a non-empty string")
        check_project(project_id)
        check_limit(limit, MAX_RECALL_LIMIT, "limit")
        vector = self.embedder.embed(query.strip(JS_SPACE))
        return _public(self.store_.search(vector, project_id=project_id, limit=limit), "score", "rank")

    def forget(self, chunk_ids: Sequence[str], *, project_id: str) -> int:
        self._check_open()
        return self.store_.delete(project_id, chunk_ids)

    def status(self, project_id: str) -> int:
        """How many chunks the project has."""
        self._check_open()
        return self.store_.table.read(check_project(project_id)).count()

    def _check_open(self) -> None:
        if not self._open:
            raise EngramError("client is closed")


def _input_rows(chunks: DataFrame, project_id: str) -> DataFrame:
    """Input rows in the columns of the store, with ordinal. A null or missing chunk_id gets a new one. Without a column
    ``ordinal`` rows are ordered by their content, so that the last of equal keys does not depend on partitions."""
    names = [f for f in CHUNK_SCHEMA if f.name not in ("project_id", "text", "created_at", "updated_at", "embedding")]
    have = [F.col(f.name).cast(f.dataType) if f.name in chunks.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in names]
    rows = chunks.select(F.lit(project_id).alias("project_id"), js_trim(F.col("text")).alias("text"), *have, *(["ordinal"] if "ordinal" in chunks.columns else []))
    if "ordinal" not in chunks.columns:
        rows = rows.withColumn("ordinal", F.xxhash64(*rows.columns))
    return rows.withColumn("chunk_id", F.coalesce("chunk_id", F.uuid()))


def _public(rows: DataFrame, *more: str) -> DataFrame:
    """The public columns; metadata is parsed, times and vectors stay inside."""
    names = [c for c in PUBLIC if c != "metadata_json"]
    return rows.select(*names, F.try_parse_json("metadata_json").alias("metadata"), *more)


def to_json_rows(rows: DataFrame) -> list[str]:
    """Rows of one search as indented JSON texts; nulls are left out."""
    return [json.dumps(json.loads(line), indent=2, ensure_ascii=False) for line in rows.toJSON().collect()]
