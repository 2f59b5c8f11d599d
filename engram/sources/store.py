"""Snapshot store: a table as a log of changes over immutable files.

Every change writes files of its own (rows, or keys that are gone) and then claims the next entry of the log by creating it
under a name that must not exist yet. Of two writers that started from the same version one gets the name; the other
fails and leaves nothing behind. A change costs what it changes, however large the table is; ``compact`` folds the log
into one set of files. Files are laid out by buckets of the leading key column, so that reading one project or file
reads one bucket.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.errors import EngramError, InvalidArgumentError

FORMAT = 2
#: Buckets of the leading key column, and parts that the rows of one bucket are written by at most.
BUCKETS, PARTS = 64, 32
#: A log entry names all parts of the table after so many entries that only add theirs.
FULL_ENTRY = 64

CHUNK_SCHEMA = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("project_id", "chunk_id", "text")],
        *[T.StructField(c, T.StringType()) for c in ("source_kind", "source_uri", "entry_id", "parent_id")],
        *[T.StructField(c, T.LongType()) for c in ("line_number", "line_start", "line_end")],
        *[T.StructField(c, T.StringType()) for c in ("timestamp", "metadata_json")],
        *[T.StructField(c, T.StringType()) for c in ("created_at", "updated_at")],
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
SESSION_SCHEMA = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("chunk_id", "source_kind", "source_uri", "entry_id", "parent_id")],
        T.StructField("line_number", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("timestamp", "cwd", "snippet", "metadata_json", "created_at")],
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)


def last_entry(log: str) -> int:
    """The number of the last entry of a log, 0 before the first."""
    return max((int(f[:-5]) for f in os.listdir(log) if f.endswith(".json")), default=0) if os.path.isdir(log) else 0


def claim_entry(log: str, entry: int, what: dict) -> None:
    """Creates a log entry, complete and only if there is none of its number."""
    draft = os.path.join(log, f"draft-{uuid.uuid4().hex}")
    with open(draft, "w") as f:
        json.dump(what, f)
        f.flush()
        os.fsync(f.fileno())
    os.chmod(draft, 0o600)
    try:
        os.link(draft, os.path.join(log, f"{entry:012d}.json"))
    except FileExistsError:
        raise EngramError("another writer changed the table") from None
    finally:
        os.unlink(draft)


class SnapshotTable:
    """One table of the store under ``path``; key columns are not null and unique in it."""

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, dim: int | None = None, *, key: Sequence[str] = ("project_id", "chunk_id"), create: bool = True
    ):
        self.spark, self.path, self.schema, self.dim, self.key = spark, path, schema, dim, tuple(key)
        self._log = os.path.join(path, "_log")
        if create:
            for folder in (path, self._log):
                os.makedirs(folder, mode=0o700, exist_ok=True)
        elif not os.path.isdir(self._log):
            raise EngramError(f"store is unavailable: {path}")
        found = self.manifest
        if found is None:
            return
        if found.get("format") != FORMAT:  # a draft of another layout: start afresh, but only with a valid dimension
            self._claim(found["entry"] + 1, {"parts": []})
            return
        if dim is not None and found.get("dim") not in (None, dim):
            raise InvalidArgumentError(f"configured dim={dim} but the store holds vectors of dim={found['dim']}")
        if missing := [f.name for f in schema if f.name not in found.get("columns", [f.name])]:
            raise InvalidArgumentError(f"existing table is missing columns: {', '.join(missing)}")
        if gone := [p["at"] for p in found["parts"] if not os.path.exists(os.path.join(path, p["at"], "_SUCCESS"))]:
            raise EngramError(f"store integrity check failed: {path}: files are missing: {', '.join(gone)}")

    @property
    def entry(self) -> int:
        """The number of the last log entry, 0 before the first."""
        return last_entry(self._log)

    @property
    def manifest(self) -> dict | None:
        """The table as of the last entry: format, columns, dim, entry, parts ({at, kind, entry})."""
        return self._manifest(self.entry)

    def _manifest(self, last: int) -> dict | None:
        if not last:
            return None
        parts, at = [], last
        while True:  # entries back to the last that names all parts
            name = os.path.join(self._log, f"{at:012d}.json")
            try:
                with open(name) as f:
                    found = json.load(f)
            except (ValueError, FileNotFoundError) as e:
                raise EngramError(f"store integrity check failed: {name}: {e}") from e
            newest = found if at == last else newest
            parts = found.get("parts", found.get("more", [])) + parts
            if "parts" in found or found.get("format") != FORMAT:
                return {**newest, "parts": parts, "entry": last}
            at -= 1

    @property
    def is_empty(self) -> bool:
        found = self.manifest
        return found is None or not found["parts"]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key[0]), F.lit(BUCKETS)).cast("int")

    def read(self, only: str | None = None) -> DataFrame:
        """The rows now; only: just those with this value in the leading key column, which reads one bucket."""
        return self._read(self.manifest, only)

    def _read(self, found: dict | None, only: str | None = None) -> DataFrame:
        if found is None or not found["parts"]:
            return self.spark.createDataFrame([], self.schema)
        stored = T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])
        keys = T.StructType([*[self.schema[k] for k in self.key], T.StructField("_bucket", T.IntegerType())])
        rows = self._union([p for p in found["parts"] if p["kind"] in ("rows", "upsert")], stored, only)
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        gone = self._union([p for p in found["parts"] if p["kind"] in ("upsert", "keys")], keys, only)
        first = min((p["entry"] for p in found["parts"] if p["kind"] != "keys"))
        if gone is not None and any(p["kind"] != "rows" and p["entry"] > first for p in found["parts"]):
            last = gone.groupBy(*self.key).agg(F.max("_entry").alias("_gone"))
            rows = rows.join(last, list(self.key), "left").where(F.col("_gone").isNull() | (F.col("_entry") >= F.col("_gone")))
        return rows.select(self.schema.names)

    def _union(self, parts: list[dict], schema: T.StructType, only: str | None) -> DataFrame | None:
        def one(p: dict) -> DataFrame:
            return self.spark.read.schema(schema).parquet(os.path.join(self.path, p["at"])).withColumn("_entry", F.lit(p["entry"]))

        if not parts:
            return None
        rows = reduce(DataFrame.unionByName, map(one, parts))
        if only is not None:
            bucket = F.pmod(F.xxhash64(F.lit(only)), F.lit(BUCKETS)).cast("int")
            rows = rows.where((F.col("_bucket") == bucket) & (F.col(self.key[0]) == only))
        return rows

    def append(self, rows: DataFrame) -> DataFrame:
        """Adds rows whose keys are not in the table."""
        return self._change(lambda _: [("rows", rows.select(self.schema.names))])

    def upsert(self, rows: DataFrame) -> DataFrame:
        """Adds rows; a row of the same key is replaced."""
        return self._change(lambda _: [("upsert", rows.select(self.schema.names))])

    def delete(self, keys: DataFrame) -> DataFrame:
        """Takes away the rows with these keys (unknown and repeated ones allowed)."""
        return self._change(lambda _: [("keys", keys.select(*self.key).distinct())])

    def replace(self, state: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Puts ``state`` of the present table in its place."""
        return self._change(lambda now: [("rows", state(now).select(self.schema.names))], whole=True)

    def compact(self) -> DataFrame:
        """Folds all changes into one set of files; the rows stay the same."""
        return self.replace(lambda now: now)

    def _change(self, what: Callable[[DataFrame], list[tuple[str, DataFrame]]], whole: bool = False) -> DataFrame:
        """Writes files and claims the next log entry. Fails, leaving nothing, where another writer has claimed it."""
        entry = self.entry
        before = self._manifest(entry)
        written: list[dict] = []
        try:
            for kind, rows in what(self._read(before)):
                at = f"{kind}-{uuid.uuid4().hex}"
                written.append({"at": at, "kind": kind, "entry": entry + 1})
                placed = rows.withColumn("_bucket", self._bucket())
                placed = placed.repartition("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(PARTS))).sortWithinPartitions("_bucket", *self.key)
                placed.write.partitionBy("_bucket").parquet(os.path.join(self.path, at))
                os.chmod(os.path.join(self.path, at), 0o700)
            full = whole or before is None or (entry + 1) % FULL_ENTRY == 0
            parts = {"parts": ([] if whole or before is None else before["parts"]) + written} if full else {"more": written}
            self._claim(entry + 1, {"dim": self.dim or (before or {}).get("dim"), **parts})
        except BaseException:
            for part in written:
                shutil.rmtree(os.path.join(self.path, part["at"]), ignore_errors=True)
            raise
        return self.read()

    def _claim(self, entry: int, what: dict) -> None:
        claim_entry(self._log, entry, {"format": FORMAT, "columns": self.schema.names, "dim": self.dim, **what})

    def clean(self) -> int:
        """Removes files that the table no longer names (left by failed writers, or replaced); returns how many sets. Not
        while other writers are at work."""
        named = {p["at"] for p in (self.manifest or {"parts": []})["parts"]}
        old = [d for d in os.listdir(self.path) if d.split("-")[0] in ("rows", "upsert", "keys") and d not in named]
        for d in old:
            shutil.rmtree(os.path.join(self.path, d), ignore_errors=True)
        return len(old)
