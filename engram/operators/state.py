"""State changes as plans: upsert, insert-or-ignore, delete and reconcile over immutable tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_KEY = ("project_id", "chunk_id")
ENTRY_KEY = ("source_uri", "entry_id")


def last_write(batch: DataFrame, key: Sequence[str], *order: str) -> DataFrame:
    """Of rows with one key the last by ``order``."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return batch.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(current: DataFrame, batch: DataFrame, key: Sequence[str] = CHUNK_KEY, *, keep: Sequence[str] = ("created_at",)) -> DataFrame:
    """The state after the batch: rows of new keys added, rows of known keys replaced except for the ``keep`` columns.

    Keys are unique in both and not null.
    """
    key = list(key)
    old = current.select(*key, *[F.col(c).alias(f"_old_{c}") for c in keep], F.lit(True).alias("_known"))
    merged = batch.join(old, key, "left")
    for c in keep:
        merged = merged.withColumn(c, F.when(F.col("_known"), F.col(f"_old_{c}")).otherwise(F.col(c)))
    return current.join(batch.select(*key), key, "left_anti").unionByName(merged.select(*current.columns))


def insert_or_ignore(current: DataFrame, batch: DataFrame, key: Sequence[str] = ENTRY_KEY) -> DataFrame:
    """Rows of unknown keys added; known rows are never changed."""
    return current.unionByName(new_rows(current, batch, key).select(*current.columns))


def new_rows(current: DataFrame, batch: DataFrame, key: Sequence[str] = ENTRY_KEY) -> DataFrame:
    """Rows of the batch whose key is unknown."""
    return batch.join(current.select(*key).distinct(), list(key), "left_anti")


def delete(current: DataFrame, project_id: str, chunk_ids: DataFrame) -> DataFrame:
    """The rows left when the given chunks (column chunk_id, repeated or unknown ids allowed) of one project are gone."""
    gone = chunk_ids.select(F.lit(project_id).alias("project_id"), "chunk_id")
    return current.join(gone, list(CHUNK_KEY), "left_anti")


def deleted_count(current: DataFrame, project_id: str, chunk_ids: DataFrame) -> DataFrame:
    """One row: how many chunks a delete takes away; an id given twice counts once, an unknown one not at all."""
    hit = current.where(F.col("project_id") == project_id).join(chunk_ids.select("chunk_id"), "chunk_id", "left_semi")
    return hit.agg(F.count_distinct("chunk_id").alias("deleted"))


def reconcile(current: DataFrame, active: DataFrame) -> DataFrame:
    """Without the rows of files in ``active`` (source_uri, entry_id) whose entry is not active there; files that have no
    active entry at all are left as they are."""
    return _flagged(current, active).where("_files is null or _entries is not null").drop("_files", "_entries")


def stale_rows(current: DataFrame, active: DataFrame) -> DataFrame:
    """The rows that ``reconcile`` takes away."""
    return _flagged(current, active).where("_files is not null and _entries is null").drop("_files", "_entries")


def _flagged(current: DataFrame, active: DataFrame) -> DataFrame:
    """Adds _files (not null where the file has active entries) and _entries (not null where the entry is active)."""
    entries = active.select(*ENTRY_KEY).distinct().withColumn("_entries", F.lit(1))
    files = active.where(F.col("source_uri").isNotNull()).select("source_uri").distinct().withColumn("_files", F.lit(1))
    return current.join(files, "source_uri", "left").join(entries, list(ENTRY_KEY), "left").select(current.columns + ["_files", "_entries"])
