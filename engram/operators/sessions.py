"""Session files as tables: entries of a file, their text and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import blank_to_null, message_text, micros

ROLES = ("user", "assistant")


def session_entries(lines: DataFrame, *, with_text: bool = False, with_digest: bool = False) -> DataFrame:
    """The entries of every file: its rows except type session that have a non-empty id; of several with one id only
    that of the greatest line number.

    Columns: source_uri, id, parentId, line_number, type, role, at (microseconds, null where unreadable), and with
    ``with_text`` the message text (for rows of type message, else ''), with ``with_digest`` its MD5 (null where empty). Rows without a source_uri form a file of their
    own. Of rows that share the greatest line number, the smallest by (type, parentId, role, at) is taken, so that the
    result never depends on the order of the rows.
    """
    cols = [
        F.col("source_uri"),
        F.col("id"),
        F.col("parentId"),
        F.col("line_number"),
        F.col("type"),
        F.col("message.role").alias("role"),
        micros(F.col("timestamp")).alias("at"),
    ]
    if with_text:
        cols.append(F.when(F.col("type") == "message", message_text(F.col("message.content"))).otherwise("").alias("text"))
    if with_digest:
        text = F.when(F.col("type") == "message", message_text(F.col("message.content")))
        cols.append(F.when(text != "", F.unhex(F.md5(text))).alias("digest"))
    rows = lines.where(F.coalesce(F.col("type") != "session", F.lit(True)) & (F.col("id") != "")).select(*cols)
    newest = Window.partitionBy("source_uri", "id").orderBy(F.desc("line_number"), "type", "parentId", "role", "at")
    return rows.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


#: Lines of one file that are sorted together; what reaches beyond is carried over from block to block.
BLOCK_LINES = 16_384


def line_block(line: str = "line_number") -> Column:
    return F.coalesce(F.floor(F.col(line) / BLOCK_LINES), F.lit(-1)).cast("long").alias("_block")


def with_cwd(lines: DataFrame, keep: Column | None = None) -> DataFrame:
    """Adds ``session_cwd``: the last non-empty cwd of a session line up to the row's line, null before the first.

    Files are sorted block by block, so that a large one is no single task: the last cwd of every block, one row each, is
    carried on to the blocks behind it. keep: only these rows come out; others but session lines are not even sorted.
    """
    session = (F.col("type") == "session") & (F.col("cwd") != "")
    rows = lines.withColumn("_cwd", F.when(session, F.col("cwd"))).withColumn("_block", line_block())
    if keep is not None:
        rows = rows.withColumn("_kept", F.coalesce(keep, F.lit(False))).where(F.col("_kept") | F.col("_cwd").isNotNull())
    at = F.when(F.col("_cwd").isNotNull(), F.coalesce("line_number", F.lit(-1)))
    blocks = rows.groupBy("source_uri", "_block").agg(F.max_by("_cwd", at).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy("source_uri").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    carried = blocks.select(F.col("source_uri").alias("_uri"), F.col("_block").alias("_at"), before.alias("_before")).where("_before is not null")
    within = F.last("_cwd", ignorenulls=True).over(Window.partitionBy("source_uri", "_block").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0))
    filled = rows.withColumn("_within", within).join(carried, F.col("source_uri").eqNullSafe(F.col("_uri")) & (F.col("_block") == F.col("_at")), "left")
    if keep is not None:
        filled = filled.where("_kept")
    return filled.withColumn("session_cwd", F.coalesce("_within", "_before")).drop("_cwd", "_block", "_within", "_uri", "_at", "_before", *(["_kept"] if keep is not None else []))


def parse_messages(lines: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """The messages of session files that are indexed, one row per line: source_uri, entry_id, parent_id, line_number,
    timestamp, cwd, role, text.

    Kept are rows of type message with a non-empty id, a role of user or assistant and non-blank text. ``active``
    (source_uri, entry_id) restricts them to an active branch; an empty one keeps nothing. Absent values are null.
    """
    message = (F.col("type") == "message") & F.col("message.role").isin(*ROLES) & (F.col("id") != "")
    slim = lines.select(  # text is made before rows are sorted, so that no message is sorted as JSON
        "source_uri", "id", "parentId", "line_number", "timestamp", "type", F.when(F.col("type") == "session", F.col("cwd")).alias("cwd"),
        F.when(message, F.col("message.role")).alias("role"), F.when(message, message_text(F.col("message.content"))).alias("text"),
    )
    found = with_cwd(slim, (F.col("role").isNotNull()) & (F.col("text") != "")).select(
        "source_uri",
        F.col("id").alias("entry_id"),
        blank_to_null(F.col("parentId")).alias("parent_id"),
        "line_number",
        blank_to_null(F.col("timestamp")).alias("timestamp"),
        F.col("session_cwd").alias("cwd"),
        "role",
        "text",
    )
    return found if active is None else found.join(active, ["source_uri", "entry_id"], "left_semi")


def first_seen(messages: DataFrame) -> DataFrame:
    """Of messages with the same (source_uri, entry_id) the one of the smallest line; ties by text."""
    order = Window.partitionBy("source_uri", "entry_id").orderBy("line_number", "text")
    return messages.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def last_messages(lines: DataFrame) -> DataFrame:
    """source_uri and the id of the last message of each file, by line; any role, non-empty id."""
    return (
        lines.where((F.col("type") == "message") & (F.col("id") != ""))
        .groupBy("source_uri")
        .agg(F.max_by("id", F.struct("line_number", "id")).alias("leaf"))
    )


def current_versions(chunks: DataFrame, cols: list[str]) -> DataFrame:
    """Of every chunk (project_id, chunk_id) the version with the greatest updated_at as an instant.

    Adds ``instant`` (microseconds). Versions without a readable updated_at come first; equal instants are decided by
    the smallest of ``cols`` in their order. Rows with a null key are kept (null equals null).
    """
    order = [F.desc_nulls_last("instant"), *[F.col(c) for c in cols]]
    newest = Window.partitionBy("project_id", "chunk_id").orderBy(*order)
    return (
        chunks.select("project_id", "chunk_id", *cols, micros(F.col("updated_at")).alias("instant"))
        .withColumn("_rn", F.row_number().over(newest))
        .where("_rn = 1")
        .drop("_rn")
    )


def forest_nodes(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """Session entries and current chunk versions with an entry_id as the nodes of one forest.

    Columns: origin, project_id, source_uri, node_id, parent_id, position.
    """
    entries = session_entries(lines).select(
        F.lit("mixed_session").alias("origin"),
        F.lit("").alias("project_id"),
        "source_uri",
        F.col("id").alias("node_id"),
        F.col("parentId").alias("parent_id"),
        F.col("line_number").alias("position"),
    )
    current = (
        current_versions(chunks, ["source_uri", "entry_id", "parent_id", "line_number", "line_start"])
        .where(blank_to_null(F.col("entry_id")).isNotNull())
        .select(
            F.lit("source_chunks").alias("origin"),
            "project_id",
            "source_uri",
            F.col("entry_id").alias("node_id"),
            "parent_id",
            F.coalesce("line_number", "line_start").alias("position"),
        )
    )
    return entries.unionByName(current)
