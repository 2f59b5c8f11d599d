"""Session files: JSON lines with numbers, read whole or from a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.errors import SessionParseError
from engram.functions.text import js_trim

#: Columns of a session line; content and usage stay JSON text.
MESSAGE_TEXT = ("role", "toolCallId", "toolName", "customType", "api", "provider", "model", "stopReason")
LINE_TEXT = ("type", "id", "parentId", "timestamp", "cwd", "customType", "content", "provider", "modelId")


def split_lines(files: DataFrame, uri_col: str, text_col: str) -> DataFrame:
    """source_uri, line_number (from 1), line: lines end at LF, one CR before it is dropped; blank lines are numbered but
    left out. A null or empty text has none."""
    parts = F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("_at", "_line")
    return (
        files.select(F.col(uri_col).alias("source_uri"), parts)
        .select("source_uri", (F.col("_at") + 1).cast("long").alias("line_number"), F.regexp_replace("_line", "\r$", "").alias("line"))
        .where(js_trim(F.col("line")) != "")
    )


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The numbered lines of all files under ``path`` (or several)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_uri"), "value")
    return split_lines(files, "source_uri", "value")


def _text(doc: Column, path: str) -> Column:
    """A string at ``path``; null where there is none or it is no string."""
    at = F.try_variant_get(doc, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(doc, path, "string"))


def _raw(doc: Column, path: str) -> Column:
    return F.to_json(F.try_variant_get(doc, path, "variant"))


def malformed(lines: DataFrame) -> DataFrame:
    """source_uri, line_number of the first line of each file that is no JSON; files without one are not in it."""
    bad = F.try_parse_json("line").isNull() & (js_trim(F.col("line")) != "null")
    return lines.where(bad).groupBy("source_uri").agg(F.min("line_number").alias("line_number"))


def check_lines(lines: DataFrame) -> None:
    """Raises SessionParseError for a line that is no JSON."""
    if found := malformed(lines).orderBy("source_uri").limit(1).collect():
        raise SessionParseError(found[0]["source_uri"], found[0]["line_number"])


def parse_lines(lines: DataFrame, *, strict: bool = False) -> DataFrame:
    """Session lines as columns, in the shape of a session table. Lines that are no JSON object are left out; with
    ``strict`` a line that is no JSON at all fails the job, naming file and line."""
    doc = F.try_parse_json("line")
    if strict:
        where = F.concat(F.lit("Malformed session line "), F.col("line_number").cast("string"), F.lit(" in "), F.col("source_uri"))
        doc = F.when(doc.isNull() & (js_trim(F.col("line")) != "null"), F.raise_error(where).cast("variant")).otherwise(doc)
    rows = lines.withColumn("_doc", doc).where(F.schema_of_variant("_doc").startswith("OBJECT"))
    d = F.col("_doc")
    message = F.struct(
        *[_text(d, f"$.message.{c}").alias(c) for c in MESSAGE_TEXT],
        F.try_variant_get(d, "$.message.isError", "boolean").alias("isError"),
        F.try_variant_get(d, "$.message.display", "boolean").alias("display"),
        _raw(d, "$.message.content").alias("content"),
        _raw(d, "$.message.usage").alias("usage"),
    )
    has_message = F.schema_of_variant(F.try_variant_get(d, "$.message", "variant")).startswith("OBJECT")
    return rows.select(
        "source_uri",
        "line_number",
        *[_text(d, f"$.{c}").alias(c) for c in LINE_TEXT],
        F.try_variant_get(d, "$.version", "int").alias("version"),
        F.try_variant_get(d, "$.display", "boolean").alias("display"),
        F.when(has_message, message).alias("message"),
    )


def read_sessions(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    return parse_lines(read_lines(spark, path), strict=strict)
