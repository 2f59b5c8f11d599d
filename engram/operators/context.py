"""Windows of visible messages around a hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import tsv_escape
from engram.operators.sessions import ROLES, line_block
from engram.session import held

BEFORE, AFTER = 5, 10
TSV_COLUMNS = ("lineNumber", "entryId", "parentId", "timestamp", "role", "text")


def visible_text(content: Column) -> Column:
    """Like a reader sees it: the string, or all text blocks (blank ones too) joined by line feeds; not trimmed."""
    doc = F.try_parse_json(content)
    first = F.substring(F.ltrim(content), 1, 1)
    texts = F.transform(
        F.filter(F.try_variant_get(doc, "$", "array<variant>"), lambda b: F.try_variant_get(b, "$.type", "string") == "text"),
        lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")),
    )
    return F.coalesce(F.when(first == '"', F.try_variant_get(doc, "$", "string")).when(first == "[", F.array_join(texts, "\n")), F.lit(""))


def visible_messages(lines: DataFrame) -> DataFrame:
    """Messages of user and assistant with any text: source_uri, lineNumber, entryId, parentId, timestamp, role, text.

    An id is not needed; absent values are ''. Lines that are no valid JSON are not seen. Repeated rows count once.
    """
    blank = lambda c, name: F.coalesce(F.col(c), F.lit("")).alias(name)
    return (
        lines.where((F.col("type") == "message") & F.col("message.role").isin(*ROLES))
        .select(
            "source_uri",
            F.col("line_number").alias("lineNumber"),
            blank("id", "entryId"),
            blank("parentId", "parentId"),
            blank("timestamp", "timestamp"),
            F.col("message.role").alias("role"),
            visible_text(F.col("message.content")).alias("text"),
        )
        .where("length(text) > 0")
        .distinct()
    )


def numbered(messages: DataFrame) -> DataFrame:
    """Adds ``ordinal``: the number of a visible message within its file. Files are numbered block by block and the numbers of
    earlier blocks added, so that a large file is no single task."""
    rows = messages.withColumn("_block", line_block("lineNumber"))
    counts = rows.groupBy("source_uri", "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source_uri").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("source_uri").alias("_uri"), F.col("_block").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("source_uri", "_block").orderBy("lineNumber", "entryId", "text"))
    found = rows.withColumn("_own", own).join(offsets, F.col("source_uri").eqNullSafe(F.col("_uri")) & (F.col("_block") == F.col("_at")))
    return found.withColumn("ordinal", (F.col("_before") + F.col("_own")).cast("int")).drop("_block", "_uri", "_at", "_before", "_own")


def context(lines: DataFrame, hits: DataFrame, *, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """The visible messages around each hit: hit_id and the columns of ``visible_messages``, in order of ordinal.

    hits: hit_id, source_uri and ``line`` or ``entry`` (null or 0 or '' where not used); the first message that matches
    either is the middle. A hit without a match has no rows. before and after count visible messages, not lines. Only files
    with a hit are parsed and numbered.
    """
    right = hits.select("hit_id", "source_uri", *[F.col(c) for c in ("line", "entry") if c in hits.columns])
    inside = lines.join(right.select("source_uri").distinct(), "source_uri", "left_semi")
    messages = held(numbered(visible_messages(inside)))
    line = (F.col("line") > 0) & (F.col("lineNumber") == F.col("line")) if "line" in hits.columns else F.lit(False)
    entry = (F.col("entry") != "") & (F.col("entryId") == F.col("entry")) if "entry" in hits.columns else F.lit(False)
    found = (
        messages.join(right, "source_uri")
        .where(F.coalesce(line, F.lit(False)) | F.coalesce(entry, F.lit(False)))
        .groupBy("hit_id", "source_uri")
        .agg(F.min("ordinal").alias("middle"))
    )
    near = F.col("ordinal").between(F.col("middle") - before, F.col("middle") + after)
    return messages.join(found, "source_uri").where(near).drop("middle")


def tsv(messages: DataFrame) -> DataFrame:
    """One tab-separated line per message, with tabs, line ends and backslashes escaped."""
    cells = [tsv_escape(F.col(c).cast("string")) for c in TSV_COLUMNS]
    return messages.withColumn("tsv", F.concat_ws("\t", *cells))
