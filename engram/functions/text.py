"""Text, time and JSON expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that ECMAScript's trim() removes.
JS_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
#: Longest snippet in code points; a longer one keeps one less and gains an ellipsis.
SNIPPET_LIMIT = 800
ELLIPSIS = "…"


def js_trim(text: Column) -> Column:
    """ECMAScript trim. Null stays null."""
    return F.trim(text, F.lit(JS_SPACE))


def blank_to_null(text: Column) -> Column:
    """'' becomes null; nothing is trimmed."""
    return F.when(text != "", text)


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def snippet(text: Column, limit: int = SNIPPET_LIMIT) -> Column:
    """At most ``limit`` code points, the last one an ellipsis if anything was cut."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 1), F.lit(ELLIPSIS)))


def entry_chunk_id(source_uri: Column, entry_id: Column) -> Column:
    """SHA-256 (hex) of the pair, joined by NUL."""
    return F.sha2(F.concat(source_uri, F.char(F.lit(0)), entry_id), 256)


def instant(text: Column) -> Column:
    """A time in any of the spellings in use, as a UTC timestamp; no offset means UTC, anything unreadable is null."""
    t = js_trim(text)
    zoned = F.when(t.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.lit("Z")))
    return zoned.try_cast("timestamp")


def micros(text: Column) -> Column:
    """``instant`` as microseconds since 1970, independent of the session's time zone."""
    return F.unix_micros(instant(text))


def iso_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def message_text(content: Column) -> Column:
    """The text of a message whose content is JSON: a string, or the non-blank blocks of type text joined by a
    line feed; trimmed. Null, invalid JSON and other shapes give ''."""
    doc = F.try_parse_json(content)
    first = F.substring(F.ltrim(content), 1, 1)
    blocks = F.try_variant_get(doc, "$", "array<variant>")
    texts = F.filter(
        F.transform(
            blocks,
            lambda b: F.when(
                (F.try_variant_get(b, "$.type", "string") == "text")
                & (F.schema_of_variant(F.try_variant_get(b, "$.text", "variant")) == "STRING"),
                F.try_variant_get(b, "$.text", "string"),
            ),
        ),
        lambda t: t.isNotNull() & (js_trim(t) != ""),
    )
    text = F.when(first == '"', F.try_variant_get(doc, "$", "string")).when(first == "[", F.array_join(texts, "\n"))
    return F.coalesce(js_trim(text), F.lit(""))


def tsv_escape(text: Column) -> Column:
    """Backslash, tab, line feed and carriage return as two-character escapes."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


def group_key(*cols: Column) -> Column:
    """One string that is equal exactly where all columns are, null equal to null."""
    parts = []
    for c in cols:
        c = c.cast("string")
        parts.append(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.concat(*parts)


def composite_key(*parts: Column) -> Column:
    """The parts as one JSON array, so that no two different keys are written alike."""
    return F.to_json(F.array(*parts))
