"""The session index: parsed messages with vectors, kept up to date file by file, and its search tool."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.embed import Embedder, with_embeddings
from engram.errors import EngramError, InvalidArgumentError, SessionParseError
from engram.functions.text import JS_SPACE, entry_chunk_id, iso_now, snippet
from engram.operators.branches import active_chain
from engram.operators.recall import ranked, search_filter, top_k
from engram.operators.sessions import first_seen, parse_messages
from engram.operators.state import ENTRY_KEY, new_rows, stale_rows
from engram.session import cut
from engram.sources.jsonl import check_lines, malformed, parse_lines, read_lines
from engram.sources.store import SESSION_SCHEMA, SnapshotTable
from engram.validate import DEFAULT_SEARCH_LIMIT, MAX_FILTERED_CANDIDATES, MAX_SEARCH_LIMIT, MAX_SESSION_DIM, check_dim, check_limit

#: Fixed value: the kind of source that rows of session files carry.
SOURCE_KIND = "pi-jsonl"
POINTER = {"sourceKind": "source_kind", "sourceUri": "source_uri", "entryId": "entry_id", "parentId": "parent_id", "lineNumber": "line_number", "timestamp": "timestamp", "cwd": "cwd"}
TIES = ("source_uri", "line_number", "chunk_id")


@dataclass(frozen=True)
class IndexReport:
    """What one run did."""

    ok: bool
    indexed: int = 0
    skipped_duplicate: int = 0
    session_file: str | None = None
    error: str | None = None


def index_records(messages: DataFrame, source_kind: str = SOURCE_KIND) -> DataFrame:
    """Messages as index rows without vectors."""
    row = messages.withColumn("source_kind", F.lit(source_kind))
    pointer = F.struct(*[F.col(c).alias(n) for n, c in POINTER.items()])
    return row.select(
        entry_chunk_id(F.col("source_uri"), F.col("entry_id")).alias("chunk_id"),
        *[c for c in SESSION_SCHEMA.names[1:8]],
        F.col("text").alias("snippet"),
        F.to_json(F.struct("role", pointer.alias("sourcePointer"))).alias("metadata_json"),
        iso_now().alias("created_at"),
    )


@dataclass(frozen=True)
class FileEvent:
    """How a file is to be indexed. active_ids: the entries of its active branch; an empty list, like None, has the branch
    derived from the file. no_branch: all messages count. at_startup: a file that is not there yet is skipped."""

    active_ids: tuple[str, ...] | None = None
    no_branch: bool = False
    at_startup: bool = False

    @property
    def mode(self) -> str:
        return "none" if self.no_branch else "given" if self.active_ids else "derived"


def _plain_uri(uri: str) -> str:
    return uri.replace("file:///", "file:/", 1)


def _qualified(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return _plain_uri(at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString())


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class SessionIndex:
    """Index of session messages; rows are added once by (source_uri, entry_id) and never changed."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder, *, create: bool = True):
        """create: False opens an index that must be there already, as a search does."""
        self.spark, self.embedder = spark, embedder
        check_dim(embedder.dim, 1, MAX_SESSION_DIM)
        self.table = SnapshotTable(spark, path, SESSION_SCHEMA, embedder.dim, key=ENTRY_KEY, create=create)

    def index_messages(self, messages: DataFrame) -> IndexReport:
        """Adds messages of new entries; only these are embedded. The report counts repeated and known ones."""
        found = cut(messages)
        fresh = cut(new_rows(self.table.read(), first_seen(found)))
        total, new = found.count(), fresh.count()
        if new:
            added = cut(with_embeddings(index_records(fresh), self.embedder, "snippet"))
            self.table.append(added)
        return IndexReport(True, new, total - new)

    def reconcile(self, active: DataFrame) -> None:
        """Drops rows of the files in ``active`` (source_uri, entry_id) whose entries are not active."""
        if not self.table.is_empty and active.limit(1).count():
            stale = cut(stale_rows(self.table.read().select(*ENTRY_KEY), cut(active)))
            if stale.limit(1).count():
                self.table.delete(stale)

    def index_lines(self, lines: DataFrame, active: DataFrame | None = None) -> IndexReport:
        """One pass over session lines: stale entries go, new messages of active branches come. ``active`` None means no
        branch filter at all; an empty one is derived from the files."""
        lines = cut(lines)  # files may grow while they are read
        if active is not None and not active.limit(1).count():
            active = active_chain(lines)
        if active is not None:
            active = cut(active)
            self.reconcile(active)
        return self.index_messages(parse_messages(lines, active))

    def index_file(self, path: str | None, active: DataFrame | None = None, *, at_startup: bool = False) -> IndexReport:
        """Like ``index_lines`` for one file; errors are reported, not raised. No file, or one that is not there yet at
        start-up, is skipped."""
        if path is None:
            return IndexReport(True)
        if at_startup and not _exists(self.spark, path):
            return IndexReport(True, session_file=path)
        try:
            lines = cut(read_lines(self.spark, path))
            check_lines(lines)
            done = self.index_lines(parse_lines(lines), active)
            return IndexReport(True, done.indexed, done.skipped_duplicate, path)
        except Exception as e:
            return IndexReport(False, session_file=path, error=str(e))

    def index_files(self, wanted: Mapping[str, FileEvent]) -> list[IndexReport]:
        """Indexes the files of one trigger, with a report for each: one that is missing or has a malformed line fails alone. The
        others are read once and added together."""
        reports: dict[str, IndexReport] = {}
        for path, event in wanted.items():
            if not _exists(self.spark, path):
                reports[path] = IndexReport(event.at_startup, session_file=path, error=None if event.at_startup else f"session file not found: {path}")
        there = [p for p in wanted if p not in reports]
        if there:
            try:
                lines = cut(read_lines(self.spark, there))
                path_of = {_qualified(self.spark, p): p for p in there}
                for r in malformed(lines).collect():  # at most one row a file of the trigger
                    path = path_of.get(_plain_uri(r["source_uri"]), r["source_uri"])
                    reports[path] = IndexReport(False, session_file=path, error=str(SessionParseError(r["source_uri"], r["line_number"])))
                uri_of = {path_of.get(_plain_uri(r[0]), r[0]): r[0] for r in lines.select("source_uri").distinct().collect()}
                good = [p for p in there if p not in reports]
                counts = self._index_good({uri_of[p]: wanted[p] for p in good if p in uri_of}, parse_lines(lines))
                for p in good:
                    reports[p] = IndexReport(True, *counts.get(uri_of.get(p), (0, 0)), p)
            except Exception as e:
                for p in there:
                    reports.setdefault(p, IndexReport(False, session_file=p, error=str(e)))
        return [reports[p] for p in wanted]

    def _index_good(self, events: Mapping[str, FileEvent], lines: DataFrame) -> dict[str, tuple[int, int]]:
        """By file: how many messages were added, and how many were known."""
        if not events:
            return {}
        named = self.spark.createDataFrame([(u, e.mode) for u, e in events.items()], "source_uri string, mode string")
        lines = cut(lines.join(F.broadcast(named), "source_uri"))  # one row for each file of the trigger
        given = [(u, i) for u, e in events.items() if e.mode == "given" for i in e.active_ids or ()]
        active = self.spark.createDataFrame(given, "source_uri string, entry_id string")
        if any(e.mode == "derived" for e in events.values()):
            active = active.unionByName(active_chain(lines.where("mode = 'derived'")))
        active = cut(active)
        self.reconcile(active)
        plain = lines.drop("mode")
        free = plain.join(named.where("mode = 'none'").select("source_uri"), "source_uri", "left_semi")
        bound = plain.join(named.where("mode <> 'none'").select("source_uri"), "source_uri", "left_semi")
        found = cut(parse_messages(free).unionByName(parse_messages(bound, active)))
        fresh = cut(new_rows(self.table.read(), first_seen(found)))
        total, new = (dict(side.groupBy("source_uri").count().collect()) for side in (found, fresh))
        if new:
            self.table.append(cut(with_embeddings(index_records(fresh), self.embedder, "snippet")))
        return {u: (new.get(u, 0), total.get(u, 0) - new.get(u, 0)) for u in events}

    def search(self, query: str, *, limit: int = DEFAULT_SEARCH_LIMIT, **filters: Any) -> tuple[DataFrame | None, str | None]:
        """Hits (rank, score, chunkId, snippet, sourcePointer) and a message where there is something to say."""
        text = query.strip(JS_SPACE) if isinstance(query, str) else ""
        if not text:
            raise InvalidArgumentError("search query must be a non-empty string")
        check_limit(limit, MAX_SEARCH_LIMIT, "limit")
        line = filters.get("line_number")
        if line is not None and (isinstance(line, bool) or not isinstance(line, int) or line < 1):
            raise InvalidArgumentError("line_number must be a positive integer")
        if not os.path.isdir(self.table.path):
            raise EngramError(f"search store is unavailable: {self.table.path}")
        if self.table.is_empty:
            return None, "Nothing is indexed yet."
        rows, where = self.table.read(filters.get("source_uri")), search_filter(**filters)
        if where is not None:
            n = rows.where(where).count()
            if n == 0:
                return None, "No indexed message passes these filters."
            if n > MAX_FILTERED_CANDIDATES:
                return None, f"These filters pass {n} rows, of which at most {MAX_FILTERED_CANDIDATES} are searched; narrow them."
        hits = hit_rows(ranked(top_k(rows, self.embedder.embed(text), limit, where=where, ties=TIES), *TIES))
        return hits, None if hits.limit(1).count() else "Nothing was found."


def hit_rows(hits: DataFrame) -> DataFrame:
    """Ranked rows as hits with a bounded snippet and a pointer; null pointer fields are dropped when written as JSON."""
    pointer = F.struct(*[F.col(c).alias(n) for n, c in POINTER.items()])
    return hits.select("rank", "score", F.col("chunk_id").alias("chunkId"), snippet(F.col("snippet")).alias("snippet"), pointer.alias("sourcePointer"))


TOOL_TEXT = {"sourceUri": "source_uri", "entryId": "entry_id", "parentId": "parent_id", "timestampFrom": "timestamp_from", "timestampTo": "timestamp_to", "cwd": "cwd"}
TOOL_NUMBERS = {"lineNumber": "line_number", "limit": "limit"}


def recall_tool(index_of: Callable[[], SessionIndex]) -> Callable[[Any], dict]:
    """A function from a tool's parameters to a JSON-ready answer."""

    def execute(params: Any) -> dict:
        if not isinstance(params, Mapping):
            raise InvalidArgumentError("recall parameters must be an object")
        if not isinstance(params.get("query"), str):
            raise InvalidArgumentError("recall query must be a non-empty string")
        given: dict[str, Any] = {}
        for name, arg in TOOL_TEXT.items():
            if name in params:
                if not isinstance(params[name], str):
                    raise InvalidArgumentError(f"recall {name} must be a string")
                given[arg] = params[name]
        for name, arg in TOOL_NUMBERS.items():
            if name in params:
                if isinstance(params[name], bool) or not isinstance(params[name], (int, float)):
                    raise InvalidArgumentError(f"recall {name} must be a number")
                given[arg] = int(params[name]) if float(params[name]).is_integer() else params[name]
        hits, message = index_of().search(params["query"], **given)
        rows = [] if hits is None else [r.asDict(recursive=True) for r in hits.orderBy("rank").collect()]  # at most 20
        for r in rows:
            r["sourcePointer"] = {k: v for k, v in r["sourcePointer"].items() if v is not None}
        return {"results": rows} | ({"message": message} if message else {})

    return execute
