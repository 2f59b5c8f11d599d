"""Incremental indexing as a stream of lifecycle events.

Events name files to index (they are appended to in place, so a file source would not see them again). Every micro-batch
reads the files named in it once, retracts entries of abandoned branches and adds new messages; keys make a repeated batch
harmless, so the effect is exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from engram.index import FileEvent, IndexReport, SessionIndex

#: reason: of a session_start, "startup" where the file may not be there yet. active_ids: the active branch, null or empty to
#: have it derived. no_branch: true where all messages count.
EVENT_SCHEMA = "event string, session_file string, reason string, active_ids array<string>, no_branch boolean"
#: Events that lead to indexing. A session_shutdown leads to a call of ``on_shutdown``.
INDEXING = ("agent_end", "session_start")


def on_batch(
    index: SessionIndex, report: Callable[[IndexReport], None] | None = None, on_shutdown: Callable[[], None] | None = None
) -> Callable[[DataFrame, int], None]:
    """The body of a micro-batch of events. Every file has a report of its own; a failure is reported, not raised: the other
    files are indexed and the stream goes on. Of several events for one file in a batch the last one  counts."""

    def run(events: DataFrame, batch_id: int) -> None:
        try:
            rows = events.collect()  # the events of one trigger
            wanted = {
                e["session_file"]: FileEvent(tuple(e["active_ids"]) if e["active_ids"] else None, bool(e["no_branch"]), e["event"] == "session_start" and e["reason"] in (None, "startup"))
                for e in rows
                if e["event"] in INDEXING and e["session_file"]
            }
            done = index.index_files(wanted) if wanted else []
            closing = any(e["event"] == "session_shutdown" for e in rows)
        except Exception as e:
            done, closing = [IndexReport(False, error=str(e))], False
        for one in done:
            _tell(report, one)
        if closing and on_shutdown:
            _tell(lambda _: on_shutdown(), None)

    return run


def _tell(what: Callable | None, value) -> None:
    try:
        if what:
            what(value)
    except Exception:
        pass  # telling must not stop the stream


def start(
    events: DataFrame, index: SessionIndex, checkpoint: str, *,
    report: Callable[[IndexReport], None] | None = None, on_shutdown: Callable[[], None] | None = None, **trigger,
) -> StreamingQuery:
    """Index what the events of a streaming DataFrame name; ``trigger`` as for a stream writer (default: all there is)."""
    return (
        events.writeStream.foreachBatch(on_batch(index, report, on_shutdown))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
