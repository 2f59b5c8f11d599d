"""Splitting oversized texts at natural boundaries.

Method: dynamic programming over boundary positions. Cuts are possible after blank lines, line ends, sentence ends,
clause ends, white space and, where a stretch has none of these, between any two code points. The cheapest way through
the text minimises the penalties of its cuts plus the squared deviation of the pieces from an even size, subject to the
size limit; every piece but the first starts ``overlap`` bytes before the cut (at the next code point).

All boundaries are candidates. Only of the places between any two code points, a stretch of ``limit`` / CELLS bytes offers
no more than its last, and only where it has no boundary; the limit and the overlap hold exactly in any case.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions.text import JS_SPACE, js_trim

LIMIT_BYTES = 4_096
OVERLAP_BYTES = 256
CELLS = 32
#: Weight of the squared relative deviation from an even size.
IMBALANCE = 4.0

# Kinds of boundary with their penalties, strongest first; a cut lies behind the match.
BOUNDARIES = (
    (0.0, re.compile(r"\n[ \t\r]*\n\s*")),
    (1.0, re.compile("\r?\n|\r|\u2028|\u2029")),
    (2.0, re.compile(r"[.!?…؟۔।][\"'»”’)\]]*\s+|[。！？．｡][」』”’）]*")),
    (4.0, re.compile(r"[,;:،؛]\s+|[，、；：]")),
    (6.0, re.compile(r"\s+")),
)
ANYWHERE = 12.0


def byte_offsets(text: str) -> np.ndarray:
    """Bytes of UTF-8 before each code point, and in all."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    return np.concatenate([[0], np.cumsum(width)])


def _candidates(text: str, at: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (code points, ascending, both ends included) and the penalty of cutting there."""
    n = len(text)
    penalty = np.full(n + 1, ANYWHERE)
    for cost, pattern in reversed(BOUNDARIES):
        ends = [m.end() for m in pattern.finditer(text)]
        penalty[ends] = cost
    cells = at[:-1] // cell  # the cell a position lies in
    natural = np.flatnonzero(penalty[:n] < ANYWHERE)
    last = np.flatnonzero(np.append(np.diff(cells) != 0, True)) if n else np.array([], dtype=np.int64)
    bare = last[~np.isin(cells[last], cells[natural])]
    chosen = np.unique(np.concatenate([[0], natural, bare, [n]]))
    return chosen, penalty[chosen]


def _best_ways(where: list[int], begin: list[int], penalty: list[float], limit: int, even: float, weight: float) -> list[int]:
    """For each cut the cut before it on the cheapest way there; all earlier cuts within the limit are considered.

    The cost of a piece is convex in its size, so of two earlier cuts the later one, once better, stays better as the end
    moves on. The cuts that are best for some end form a queue with the end from which each is best; the end at which one
    overtakes another has a closed form, and a cut further than the limit is overtaken at once.
    """
    n = len(where)
    cost, back = [0.0] * n, [0] * n
    queue, since, head = [0], [1], 0  # cuts, and the number of the end from which each is best
    for j in range(1, n):
        while head + 1 < len(queue) and since[head + 1] <= j:
            head += 1
        i = queue[head]
        back[j] = i
        here = cost[j] = cost[i] + weight * (where[j] - begin[i] - even) ** 2 + (penalty[j] + 1e-9 if j < n - 1 else 0.0)
        y = begin[j]
        while True:
            k = queue[-1]
            gone = bisect_right(where, begin[k] + limit, j)  # the first end that k is too far from
            if y > begin[k]:
                x = even + (y + begin[k]) / 2 + (here - cost[k]) / (2 * weight * (y - begin[k]))
                better = bisect_right(where, x, j)
            else:
                better = j if here < cost[k] else n
            better = max(j + 1, min(better, gone))
            if len(queue) - 1 > head and better <= since[-1]:
                queue.pop()
                since.pop()
                continue
            break
        if better < n:
            queue.append(j)
            since.append(better)
    return back


def split_points(text: str, limit: int, overlap: int, imbalance: float = IMBALANCE) -> list[tuple[int, int]]:
    """Start and end (code points) of each piece of ``text``; one piece where it is within the limit, none where empty.

    limit and overlap are bytes of UTF-8, overlap less than half the limit, limit at least 16.
    """
    if limit < 16 or not 0 <= overlap < limit / 2:
        raise ValueError("limit must be at least 16 bytes and overlap less than half of it")
    if not text:
        return []
    at = byte_offsets(text)
    total = int(at[-1])
    if total <= limit:
        return [(0, len(text))]
    cuts, penalty = _candidates(text, at, max(4, (limit - overlap) // CELLS))
    where = at[cuts]
    starts = np.searchsorted(at, np.maximum(where - overlap, 0))  # where the piece behind a cut starts
    starts[0] = 0
    begin = at[starts]
    pieces = -(-(total - overlap) // (limit - overlap))
    even = overlap + (total - overlap) / pieces
    back = _best_ways(where.tolist(), begin.tolist(), penalty.tolist(), limit, even, imbalance / even**2)
    out, j = [], len(cuts) - 1
    while j > 0:
        out.append((int(starts[back[j]]), int(cuts[j])))
        j = back[j]
    return out[::-1]


def _line_breaks(text: str) -> np.ndarray:
    return np.array([m.end() for m in re.finditer(r"\r\n|\n|\r", text)], dtype=np.int64)


PIECE = "piece_no int, n_pieces int, start_pos long, end_pos long, piece string, line_start long, line_end long"


def _pieces(keys: list[str], limit: int, overlap: int, schema: pa.Schema):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):  # one text at a time: a text may be large
                text, line = b.column("text")[row].as_py(), b.column("line_start")[row].as_py()
                lead = len(text) - len(text.lstrip(JS_SPACE))
                body = text.strip(JS_SPACE)
                spans = split_points(body, limit, overlap)
                breaks = _line_breaks(text)
                n = len(spans)
                cols: list[list] = [list(range(n)), [n] * n, [s + lead for s, _ in spans], [e + lead for _, e in spans], [body[s:e] for s, e in spans]]
                if line is None:
                    cols += [[None] * n, [None] * n]
                else:
                    cols.append([line + int(np.searchsorted(breaks, s + lead, "right")) for s, _ in spans])
                    cols.append([line + int(np.searchsorted(breaks, e + lead - 1, "right")) for _, e in spans])
                take = pa.array([row] * n, pa.int32())
                arrays = [b.column(k).take(take) for k in keys]
                arrays += [pa.array(c, schema.field(len(keys) + i).type) for i, c in enumerate(cols)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return step


def split_texts(chunks: DataFrame, keys: list[str], *, limit: int = LIMIT_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """The pieces of every text: keys, piece_no (from 0), n_pieces, start_pos and end_pos (code points of the text as it
    is stored), piece, line_start, line_end.

    Texts are trimmed first. A text within the limit is one piece; null and blank texts give none. Lines are counted
    from the chunk's line_start (LF, CR and CRLF end one); without it both are null. line_end of the chunk is not used,
    as it may be missing or out of date. Repeated rows give repeated pieces.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = chunks.select(*keys, "text", "line_start").where(js_trim(F.col("text")) != "")
    large = F.octet_length(js_trim(F.col("text"))) > limit
    lead = F.length("text") - F.length(F.ltrim(F.col("text"), F.lit(JS_SPACE)))
    body = js_trim(F.col("text"))
    count_breaks = lambda c: F.length(c) - F.length(F.translate(F.regexp_replace(c, "\r\n?", "\n"), "\n", "")) - (
        F.length(c) - F.length(F.regexp_replace(c, "\r\n", "\n"))
    )
    before = F.substring(F.col("text"), F.lit(1), lead)
    line = F.col("line_start").cast("long") + count_breaks(before)
    small = rows.where(~large).select(
        *keys,
        F.lit(0).alias("piece_no"),
        F.lit(1).alias("n_pieces"),
        lead.cast("long").alias("start_pos"),
        (lead + F.length(body)).cast("long").alias("end_pos"),
        body.alias("piece"),
        line.alias("line_start"),
        (line + count_breaks(body)).alias("line_end"),
    )
    fields = StructType([rows.schema[k] for k in keys] + list(chunks.sparkSession.createDataFrame([], PIECE).schema))
    big = rows.where(large).mapInArrow(_pieces(keys, limit, overlap, to_arrow_schema(fields)), fields)
    return small.unionByName(big)
