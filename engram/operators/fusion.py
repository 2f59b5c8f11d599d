"""Reciprocal-rank fusion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.errors import InvalidArgumentError

RRF_K = 60


def rrf(lists: DataFrame, id_col: str | Column = "id", *, k: float = RRF_K) -> DataFrame:
    """Fused list: id, score, list_idx and rank of the first sight, best first.

    lists: list_idx, rank (from 1), the id and any payload. Each occurrence adds 1 / (k + rank), also a repeated one in
    the same list; equal scores are ordered by first sight. Contributions are added in the order of the lists, so that
    scores come out the same however the rows are spread. Rows with a null id form one item; no rows give no rows.
    """
    if isinstance(k, bool) or not isinstance(k, (int, float)) or not math.isfinite(k) or k <= 0:
        raise InvalidArgumentError(f"k must be a positive finite number, got {k}")
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    seen = F.array_sort(F.collect_list(F.struct("list_idx", "rank")))  # bounded by the number of lists
    total = F.aggregate("seen", F.lit(0.0), lambda s, x: s + F.lit(1.0) / (F.lit(float(k)) + x["rank"]))
    return (
        lists.groupBy(key.alias("id"))
        .agg(seen.alias("seen"))
        .select("id", total.alias("score"), F.col("seen")[0]["list_idx"].alias("list_idx"), F.col("seen")[0]["rank"].alias("rank"))
        .orderBy(F.desc("score"), "list_idx", "rank")
    )


def first_payload(lists: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """The payload each id had when it was first seen."""
    return lists.groupBy(id_col).agg(F.min_by(payload_col, F.struct("list_idx", "rank")).alias(payload_col))
