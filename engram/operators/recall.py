"""Nearest-neighbour recall: exact, filtered before ranking, for one query or many."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.vectors import cosine, l2, score, vector_literal

EQUALITY = ("source_uri", "entry_id", "parent_id", "cwd")
#: Queries and vectors in one block of a batched search.
QUERY_BLOCK, VECTOR_BLOCK = 1_024, 8_192


def search_filter(
    *,
    source_uri: str | None = None,
    entry_id: str | None = None,
    parent_id: str | None = None,
    cwd: str | None = None,
    line_number: int | None = None,
    timestamp_from: str | None = None,
    timestamp_to: str | None = None,
) -> Column | None:
    """The conjunction of the given filters, None without any. '' is a filter like any other; rows with a null never
    match. Times are compared as text, both ends included."""
    given = dict(zip(EQUALITY, (source_uri, entry_id, parent_id, cwd)))
    parts = [F.col(c) == v for c, v in given.items() if v is not None]
    if line_number is not None:
        parts.append(F.col("line_number") == line_number)
    if timestamp_from is not None:
        parts.append(F.col("timestamp") >= timestamp_from)
    if timestamp_to is not None:
        parts.append(F.col("timestamp") <= timestamp_to)
    return reduce(lambda a, b: a & b, parts) if parts else None


def top_k(rows: DataFrame, query: Sequence[float], k: int, *, where: Column | None = None, vector_col: str = "embedding", ties: Sequence[str] = ()) -> DataFrame:
    """The k rows nearest to ``query`` (all columns but the vector, plus distance and score), nearest first.

    ``where`` is applied before ranking. Rows whose vector is null or of another length are left out; equal distances are
    ordered by ``ties``. Plans as scan, filter, TakeOrderedAndProject.
    """
    found = rows if where is None else rows.where(where)
    found = found.withColumn("distance", l2(F.col(vector_col), vector_literal(query))).where("distance is not null and not isnan(distance)")
    return found.drop(vector_col).withColumn("score", score(F.col("distance"))).orderBy("distance", *ties).limit(k)


def top_k_cosine(rows: DataFrame, query: Sequence[float], k: int, *, vector_col: str = "embedding", ties: Sequence[str] = ()) -> DataFrame:
    found = rows.withColumn("similarity", cosine(F.col(vector_col), vector_literal(query))).where("similarity is not null and not isnan(similarity)")
    return found.drop(vector_col).orderBy(F.desc("similarity"), *ties).limit(k)


def ranked(hits: DataFrame, *ties: str) -> DataFrame:
    """Adds ``rank`` from 1 by distance; hits are the at most k rows of one search."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy("distance", *ties)))


def _block_top_k(k: int):
    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        q, v = (np.array(t.column(c).to_pylist(), dtype=np.float64) for t, c in ((queries, "q_vector"), (vectors, "v_vector")))
        qid, vid = queries.column("query_id").to_numpy(), vectors.column("id").to_numpy()
        square = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * q @ v.T
        keep = min(len(vid), k + 8)
        near = np.argpartition(square, keep - 1, axis=1)[:, :keep]
        edge = np.take_along_axis(square, near, 1).max(1)
        out_q, out_v, out_d = [], [], []
        for i in range(len(qid)):
            rows = np.flatnonzero(square[i] <= edge[i] + 1e-9)  # the exact distance decides
            d = np.sqrt(((v[rows] - q[i]) ** 2).sum(1))
            best = np.lexsort((vid[rows], d))[:k]
            out_q += [qid[i]] * len(best)
            out_v += vid[rows][best].tolist()
            out_d += d[best].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "id": pa.array(out_v, pa.int64()), "distance": pa.array(out_d, pa.float64())})

    return run


def batch_top_k(queries: DataFrame, vectors: DataFrame, k: int, *, dim: int) -> DataFrame:
    """For each query the k nearest vectors of its group: query_id, rank, id, distance, score; ties to the smaller id.

    queries: grp, query_id (bigint), vector; vectors: grp, id (bigint), vector. Both sides are cut into blocks by hash and
    every block of queries meets every block of vectors of its group, so no task holds a whole group. Vectors of another
    length or with a null are left out.
    """
    fits = (F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)) & F.col("grp").isNotNull()
    queries = queries.where(fits).select("grp", "query_id", "vector")
    vectors = vectors.where(fits).select("grp", "id", "vector")
    sizes = (
        queries.groupBy("grp").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("nq"))
        .join(vectors.groupBy("grp").agg(F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("nv")), "grp")
    )
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.join(sizes, "grp").select("grp", F.pmod(F.hash("query_id"), F.col("nq")).alias("qb"), all_("nv").alias("vb"), "query_id", "vector")
    v = vectors.join(sizes, "grp").select("grp", all_("nq").alias("qb"), F.pmod(F.hash("id"), F.col("nv")).alias("vb"), "id", "vector")
    q, v = q.toDF("grp", "qb", "vb", "query_id", "q_vector"), v.toDF("v_grp", "v_qb", "v_vb", "id", "v_vector")
    found = q.groupBy("grp", "qb", "vb").cogroup(v.groupBy("v_grp", "v_qb", "v_vb")).applyInArrow(_block_top_k(k), "query_id long, id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "id", "distance", score(F.col("distance")).alias("score")
    )
