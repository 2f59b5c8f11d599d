"""Most similar vectors for every vector.

Method: permutation index. A bounded sample of the vectors serves as pivots; a project uses the more of them the larger it
is. Every vector is represented by the order of its nearest pivots and posted in the inverted file of the first of them; as
a query it looks up the files of its first few pivots. Within a file, candidates are ranked by the footrule distance
between the orders; those within a radius, and all that tie with its edge, are reranked by their exact cosine. Files are
split into blocks, and every block of queries meets every block of members, so no task holds more than two blocks and no
vector is left out.

How many pivots, how many files to look up and which radius depends on how the vectors lie, so it is fitted: for every
class of project sizes, a bounded sample of queries (SAMPLE) is compared with all vectors of their projects, and the
cheapest setting that finds the share ``recall`` of their true neighbours is taken. Vectors in clusters need a few files
whatever their number, so work grows about in proportion; for vectors without any structure no index saves much, and the
fitted setting comes close to comparing all with all. A query that finds fewer than k partners looks up all files.

Vectors of one direction (copies) are indexed once per project, with the few smallest chunk_ids that anyone can need of
them; a membership table gives the result back to every copy.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.session import held

#: Most pivots: a bounded sample, the distinct directions with the smallest hashes (16 MB at 64 values).
MAX_PIVOTS = 65_536
#: Vectors for each pivot of a project.
FILE = 512
#: Pivots and places of the order that the footrule distance compares.
ORDER_PIVOTS, PREFIX = 512, 32
#: Vectors in a block of a file.
BLOCK = 4_096
#: Queries in the sample of each class of sizes (a class doubles the one before; there are at most 17).
SAMPLE = 128
#: Share of true neighbours of the sample that the files looked up must keep.
RECALL = 0.995
#: What sending a vector to one more file costs, in comparisons.
SENDING = 200


def usable_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors of ``dim`` finite values that are not all zero; of a repeated key the smallest vector.

    Null vectors, null values, NaN, infinite values and other lengths are left out, as are rows with a null key.
    """
    e = F.col("embedding")
    fine = (F.size(e) == dim) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    return (
        vectors.where(fine & F.col("project_id").isNotNull() & F.col("chunk_id").isNotNull())
        .groupBy("project_id", "chunk_id")
        .agg(F.min("embedding").alias("embedding"))
    )


def _unit(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # neither overflows nor vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column, dim: int) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(-1, dim)


def _directions(dim: int):
    """Adds direction, a digest of the unit vector (the same for exactly proportional vectors), and spread, one of the unit
    vector in four decimals."""

    def step(batches):
        for b in batches:
            x = _unit(_matrix(b.column("embedding"), dim)) + 0.0  # no negative zeros
            digests = [[hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in y] for y in (x, np.round(x, 4) + 0.0)]
            yield pa.RecordBatch.from_arrays(
                b.columns + [pa.array(d, pa.binary()) for d in digests], names=[*b.schema.names, "direction", "spread"]
            )

    return step


def _with_copies(usable: DataFrame, dim: int, k: int) -> DataFrame:
    """Vectors with ``ids``, the k + 1 smallest chunk_ids of their direction in the project (null for one without copies),
    and ``first``, the smallest of them: the vector that stands for all of them in the index.

    k + 1 ids are enough: another direction can use k of them, a copy k besides itself.
    """
    directed = held(usable.select("project_id", "chunk_id", "embedding").mapInArrow(
        _directions(dim), "project_id string, chunk_id string, embedding array<float>, direction binary, spread binary"
    ))
    place = F.row_number().over(Window.partitionBy("project_id", "direction").orderBy("chunk_id"))
    copied = (
        directed.select("project_id", "direction", "chunk_id", place.alias("place")).where(F.col("place") <= k + 1)
        .groupBy("project_id", "direction").agg(F.sort_array(F.collect_list("chunk_id")).alias("ids"))  # at most k + 1 each
        .where(F.size("ids") > 1)
    )
    return held(
        directed.join(copied, ["project_id", "direction"], "left").select(
            "project_id", "chunk_id", "embedding", "spread", "ids", F.coalesce(F.get("ids", F.lit(0)), "chunk_id").alias("first")
        )
    )


def pivot_order(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """For each row the numbers of its nearest pivots, nearest first."""
    sim = x.astype(np.float32) @ pivots.T
    prefix = min(prefix, len(pivots))
    near = np.argpartition(-sim, prefix - 1, axis=1)[:, :prefix]
    order = np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable")
    return np.take_along_axis(near, order, 1).astype(np.int32)


def _weights(order: np.ndarray, n_pivots: int) -> np.ndarray:
    """pivots x rows: how early each pivot comes in the order of each row (0: not at all).

    The footrule distance of two orders, an absent pivot counting as just behind the prefix, is a constant less twice
    the sum of the smaller of the two weights over all pivots.
    """
    n, prefix = order.shape
    w = np.zeros((n_pivots, n), dtype=np.uint8)
    w[order, np.arange(n)[:, None]] = np.arange(prefix, 0, -1, dtype=np.uint8)
    return w


def _search(q: dict, m: dict, n_pivots: int, k: int, radius: int):
    """Best k members of other directions for each query of one pair of blocks: query, member, similarity.

    Members come in the order of their smallest ids. Of directions with equal similarity only the k with the smallest such
    ids can give one of the best k, so k directions are opened in all.
    """
    w = _weights(m["order"], n_pivots)
    prefix = m["order"].shape[1]
    early = np.arange(prefix, 0, -1, dtype=np.uint8)[:, None]
    place = {name: i for i, name in enumerate(m["own"])}
    out_q, out_m, out_s = [], [], []
    for i, own in enumerate(q["own"]):
        closeness = np.minimum(w[q["order"][i]], early).sum(axis=0, dtype=np.int32)
        if (j := place.get(own)) is not None:
            closeness[j] = -1
        found = np.flatnonzero(closeness >= radius)
        if len(found) <= k:  # hardly any within the radius: the file is small, or the query far from all
            found = np.flatnonzero(closeness >= 0)
        if not len(found):
            continue
        sim = np.round(m["x"][found] @ q["x"][i], 9)
        if len(found) > k:
            edge = np.partition(sim, len(sim) - k)[len(sim) - k]
            close = sim >= edge
            found, sim = found[close], sim[close]
        opened = np.argsort(-sim, kind="stable")[:k]
        best = sorted((-sim[j], b) for j in opened for b in m["ids"][found[j]])[:k]
        out_q += [own] * len(best)
        out_m += [b for _, b in best]
        out_s += [-s for s, _ in best]
    return out_q, out_m, out_s


def _block_search(pivots: np.ndarray, dim: int, k: int, prefix: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = np.array(table.column("chunk_id").to_pylist(), dtype=object)
        rank = np.argsort(own)
        own, table = own[rank], table.take(pa.array(rank))
        x = _unit(_matrix(table.column("embedding"), dim))
        order = pivot_order(x, pivots, prefix)
        ids = np.empty(len(own), dtype=object)
        ids[:] = table.column("ids").to_pylist()
        query, member = (table.column(c).to_numpy(zero_copy_only=False) for c in ("as_query", "as_member"))
        side = lambda rows: {"own": own[rows], "ids": ids[rows], "x": x[rows], "order": order[rows]}
        found = _search(side(query), side(member), len(pivots), k, table.column("radius")[0].as_py())
        return pa.table(
            {
                "project_id": pa.array([key[0].as_py()] * len(found[0]), pa.string()),
                "query": pa.array(found[0], pa.string()),
                "member": pa.array(found[1], pa.string()),
                "sim": pa.array(found[2], pa.float64()),
            }
        )

    return run


def _post(pivots: np.ndarray, dim: int, settings: dict[int, tuple[int, int, int]]):
    """Adds heads, the files a vector looks up; the first of them is the one it is posted in."""

    def step(batches):
        for b in batches:
            level = b.column("level").to_numpy()
            heads = np.empty(b.num_rows, dtype=object)
            for at in np.unique(level):
                rows = np.flatnonzero(level == at)
                n, lookups, _ = settings[int(at)]
                x = _unit(_matrix(b.column("embedding").take(pa.array(rows)), dim))
                for i, order in zip(rows, pivot_order(x, pivots[:n], lookups).tolist()):
                    heads[i] = order
            yield pa.RecordBatch.from_arrays(b.columns + [pa.array(heads.tolist(), pa.list_(pa.int32()))], names=[*b.schema.names, "heads"])

    return step


def _calibration(queries: list, pivots: np.ndarray, dim: int, k: int, prefix: int):
    """For the sampled queries (number, project_id, chunk_id, embedding, level) the best k vectors of each batch: number, sim,
    closeness, and for 1, 2, 4, ... pivots up to those of the level the number of files to look up until it is found."""
    by_project: dict = {}
    for q in queries:
        by_project.setdefault(q["project_id"], []).append(q)

    def step(batches):
        for b in batches:
            projects = np.array(b.column("project_id").to_pylist(), dtype=object)
            ids = np.array(b.column("chunk_id").to_pylist(), dtype=object)
            out: list[list] = [[], [], [], []]
            for project in set(projects) & by_project.keys():
                rows = np.flatnonzero(projects == project)
                x = _unit(_matrix(b.column("embedding").take(pa.array(rows)), dim))
                for q in by_project[project]:
                    y = _unit(np.array([q["embedding"]], dtype=np.float64))
                    sim = np.where(ids[rows] == q["chunk_id"], -2.0, x @ y[0])
                    near = np.argsort(-sim)[:k]
                    near = near[sim[near] > -2]
                    if not len(near):
                        continue
                    order = pivot_order(y, pivots[:ORDER_PIVOTS], prefix)
                    w = _weights(pivot_order(x[near], pivots[:ORDER_PIVOTS], prefix), min(len(pivots), ORDER_PIVOTS))
                    closeness = np.minimum(w[order[0]], np.arange(order.shape[1], 0, -1, dtype=np.uint8)[:, None]).sum(axis=0, dtype=np.int32)
                    to_query, to_near = (z.astype(np.float32) @ pivots[: 2 ** q["level"]].T for z in (y, x[near]))
                    needs = []
                    for step_ in range(q["level"] + 1):
                        n = min(2**step_, len(pivots))
                        home = to_near[:, :n].argmax(axis=1)
                        needs.append((to_query[0, :n] > to_query[0, home][:, None]).sum(axis=1) + 1)
                    out[0] += [q["number"]] * len(near)
                    out[1] += sim[near].tolist()
                    out[2] += closeness.tolist()
                    out[3] += np.stack(needs, axis=1).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.int32()))],
                names=["number", "sim", "closeness", "needs"],
            )

    return step


def _fit(rows: list, levels: dict[int, int], recall: float) -> dict[int, tuple[int, int, int]]:
    """level: pivots, files to look up, radius. rows: level, closeness and needs of the true neighbours of the sample."""
    settings = {}
    for level, largest in levels.items():
        mine = [r for r in rows if r["level"] == level]
        if not mine:  # projects of a single vector
            settings[level] = (1, 1, 0)
            continue
        best = None
        for step in range(level + 1):
            needs = sorted(r["needs"][step] for r in mine)
            lookups = needs[min(len(needs) - 1, int(np.ceil(recall * len(needs))) - 1)]
            cost = largest * largest * lookups / 2**step + SENDING * largest * (lookups + 1)
            if best is None or cost < best[0]:
                best = (cost, 2**step, lookups)
        settings[level] = (best[1], best[2], min(r["closeness"] for r in mine) // 2)  # wider than the sample needs, as it is only a sample
    return settings


def _settings(distinct: DataFrame, levels: dict[int, tuple[int, int]], pivots: np.ndarray, dim: int, k: int, recall: float, prefix: int):
    """Fits the settings of all levels (level: largest project, vectors) to a sample of queries."""
    share = F.element_at(F.create_map(*[F.lit(v) for level, (_, n) in levels.items() for v in (level, min(1.0, 1.5 * SAMPLE / n))]), F.col("level"))
    drawn = (F.pmod(F.xxhash64("project_id", "chunk_id"), F.lit(1 << 30)) / float(1 << 30)) < share
    taken: dict[int, int] = {}
    queries = []
    for r in distinct.where(drawn).select("project_id", "chunk_id", "embedding", "level").orderBy("project_id", "chunk_id").collect():  # about 1.5 SAMPLE a level
        if taken.setdefault(r["level"], 0) < 2 * SAMPLE:
            taken[r["level"]] += 1
            queries.append({**r.asDict(), "number": len(queries)})
    near = distinct.select("project_id", "chunk_id", "embedding").mapInArrow(
        _calibration(queries, pivots, dim, k, prefix), "number int, sim double, closeness int, needs array<int>"
    )
    best = F.slice(F.sort_array(F.collect_list(F.struct("sim", "closeness", "needs")), False), 1, k)  # k of each batch
    rows = near.groupBy("number").agg(best.alias("b")).select("number", F.explode("b").alias("b")).select("number", "b.*").collect()
    return _fit([{**r.asDict(), "level": queries[r["number"]]["level"]} for r in rows], {at: n for at, (n, _) in levels.items()}, recall)


def _find(queries: DataFrame, members: DataFrame, pivots: np.ndarray, dim: int, k: int, prefix: int, block: int) -> DataFrame:
    """Searches files: every block of a file's queries against every block of its members. Both: project_id, head, chunk_id,
    embedding, ids, radius."""
    files = members.groupBy("project_id", "head").agg(F.ceil(F.count("*") / block).cast("int").alias("m_blocks"))
    asked = queries.groupBy("project_id", "head").agg(F.ceil(F.count("*") / block).cast("int").alias("q_blocks"))
    files = files.join(asked, ["project_id", "head"])
    own = F.xxhash64("chunk_id", "head")
    cols = ["project_id", "head", "chunk_id", "embedding", "ids", "radius"]

    def placed(rows: DataFrame, mine: str, other: str, i: str, j: str):
        at = rows.join(files, ["project_id", "head"]).withColumn(i, F.pmod(own, F.col(mine)).cast("int"))
        return at.select(*cols, i, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(j))

    as_query = placed(queries, "q_blocks", "m_blocks", "i", "j").select(*cols, "i", "j", F.lit(True).alias("as_query"), F.lit(False).alias("as_member"))
    as_member = placed(members, "m_blocks", "q_blocks", "j", "i").select(*cols, "i", "j", F.lit(False).alias("as_query"), F.lit(True).alias("as_member"))
    found = as_query.unionByName(as_member).groupBy("project_id", "head", "i", "j").applyInArrow(
        _block_search(pivots[:ORDER_PIVOTS], dim, k, prefix), "project_id string, query string, member string, sim double"
    )
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("s"), "member"))), 1, k)
    return found.groupBy("project_id", F.col("query").alias("first")).agg(best.alias("best"))  # at most k per pair of blocks


def nearest(
    vectors: DataFrame, *, dim: int, k: int = 5, recall: float = RECALL, exact: bool = False, file: int = FILE, prefix: int = PREFIX, block: int = BLOCK
) -> DataFrame:
    """For every usable vector up to k others of its project with the greatest cosine (rounded to 9 decimals, ties to
    the smaller chunk_id): project_id, query, member, sim.

    A project with fewer than k + 1 vectors gives all of them; one with a single vector gives no rows. Equal vectors are
    neighbours like any others. Neighbours may be missed where neither lies in a file the other looks up; the share found
    is measured against brute force in the tests. exact: one file per project and no radius, so that none is missed.
    """
    marked = _with_copies(usable_vectors(vectors, dim), dim, k)
    distinct = marked.where("chunk_id = first").withColumn("ids", F.coalesce("ids", F.array("chunk_id")))
    level = F.least(F.greatest(F.ceil(F.log2(F.count("*") / file)), F.lit(0)), F.lit(MAX_PIVOTS.bit_length() - 1)).cast("int")
    sizes = held(distinct.groupBy("project_id").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("n_ids"), (F.lit(0) if exact else level).alias("level")))
    levels = {r["level"]: (r["largest"], r["n"]) for r in sizes.groupBy("level").agg(F.max("n").alias("largest"), F.sum("n").alias("n")).collect()}
    schema = "project_id string, query string, member string, sim double"
    if not levels:
        return vectors.sparkSession.createDataFrame([], schema)
    n_pivots = max(2 ** max(levels), ORDER_PIVOTS)
    chosen = distinct.select("spread").distinct().orderBy("spread").limit(n_pivots)  # near copies make no two pivots either
    sample = distinct.join(F.broadcast(chosen), "spread").groupBy("spread").agg(F.min("embedding").alias("embedding"))  # bounded: n_pivots rows
    rows = sample.orderBy("spread").select("embedding").collect()
    pivots = _unit(np.array([r[0] for r in rows], dtype=np.float64)).astype(np.float32)
    if 2 ** max(levels) > len(pivots):  # so many near copies that there are fewer directions than pivots wanted
        most = len(pivots).bit_length() - 1
        sizes = sizes.withColumn("level", F.least("level", F.lit(most)))
        merged: dict[int, tuple[int, int]] = {}
        for at, (largest, n) in levels.items():
            was = merged.get(min(at, most), (0, 0))
            merged[min(at, most)] = (max(was[0], largest), was[1] + n)
        levels = merged
    sized = held(distinct.drop("spread", "first").join(sizes, "project_id"))
    settings = {at: (1, 1, 0) for at in levels} if exact else _settings(sized, levels, pivots, dim, k, recall, prefix)
    posted = held(
        sized.mapInArrow(_post(pivots, dim, settings), sized.withColumn("heads", F.array().cast("array<int>")).schema).withColumn(
            "radius", F.element_at(F.create_map(*[F.lit(v) for at, (_, _, r) in settings.items() for v in (at, int(r))]), F.col("level"))
        )
    )
    cols = ["project_id", "chunk_id", "embedding", "ids", "radius"]
    members = posted.select(*cols, F.get("heads", F.lit(0)).alias("head"))
    near = held(_find(posted.select(*cols, F.explode("heads").alias("head")), members, pivots, dim, k, prefix, block))
    # queries whose files hold fewer than k others: once more, in all files
    others = F.col("n_ids") - F.size("ids")
    short = posted.join(near.select("project_id", F.col("first").alias("chunk_id"), F.size("best").alias("got")), ["project_id", "chunk_id"], "left").where(
        F.coalesce("got", F.lit(0)) < F.least(F.lit(k), others)
    )
    short = held(short)
    if short.limit(1).count():
        heads = members.select("project_id", "head").distinct()
        again = _find(short.select(*cols).join(heads, "project_id"), members, pivots, dim, k, prefix, block)
        near = near.join(again.select("project_id", "first"), ["project_id", "first"], "left_anti").unionByName(again)
    pair = "array<struct<s:double,member:string>>"
    none = F.array().cast(pair)
    copies = F.coalesce(F.transform("ids", lambda c: F.struct(F.lit(-1.0).alias("s"), c.alias("member"))).cast(pair), none)
    others = F.filter(F.concat(copies, F.coalesce("best", none)), lambda o: o["member"] != F.col("chunk_id"))
    return (
        marked.select("project_id", "chunk_id", "ids", "first")
        .join(near, ["project_id", "first"], "left")
        .select("project_id", F.col("chunk_id").alias("query"), F.explode(F.slice(F.array_sort(others), 1, k)).alias("b"))
        .select("project_id", "query", "b.member", (-F.col("b.s")).alias("sim"))
    )


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """Unordered pairs of ``nearest``: project_id, chunk_id_a < chunk_id_b."""
    return found.select(
        "project_id", F.least("query", "member").alias("chunk_id_a"), F.greatest("query", "member").alias("chunk_id_b")
    ).distinct()
