"""Parent-child links to full hierarchies.

Method: weighted disjoint-set forests. Every task links the rows it holds (``_local_forest``: each node gets the
highest ancestor it can reach inside the task and its distance to it). Only the links that leave a task go on: they are
a much smaller forest with weighted edges, which is merged hierarchically: MERGE neighbouring blocks of a group at a time, then
MERGE of those, until a group is whole. Whatever is still open after that (more open links than a task may hold) is closed
by doubling, whose rounds are the logarithm of the open links. A node that never reaches a top is on a circle or below one.

Nothing is collected: the memory of a task is bounded by ``batch_rows``, no matter how many rows a group has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions.text import group_key
from engram.session import cut, held

#: Rows that one task links at once.
BATCH_ROWS = 131_072
#: Positions (line numbers) of one group that stay together in the first step.
BLOCK_POSITIONS = 8_192
#: Blocks of one group that are merged at a time.
MERGE = 64
#: Blocks that nodes without a position are spread over.
SPREAD = 64


def _rows_above(keys: np.ndarray, parents: np.ndarray) -> np.ndarray:
    """The row of each row's parent, -1 where that is none of the rows."""
    n = len(keys)
    codes, _ = pd.factorize(np.concatenate([keys, parents]))
    row_of = np.full(codes.max() + 1 if len(codes) else 1, -1, dtype=np.int64)
    row_of[codes[:n]] = np.arange(n)
    return row_of[codes[n:]]


def _local_forest(keys: np.ndarray, parents: np.ndarray, weights: np.ndarray):
    """Highest reachable ancestor of each row among the rows, by pointer doubling over (pointer, weight) pairs.

    keys and parents are numbers; keys are unique, and a parent that is none of them ends its row's path.
    Returns (row of the top, distance to it, whether a circle was met instead).
    """
    n = len(keys)
    up = _rows_above(keys, parents)
    ends = up < 0
    pointer = np.where(ends, np.arange(n), up)
    distance = np.where(ends, 0, weights)
    for _ in range(max(1, int(n).bit_length()) + 1):
        open_ = ~ends[pointer]
        if not open_.any():
            break
        distance = distance + distance[pointer]
        pointer = pointer[pointer]
    return pointer, distance, ~ends[pointer]


def _batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _objects(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_pandas().to_numpy(dtype=object)


#: Path elements in one batch of output.
PATH_ELEMENTS = 500_000


def _paths(ways: list, up: np.ndarray) -> Iterator[tuple[int, int, pa.Array]]:
    """Slices (from, to, paths) of the rows with the path from each row's top down to it, put together of the rows' own ways;
    ``up`` is the row above, -1 at a top, -2 where a row never reaches one and so has no path."""
    start, values, offsets, up = 0, [], [0], up.tolist()
    for i in range(len(ways)):
        path, at = [], i if up[i] != -2 else -1
        while at >= 0:
            path.append(ways[at])
            at = up[at]
        for way in path[::-1]:
            values += way
        offsets.append(len(values))
        if len(values) >= PATH_ELEMENTS:
            yield start, i + 1, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.string()))
            start, values, offsets = i + 1, [], [0]
    if start < len(ways):
        yield start, len(ways), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.string()))


def _link_step(schema: pa.Schema, batch_rows: int):
    """Links the rows of a task. In: _g, _id, _up, _w, _top, _off and columns to keep; out: the same with _up the link
    that leaves the task (null: none), _top and _off the root so far and the distance to it, _circle."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _batches(batches, batch_rows):
            groups, _ = pd.factorize(_objects(table, "_g"))
            ids, ups = _objects(table, "_id"), _objects(table, "_up")
            id_codes, names = pd.factorize(np.concatenate([ids, ups]))
            n, width = len(ids), len(names) + 1
            met = table.column("_circle").to_numpy(zero_copy_only=False)
            none = (id_codes[n:] < 0) | met  # what is known to be circular goes no further
            keys = groups * width + id_codes[:n]
            parents = groups * width + id_codes[n:]
            parents[none] = -1 - np.arange(none.sum())  # no key is negative
            row, distance, circle = _local_forest(keys, parents, table.column("_w").to_numpy())
            circle = circle | met[row]
            tops, offs = _objects(table, "_top"), table.column("_off").to_numpy()
            for name, values in (("_up", ups[row]), ("_top", tops[row]), ("_off", distance + offs[row]), ("_circle", circle)):
                if name in ("_up", "_top"):
                    values = pa.array([v if v == v and v is not None else None for v in values], pa.string())
                else:
                    values = pa.array(values)
                table = table.set_column(table.schema.get_field_index(name), name, values.cast(schema.field(name).type))
            if "_path" not in schema.names:
                yield from table.select(schema.names).cast(schema).to_batches()
                continue
            up = _rows_above(keys, parents)
            up[circle] = -2
            for start, end, paths in _paths([way or [] for way in table.column("_path").to_pylist()], up):
                part = table.slice(start, end - start)
                part = part.set_column(part.schema.get_field_index("_path"), "_path", paths)
                yield from part.select(schema.names).cast(schema).to_batches()

    return step


def _linked(df: DataFrame, batch_rows: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    return df.mapInArrow(_link_step(to_arrow_schema(df.schema), batch_rows), df.schema)


def hierarchy(
    nodes: DataFrame,
    *,
    group_cols: list[str],
    id_col: str,
    parent_col: str,
    position_col: str | None = None,
    keep: list[str] | None = None,
    with_paths: bool = False,
    batch_rows: int = BATCH_ROWS,
    block_positions: int = BLOCK_POSITIONS,
) -> DataFrame:
    """Root and depth of every node; returns group_cols, ``keep``, id_col, parent_col, root_id, depth.

    nodes: one row per (group, id); groups may hold nulls (null equals null). Rows with a null id are left out.
    A null or empty parent is none. A parent that is no node of the group makes the node a root. A node that is on a
    circle, or whose ancestors lead into one, has root_id '' and depth -1. An empty table gives an empty table.
    with_paths: adds ``path``, the ids from the root to the node; null for circular nodes. Its size is the sum of all
    depths; use ``descendants`` on it for all pairs of a node and one below it.
    position_col: a number that is close for related rows (a line number); it only makes the first step more local.
    Columns of the input that are not named are dropped, so clashing names do no harm.
    """
    keep = [c for c in keep or [] if c not in {*group_cols, id_col, parent_col}]
    up = F.col(parent_col)
    up = F.when(up != "", up)
    spread = F.pmod(F.hash(id_col), F.lit(SPREAD))
    place = spread if position_col is None else F.coalesce(F.floor(F.col(position_col) / block_positions), spread)
    base = (
        nodes.where(F.col(id_col).isNotNull())
        .select(
            group_key(*[F.col(c) for c in group_cols]).alias("_g"),
            F.col(id_col).alias("_id"),
            up.alias("_up"),
            F.lit(1).cast("long").alias("_w"),
            F.col(id_col).alias("_top"),
            F.lit(0).cast("long").alias("_off"),
            F.lit(False).alias("_circle"),
            F.struct(*[F.col(c) for c in group_cols + keep], F.col(parent_col).alias("_parent")).alias("_row"),
            place.cast("long").alias("_place"),
        )
        .repartition("_g", "_place")
        .sortWithinPartitions("_g", "_place")
    )
    if with_paths:
        base = base.withColumn("_path", F.array("_id"))
    local = held(_linked(base, batch_rows))
    solved = _close(local, batch_rows)
    circle = F.col("_circle") | F.coalesce(F.col("s_circle"), F.lit(False))
    out = local.join(solved, ["_g", "_up"], "left").select(
        *[F.col(f"_row.{c}").alias(c) for c in group_cols + keep],
        F.col("_id").alias(id_col),
        F.col("_row._parent").alias(parent_col),
        F.when(circle, "").otherwise(F.coalesce("s_top", "_top")).alias("root_id"),
        F.when(circle, -1).otherwise(F.col("_off") + F.coalesce(F.col("s_off") + 1, F.lit(0))).cast("long").alias("depth"),
        *([F.when(~circle, F.concat(F.coalesce("s_path", F.array().cast("array<string>")), "_path")).alias("path")] if with_paths else []),
    )
    return out


def descendants(tree: DataFrame, group_cols: list[str], id_col: str) -> DataFrame:
    """All pairs of a node and one below it, from ``hierarchy(..., with_paths=True)``: group_cols, ancestor, descendant,
    distance. Circular nodes have no pairs."""
    steps = F.posexplode(F.expr("slice(path, 1, size(path) - 1)")).alias("_at", "ancestor")
    return tree.where("depth > 0").select(*group_cols, F.col(id_col).alias("descendant"), "depth", steps).select(
        *group_cols, "ancestor", "descendant", (F.col("depth") - F.col("_at")).alias("distance")
    )


def subtree_counts(tree: DataFrame, group_cols: list[str], id_col: str) -> DataFrame:
    """How many nodes lie below each node that has any, from ``hierarchy(..., with_paths=True)``: group_cols, id_col, n.

    Nodes are sorted by their paths, so that those below a node follow it at once; every task counts in one pass with a stack
    as high as a path, and adds up to one row for each node and each ancestor of its first one. Nothing is multiplied out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = tree.where("depth >= 0").select(group_key(*[F.col(c) for c in group_cols]).alias("_g"), *group_cols, F.col(id_col).alias("_id"), "depth", "path")
    fields = rows.select("_g", *group_cols, F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n")).schema
    ordered = rows.repartitionByRange("_g", "path").sortWithinPartitions("_g", "path")
    parts = ordered.mapInArrow(_count_step(to_arrow_schema(fields), group_cols), fields)
    return parts.groupBy("_g", id_col).agg(*[F.first(c).alias(c) for c in group_cols], F.sum("n").alias("n")).select(*group_cols, id_col, "n")


def _count_step(schema: pa.Schema, group_cols: list[str]):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # [id, nodes below] of the path that is open
        group, values = None, None
        out: list[list] = []

        def close(to: int) -> None:
            while len(stack) > to:
                name, below = stack.pop()
                if below:
                    out.append([group, *values, name, below])
                if stack:
                    stack[-1][1] += below

        def flush() -> pa.RecordBatch:
            columns = [pa.array([row[i] for row in out], schema.field(i).type) for i in range(len(schema))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for b in batches:
            groups, ids, depths, paths = (b.column(c) for c in ("_g", "_id", "depth", "path"))
            keys = [b.column(c).to_pylist() for c in group_cols]
            for i, (g, name, depth) in enumerate(zip(groups.to_pylist(), ids.to_pylist(), depths.to_pylist())):
                if g != group:
                    close(0)
                    group, values = g, [k[i] for k in keys]
                above = None
                if depth:
                    above = paths[i].values[depth - 1].as_py()
                if depth and not (len(stack) >= depth and stack[depth - 1][0] == above and stack[0][0] == paths[i].values[0].as_py()):
                    close(0)  # the first node of the task, or of a tree: its ancestors were met elsewhere
                    stack.extend([x, 0] for x in paths[i].as_py()[:-1])
                close(depth)
                if stack:
                    stack[-1][1] += 1
                stack.append([name, 0])
            if len(out) >= PATH_ELEMENTS:
                yield flush()
        close(0)
        yield flush()

    return step


def _close(local: DataFrame, batch_rows: int) -> DataFrame:
    """Root, distance and circle of every node that a link between tasks leads to: _g, _up, s_top, s_off, s_circle."""
    paths = "_path" in local.columns
    leaving = local.where(F.col("_up").isNotNull() & ~F.col("_circle")).select("_g", F.col("_up").alias("_id")).distinct()
    between = local.drop("_row").join(leaving, ["_g", "_id"], "left_semi")
    # a link from a boundary node goes from its local top to the node above that; merged over ever wider ranges of a group
    merged = held(between)
    places = merged.agg(F.max(F.abs("_place"))).collect()[0][0] or 0
    while True:
        merged = merged.withColumn("_place", F.floor(F.col("_place") / MERGE)).withColumn("_w", F.col("_off") + 1)
        merged = _linked(merged.repartition("_g", "_place").sortWithinPartitions("_g", "_place"), batch_rows)
        places //= MERGE
        if places == 0:
            break
    merged = cut(merged)
    state = ["_g", "_id", "_up", "_top", "_off", "_circle", *(["_path"] if paths else [])]
    heads = merged.select("_g", F.col("_id").alias("_up"), F.lit(True).alias("_known"))
    merged = (  # a link to what is no node ends where it is
        merged.join(heads, ["_g", "_up"], "left").withColumn("_up", F.when(F.col("_known") & ~F.col("_circle"), F.col("_up"))).select(*state)
    )
    rounds, first = 0, 0
    while open_links := merged.where(F.col("_up").isNotNull() & ~F.col("_circle")).count():
        first = first or open_links
        if 2**rounds > first:  # longer than any path of open links
            merged = merged.withColumn("_circle", F.col("_circle") | F.col("_up").isNotNull())
            break
        above = merged.select("_g", F.col("_id").alias("_up"), *[F.col(c).alias(f"a{c}") for c in state[2:]])
        open_ = F.col("a_top").isNotNull() & ~F.col("_circle")
        merged = cut(
            merged.join(above, ["_g", "_up"], "left").select(
                "_g",
                "_id",
                F.when(open_, F.col("a_up")).otherwise(F.col("_up")).alias("_up"),
                F.when(open_, F.col("a_top")).otherwise(F.col("_top")).alias("_top"),
                F.when(open_, F.col("_off") + 1 + F.col("a_off")).otherwise(F.col("_off")).alias("_off"),
                (F.col("_circle") | F.coalesce(F.col("a_circle"), F.lit(False))).alias("_circle"),
                *([F.when(open_, F.concat("a_path", "_path")).otherwise(F.col("_path")).alias("_path")] if paths else []),
            )
        )
        rounds += 1
    return merged.select(
        "_g",
        F.col("_id").alias("_up"),
        F.col("_top").alias("s_top"),
        F.col("_off").alias("s_off"),
        F.col("_circle").alias("s_circle"),
        *([F.col("_path").alias("s_path")] if paths else []),
    )
