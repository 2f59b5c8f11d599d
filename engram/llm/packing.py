"""Filling fixed-capacity containers with texts.

Method: exact-complement hashing on the histogram of lengths. The longest length left is completed by a single length, a
pair or a triple whose sum is exactly the gap, looked up by address in the table of counts; a combination is used as
often as its counts allow. What finds no exact complement is filled best-fit. The plan is made from the histogram alone,
which has at most ``capacity`` entries however many texts there are; texts then find their containers by their rank
among texts of the same length, so the rows are never collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.session import held

CAPACITY = 4_096
#: Parts that texts of one length are numbered in, so that a length that many texts share is no single task.
SALTS = 64
#: Texts of one length in one part, about: there are more parts where a length is more common.
PART_ROWS = 1_000_000


class _PairSums:
    """How many ordered pairs of the lengths present have each sum, up to the capacity. Lengths only ever run out."""

    def __init__(self, left: np.ndarray):
        self.present = left > 0
        self.count = np.zeros(len(left), dtype=np.int64)
        for a in np.flatnonzero(self.present):
            self.count[a:] += self.present[: len(left) - a]

    def drop(self, a: int) -> None:
        n = len(self.present) - a
        self.count[a:] -= 2 * self.present[:n]
        if a < n:
            self.count[2 * a] += 1  # the pair of a with itself was counted once
        self.present[a] = False


def _complement(gap: int, left: np.ndarray, sums: np.ndarray) -> list[int] | None:
    """One, two or three lengths with counts left that fill the gap exactly.

    ``sums`` is above 0 at least for all sums of two lengths left; the counts of a triple are checked after the look-up.
    """
    if gap < len(left) and left[gap]:
        return [gap]
    have = np.flatnonzero(left[: gap + 1])
    have = have[have > 0]
    if not len(have):
        return None

    def pair(rest: int, upto: int) -> list[int] | None:
        a = have[(have <= min(upto, rest - 1))]
        b = rest - a
        ok = (b >= 1) & (b <= upto) & (left[np.clip(b, 0, len(left) - 1)] > (a == b))
        ok &= left[a] > 0
        if not ok.any():
            return None
        i = int(np.flatnonzero(ok)[-1])
        return [int(a[i]), int(b[i])]

    found = pair(gap, gap)
    if found:
        return found
    for a in have[sums[gap - have] > 0][::-1]:
        left[a] -= 1
        found = pair(gap - int(a), int(a))
        left[a] += 1
        if found:
            return [int(a), *found]
    return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: how often in one container}, number of containers) that use every item of the histogram.

    Lengths are from 1 to capacity. No pattern exceeds the capacity.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] += n
    out: list[tuple[dict[int, int], int]] = []
    sums = _PairSums(left)
    top = capacity
    while True:
        while top > 0 and not left[top]:
            top -= 1
        if top == 0:
            return out
        items, gap = {top: 1}, capacity - top
        left[top] -= 1
        while gap:
            more = _complement(gap, left, sums.count)
            if more is None:  # best fit: the longest that still goes in
                fits = np.flatnonzero(left[: gap + 1])
                fits = fits[fits > 0]
                if not len(fits):
                    break
                more = [int(fits[-1])]
            for length in more:
                items[length] = items.get(length, 0) + 1
                left[length] -= 1
                gap -= length
        more_times = min(int(left[length]) // k for length, k in items.items())
        for length, k in items.items():
            left[length] -= k * more_times
            if not left[length]:
                sums.drop(length)
        out.append((items, 1 + more_times))


def _slots(patterns: list[tuple[dict[int, int], int]]):
    """By length, ascending in rank: first rank, first container, items of that length in a container."""
    used: dict[int, int] = {}
    rows, container = [], 0
    for items, times in patterns:
        for length, k in items.items():
            rows.append((length, used.get(length, 0), container, k))
            used[length] = used.get(length, 0) + k * times
        container += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return table, container


def ranked(items: DataFrame, by: str, key: list[str], salts: int = SALTS) -> DataFrame:
    """Adds ``rank``: a number from 0 among the rows of the same ``by``, without one task per value of it."""
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(salts)))
    counts = salted.groupBy(by, "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(by, "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy(by, "_salt").orderBy(*key))
    return (
        salted.join(offsets, [by, "_salt"]).withColumn("rank", F.col("_before") + number - 1).drop("_salt", "_before")
    )


def pack(sizes: DataFrame, *, id_col: str, size_col: str, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """A container for every item: id_col, part_no, part_start, size, container.

    An item within the capacity is whole (part_no 0, part_start 0). A larger one is cut into parts of the capacity and a
    rest. Items of size 0 (and null, taken as 0) need no room and are spread over the containers that there are. No
    container exceeds the capacity. id_col must be unique; a null id is an id like others. No items, no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    base = sizes.select(F.col(id_col), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("_size"))
    part = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_size") / capacity) - 1, F.lit(0)).cast("int")))
    items = held(
        base.select(id_col, "_size", part.alias("part_no")).select(
            id_col,
            "part_no",
            (F.col("part_no").cast("long") * capacity).alias("part_start"),
            F.least(F.lit(capacity).cast("long"), F.col("_size") - F.col("part_no").cast("long") * capacity).alias("size"),
        )
    )
    histogram = {r["size"]: r["n"] for r in items.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}
    table, containers = _slots(plan(histogram, capacity))
    most = items.groupBy("size").count().agg(F.max("count")).collect()[0][0] or 0
    numbered = ranked(items, "size", [id_col, "part_no"], max(salts, most // PART_ROWS))
    schema = items.withColumn("container", F.lit(0).cast("long")).schema
    names = items.columns
    wide = int(table[:, 1].max(initial=0)) + 1
    address = table[:, 0] * wide + table[:, 1] if len(table) else np.array([], dtype=np.int64)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("size").to_numpy(), b.column("rank").to_numpy()
            container = np.zeros(len(size), dtype=np.int64)
            some = size > 0
            if some.any():
                slot = np.searchsorted(address, size[some] * wide + np.minimum(rank[some], wide - 1), "right") - 1
                container[some] = table[slot, 2] + (rank[some] - table[slot, 1]) // table[slot, 3]
            if containers:
                container[~some] = rank[~some] % containers
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(container)], names=[*names, "container"])

    return numbered.mapInArrow(step, schema)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """containers, items, used, wasted share; one row."""
    by = packed.groupBy("container").agg(F.sum("size").alias("used"), F.count("*").alias("items"))
    return by.agg(
        F.count("*").alias("containers"),
        F.sum("items").alias("items"),
        F.sum("used").alias("used"),
        F.max("used").alias("fullest"),
        (1 - F.sum("used") / (F.count("*") * capacity)).alias("wasted"),
    )
