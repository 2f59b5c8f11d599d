"""Processing only new or changed records.

Method: a Merkle tree over key ranges. Keys are ordered by the hash of their leading column and then that of the whole key,
so that the records of one source lie in one range (and a large one is still spread). Every record has a digest of its key
and version; a leaf holds the sum of the digests in its range (a sum, so it is built map-side and in any order), every
inner node that of its children. The number of levels follows the number of keys. Trees are compared from the root down,
and only below nodes that differ; only the records of differing leaves are compared one by one.

``ChangeStore`` keeps tree and handled records by ranges. A run reads the saved digests, and records only of ranges that
differ; it writes these ranges anew, names the others as they are, and makes output and tree visible together by claiming
the next entry of a log. A run that fails at any moment leaves the last state as it was, and the next run picks up the
same records; of two runs at once one fails.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.session import cut, held
from engram.sources.store import claim_entry, last_entry

#: A node has 16 children. The upper levels (4,096 nodes) are compared in one task; those of the first two (256 nodes)
#: are the ranges that a store keeps apart.
FAN_BITS = 4
UPPER, RANGES = 3, 2
#: Keys in a leaf, about.
LEAF_KEYS = 16
MAX_LEVELS = 10
LEVELS = UPPER


def levels_for(n: int) -> int:
    """Levels of a tree over n keys."""
    levels = UPPER
    while levels < MAX_LEVELS and n > LEAF_KEYS << (FAN_BITS * levels):
        levels += 1
    return levels


def key_leaf(keys: list[Column], levels: int = LEVELS) -> Column:
    """The leaf a key belongs to: bits of the hash of the leading column, then bits of the hash of the whole key."""
    low = FAN_BITS * (levels - RANGES)
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(keys[0]), 64 - FAN_BITS * RANGES), low) + F.shiftrightunsigned(F.xxhash64(*keys, F.lit(1)), 64 - low)


def _digest(*cols: Column) -> Column:
    """A record's digest as a decimal, so that sums of any number of records neither overflow nor depend on order."""
    return F.xxhash64(*cols, F.lit("engram")).cast("decimal(38,0)")


def merkle_leaves(records: DataFrame, keys: list[str], versions: list[str], levels: int = LEVELS) -> DataFrame:
    """leaf, n, digest of the records; null keys and versions count like any other value. No records, no leaves."""
    return (
        records.select(key_leaf([F.col(k) for k in keys], levels).alias("leaf"), _digest(*[F.col(c) for c in keys + versions]).alias("d"))
        .groupBy("leaf")
        .agg(F.count("*").alias("n"), F.sum("d").alias("digest"))
    )


def merkle_tree(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """level (0 is the root), node, n, digest of all nodes; each level is summed from the one below."""
    at = leaves.select(F.lit(levels).alias("level"), F.col("leaf").alias("node"), "n", "digest")
    tree = at
    for level in range(levels - 1, -1, -1):
        at = (
            at.groupBy(F.shiftright("node", FAN_BITS).alias("node"))
            .agg(F.sum("n").alias("n"), F.sum("digest").cast("decimal(38,0)").alias("digest"))
            .select(F.lit(level).alias("level"), "node", "n", "digest")
        )
        tree = tree.unionByName(at)
    return tree


def _levels(leaves: pd.DataFrame, levels: int) -> list[pd.DataFrame]:
    """The tree of one side, root first: n and digest by node."""
    at = leaves.assign(leaf=leaves.leaf.astype("int64")).set_index("leaf")[["n", "digest"]]
    out = [at]
    for _ in range(levels):
        at = at.groupby(at.index.to_numpy() >> FAN_BITS).agg({"n": "sum", "digest": lambda d: sum(d)})
        out.append(at)
    return out[::-1]


def _descend(levels: int):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = pd.concat([pd.DataFrame({"leaf": [], "n": [], "digest": [], "now": []}).astype({"now": bool}), *batches])
        a, b = (_levels(both[both.now == side], levels) for side in (True, False))
        differing = None
        for x, y in zip(a, b):
            pair = x.join(y, how="outer", lsuffix="_a", rsuffix="_b")
            if differing is not None:  # only below nodes that differ
                pair = pair[np.isin(pair.index.to_numpy(np.int64) >> FAN_BITS, differing)]
            differing = pair.index[(pair.n_a != pair.n_b) | (pair.digest_a != pair.digest_b)]
        yield pd.DataFrame({"leaf": np.asarray(differing, dtype=np.int64)})

    return step


def upper_nodes(leaves: DataFrame, levels: int) -> DataFrame:
    """The digests of the nodes of level UPPER, in the shape of leaves: at most 4,096 rows."""
    return (
        leaves.groupBy(F.shiftright("leaf", FAN_BITS * (levels - UPPER)).alias("leaf"))
        .agg(F.sum("n").alias("n"), F.sum("digest").cast("decimal(38,0)").alias("digest"))
    )


def changed_upper(current: DataFrame, saved: DataFrame) -> DataFrame:
    """Nodes of level UPPER (column leaf) in which two sets of digests differ: from the root down, a node is compared only
    where its parent differs. One task does it, over at most 2 * 4,096 rows. Without any nodes nothing differs."""
    both = current.withColumn("now", F.lit(True)).unionByName(saved.withColumn("now", F.lit(False)))
    return both.repartition(1).mapInPandas(_descend(UPPER), "leaf long")


def changed_leaves(current: DataFrame, saved: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaves (column leaf) in which two sets of Merkle leaves differ. Below level UPPER only the children of nodes that
    differ are compared, wherever they lie."""
    if levels == UPPER:
        return changed_upper(current, saved)
    nodes = F.broadcast(changed_upper(upper_nodes(current, levels), upper_nodes(saved, levels)).withColumnRenamed("leaf", "_node"))  # at most 4,096 numbers
    signed = current.unionByName(saved.select("leaf", (-F.col("n")).alias("n"), (-F.col("digest")).cast("decimal(38,0)").alias("digest")))
    below = signed.join(nodes, F.shiftright("leaf", FAN_BITS * (levels - UPPER)) == F.col("_node"), "left_semi")
    return below.groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("digest").alias("digest")).where("n <> 0 or digest <> 0").select("leaf")


def unseen(current: DataFrame, saved: DataFrame, keys: list[str], version: str, *, every: bool = False, levels: int | None = None) -> DataFrame:
    """Keys of ``current`` whose version is not in ``saved``; the records are looked at only in leaves that differ.

    current: one row per key. saved: any rows (key, version), repeated or not, of keys that may be gone.
    every: the key is unseen also where saved has another version beside the same one.
    Null versions equal null; null keys equal null. An empty ``saved`` makes every key unseen.
    """
    current, saved = held(current.select(*keys, version)), held(saved.select(*keys, version))
    latest = saved.groupBy(*keys).agg(F.max(version).alias(version)) if not every else saved.select(*keys, version).distinct()
    levels = levels or levels_for(current.count())
    now, then = (held(merkle_leaves(side, keys, [version], levels)) for side in (current, latest))
    leaves = held(changed_leaves(now, then, levels))
    here = current.withColumn("_leaf", key_leaf([F.col(k) for k in keys], levels)).join(leaves, F.col("_leaf") == F.col("leaf"), "left_semi")
    there = saved.withColumn("_leaf", key_leaf([F.col(k) for k in keys], levels)).join(leaves, F.col("_leaf") == F.col("leaf"), "left_semi")
    both = here.select(*keys, F.col(version).alias("_now"), F.lit(True).alias("_current")).unionByName(
        there.select(*keys, F.col(version).alias("_then"), F.lit(False).alias("_current")), allowMissingColumns=True
    )
    # one group per key: the current version against all saved ones
    now = F.max(F.when(F.col("_current"), F.struct("_now")))
    return (
        both.groupBy(*keys)
        .agg(now.alias("_now"), F.collect_set(F.when(~F.col("_current"), F.struct("_then"))).alias("_then"))
        .where(F.col("_now").isNotNull())
        .where(_differs(every))
        .select(*keys)
    )


def _differs(every: bool) -> Column:
    same = F.exists("_then", lambda t: t["_then"].eqNullSafe(F.col("_now._now")))
    other = F.exists("_then", lambda t: ~t["_then"].eqNullSafe(F.col("_now._now")))
    return ~same | other if every else ~same


class ChangeStore:
    """Published states in one folder: a log whose last entry names the output, the levels of the tree, its upper nodes and for
    every range the files with its leaves and handled records."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        os.makedirs(os.path.join(path, "_log"), exist_ok=True)

    @property
    def version(self) -> int:
        """The number of the last complete state, 0 before the first."""
        return last_entry(os.path.join(self.path, "_log"))

    @property
    def state(self) -> dict | None:
        version = self.version
        if not version:
            return None
        with open(os.path.join(self.path, "_log", f"{version:012d}.json")) as f:
            return json.load(f)

    def read(self, part: str) -> DataFrame | None:
        """output: of the last run; handled, tree: of all ranges."""
        state = self.state
        if state is None:
            return None
        if part == "output":
            return self.spark.read.parquet(os.path.join(self.path, state["output"]))
        return self._ranges(state, part, state["ranges"])

    def _ranges(self, state: dict, part: str, ranges) -> DataFrame:
        """Leaves (tree) or records (handled) of the given ranges; only their files are read."""
        files = [os.path.join(self.path, state["ranges"][r], part, f"range={r}") for r in ranges if r in state["ranges"]]
        schema = state[part]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def run(self, current: DataFrame, keys: list[str], version: str, process) -> DataFrame:
        """Give ``process`` the records that are new or changed since the last successful run, then publish its output
        together with the tree and the versions handled. Returns the output of this run. If anything fails, nothing is
        published. current: one row per key."""
        entry, saved = self.version, self.state
        now = current.select(*keys, version)
        n = now.count()
        levels = saved["levels"] if saved and levels_for(n) <= saved["levels"] + 1 else levels_for(n)
        leaf = key_leaf([F.col(k) for k in keys], levels)
        leaves = held(merkle_leaves(now, keys, [version], levels))
        upper = cut(upper_nodes(leaves, levels))
        if saved and levels == saved["levels"]:
            before = self.spark.read.parquet(os.path.join(self.path, saved["upper"]))
            nodes = [r[0] for r in changed_upper(upper, before).collect()]  # at most 4,096 numbers
            ranges = sorted({f"{x >> (FAN_BITS * (UPPER - RANGES))}" for x in nodes}, key=int)
            differing = held(changed_leaves(leaves, self._ranges(saved, "tree", ranges).select("leaf", "n", "digest"), levels)) if ranges else None
        else:
            ranges, differing = [f"{r}" for r in range(1 << (FAN_BITS * RANGES))], None
        inside = F.shiftright("_leaf", FAN_BITS * (levels - RANGES)).cast("string").isin(ranges)
        mine = now.withColumn("_leaf", leaf).where(inside)
        if saved and ranges:
            there = self._ranges(saved, "handled", ranges if levels == saved["levels"] else saved["ranges"]).select(*keys, version, "_leaf")
            here = mine
            if differing is not None:
                here, there = (side.join(differing, F.col("_leaf") == F.col("leaf"), "left_semi") for side in (mine, there))
            todo = _semi(current, _semi(here, there, [*keys, version], "left_anti"), keys)
        else:
            todo = current if ranges else current.limit(0)
        folder = f"state-{uuid.uuid4().hex}"
        where = os.path.join(self.path, folder)
        try:
            process(todo).write.parquet(os.path.join(where, "output"))
            upper.write.parquet(os.path.join(where, "upper"))
            kept = {r: f for r, f in (saved or {"ranges": {}})["ranges"].items() if r not in set(ranges)}
            if ranges:
                number = F.shiftright("_leaf", FAN_BITS * (levels - RANGES))
                rows = mine.withColumn("range", number)
                rows = rows.repartition("range", F.shiftright("_leaf", FAN_BITS * (levels - UPPER))).sortWithinPartitions("range", "_leaf")
                rows.write.partitionBy("range").parquet(os.path.join(where, "handled"))
                tree = leaves.withColumnRenamed("leaf", "_leaf").where(inside).withColumn("range", number).withColumnRenamed("_leaf", "leaf")
                tree.repartition("range").write.partitionBy("range").parquet(os.path.join(where, "tree"))
                used = tree.select("range").distinct().collect()  # at most 256 numbers
                kept |= {f"{r[0]}": folder for r in used}
            claim_entry(os.path.join(self.path, "_log"), entry + 1, {
                "levels": levels, "ranges": kept, "output": f"{folder}/output", "upper": f"{folder}/upper",
                "handled": _ddl(mine), "tree": _ddl(leaves),
            })
        except BaseException:
            shutil.rmtree(where, ignore_errors=True)
            raise
        return self.read("output")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _semi(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """A semi or anti join in which null keys equal null keys."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(r, on, how)
