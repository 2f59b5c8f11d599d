"""Active branches of session files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.hierarchy import hierarchy
from engram.operators.paths import main_lines
from engram.operators.sessions import last_messages
from engram.session import cut, held


def active_chain(lines: DataFrame) -> DataFrame:
    """source_uri, entry_id of the entries on the way from each file's last message up through its parents.

    Of lines with one id the last by line number counts. The walk ends at an entry without a parent, at a parent that is
    not in the file, or where it meets an entry again; in a circle all entries it passed are part. Files without a
    message with an id have no chain.
    """
    last = Window.partitionBy("source_uri", "id").orderBy(F.desc("line_number"), "parentId")
    entries = (
        lines.where((F.col("id") != "") & F.col("source_uri").isNotNull())
        .select("source_uri", "id", "parentId", "line_number")
        .withColumn("_rn", F.row_number().over(last))
        .where("_rn = 1")
        .drop("_rn")
    )
    tree = hierarchy(entries, group_cols=["source_uri"], id_col="id", parent_col="parentId", position_col="line_number").select(
        F.col("source_uri").alias("grp"), F.col("root_id").alias("root"), "id", F.col("parentId").alias("parent"), "depth"
    )
    tree = held(tree)
    leaves = held(tree.join(last_messages(lines).select(F.col("source_uri").alias("grp"), F.col("leaf").alias("id")), ["grp", "id"]))
    straight = main_lines(tree.where("depth >= 0"), leaves.where("depth >= 0").select("grp", "root", F.col("id").alias("leaf"), F.col("depth").alias("leaf_depth")))
    found = straight.select(F.col("grp").alias("source_uri"), F.col("id").alias("entry_id"))
    return found.unionByName(_circular_walks(tree.where("depth < 0"), leaves.where("depth < 0")))


#: Circular nodes of a file up to which one task walks them; beyond it the walks of the file are extended by doubling jumps.
WALK_NODES = 262_144


def _walk(key: tuple, table: pa.Table) -> pa.Table:
    """The entries on the way up from the leaf of one file until one comes again."""
    up = dict(zip(table.column("id").to_pylist(), table.column("parent").to_pylist()))
    at, met = table.column("leaf")[0].as_py(), {}
    while at in up and at not in met:
        met[at] = True
        at = up[at]
    return pa.table({"source_uri": pa.array([key[0].as_py()] * len(met), pa.string()), "entry_id": pa.array(list(met), pa.string())})


def _circular_walks(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """All entries met on the way up from leaves that lead into circles."""
    mine = held(nodes.join(leaves.select("grp", F.col("id").alias("leaf")), "grp").select("grp", "id", "parent", "leaf"))
    sizes = mine.groupBy("grp").agg(F.count("*").alias("n"))
    small = mine.join(sizes.where(F.col("n") <= WALK_NODES), "grp", "left_semi")
    walked = small.groupBy("grp").applyInArrow(_walk, "source_uri string, entry_id string")
    large = sizes.where(F.col("n") > WALK_NODES).select("grp")
    if not large.limit(1).count():
        return walked
    return walked.unionByName(_doubled_walks(mine.join(large, "grp", "left_semi"), leaves.join(large, "grp", "left_semi")))


def _doubled_walks(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """The same for files of any size: the set is extended by jumps of doubling width."""
    passed = cut(leaves.select("grp", "id"))
    jumps = cut(nodes.select("grp", "id", F.col("parent").alias("up")))
    known = passed.count()
    while True:  # after k rounds the walks are 2 ** k entries long; they end once nothing new is met
        further = passed.join(jumps, ["grp", "id"]).select("grp", F.col("up").alias("id"))
        passed = cut(passed.unionByName(further).distinct())
        if (n := passed.count()) == known:
            break
        known = n
        above = jumps.select("grp", F.col("id").alias("up"), F.col("up").alias("next"))
        jumps = cut(jumps.join(above, ["grp", "up"]).select("grp", "id", F.col("next").alias("up")))
    return passed.select(F.col("grp").alias("source_uri"), F.col("id").alias("entry_id"))
