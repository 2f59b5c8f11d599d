"""The way from chosen nodes of a forest up to their roots, by traversal in order of depth.

Rows are sorted by falling depth and read as a stream whose only state is the id wanted next. Long ways are cut into
bands of depth, so that no task reads a whole tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.operators.hierarchy import hierarchy

#: Depth levels that are read together.
BAND = 4_096


def _follow(keys: list[str]):
    """Rows sorted by keys and falling depth, to the rows on the path from ``entry`` upwards. The state is one id."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, wanted = None, None
        for b in batches:
            cols = [b.column(k).to_pylist() for k in keys]
            ids, ups, entries = (b.column(k).to_pylist() for k in ("id", "parent", "entry"))
            taken = []
            for i, key in enumerate(zip(*cols)):
                if key != at:
                    at, wanted = key, entries[i]
                if ids[i] == wanted:
                    taken.append(i)
                    wanted = ups[i]
            yield b.take(pa.array(taken, pa.int64()))

    return step


def on_path(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, F.desc("depth")).mapInArrow(_follow(keys), df.schema)


def main_lines(nodes: DataFrame, leaves: DataFrame, band: int = BAND) -> DataFrame:
    """The nodes on the way from the root to one leaf of each tree.

    nodes: grp, root, id, parent, depth and others; leaves: grp, root, leaf, leaf_depth. Adds ``band`` (depth // band)
    and ``last_band`` (that of the leaf).
    """
    on = ["grp", "root"]
    banded = nodes.withColumn("band", F.floor(F.col("depth") / band))
    entries = leaves.select(*on, F.floor(F.col("leaf_depth") / band).alias("band"), F.col("leaf").alias("entry"))
    long = leaves.where(F.col("leaf_depth") >= band)
    if long.limit(1).count():
        # the last node of a band is a gate; the gates above a leaf are a chain, walked with one row per band
        inner = banded.join(long, on, "left_semi").select(
            *on, "id", "parent", F.col("depth").alias("level"), F.when(F.col("depth") % band != 0, F.col("parent")).alias("up")
        )
        tops = hierarchy(inner, group_cols=on, id_col="id", parent_col="up", position_col="level", keep=["level"])
        above = inner.select(*on, F.col("id").alias("root_id"), F.col("parent").alias("gate"))
        chain = (
            tops.join(above, [*on, "root_id"])
            .join(long.select(*on, F.col("leaf").alias("entry")), on)
            .where((F.col("level") % band == band - 1) | (F.col("id") == F.col("entry")))
            .select(*on, "id", F.col("gate").alias("parent"), F.col("level").alias("depth"), "entry")
        )
        path = on_path(chain, on)
        entries = entries.unionByName(path.select(*on, F.floor(F.col("depth") / band).alias("band"), F.col("id").alias("entry"))).distinct()
    joined = banded.join(entries, [*on, "band"])
    last = leaves.select(*on, F.floor(F.col("leaf_depth") / band).alias("last_band"))
    return on_path(joined.join(last, on), [*on, "band"])
