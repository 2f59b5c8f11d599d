"""Mixing sources to target weights.

Method: multivariate-hypergeometric splitting tree. The texts of a source are put in random order by a seeded hash and
cut into blocks of the hash range. The quota of a source is a number of whole passes over its blocks plus a part of one,
which is met to within one text. A splitting tree hands the blocks of all sources to output shards: at every node a
multivariate hypergeometric draw divides the exact block counts between the two halves of its shards. Each shard then
gets disjoint blocks of every source and is shuffled by itself. Plans are made from block totals only, of which there
are at most sources x MAX_BLOCKS; texts are never collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.session import held

#: Blocks of a source: at least BLOCKS, and more (up to MAX_BLOCKS, which bounds the plan on the driver) where there are more
#: shards to fill.
BLOCKS, MAX_BLOCKS = 1_024, 65_536
SEED = 20_240_229
#: Tokens that a shard holds about; there are never more shards than blocks in the mixture.
SHARD_TOKENS = 500_000


def source_name(source: Column) -> Column:
    """Spellings of a source made one: trimmed, lower case, underscores and spaces as hyphens."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[_\s]+", "-")


def quotas(totals: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens to take of each source.

    Shares are those of the sources that have any texts, scaled to one. Without ``total`` the mixture is the largest in
    which every source has exactly its share; with it, a source that cannot give its share gives all it may.
    """
    some = {s: w for s, w in shares.items() if w and w > 0 and totals.get(s, 0) > 0 and (repeats.get(s) or 0) > 0}
    weight = sum(some.values())
    if not some:
        return {}
    cap = {s: totals[s] * repeats[s] for s in some}
    if total is None:
        total = min(cap[s] * weight / w for s, w in some.items())
    return {s: min(cap[s], total * w / weight) for s, w in some.items()}


def splitting_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """shards x sources: how many blocks of each source every shard gets; sums are exact, shard sizes differ by at most
    one block per level of the tree."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    n = int(counts.sum())
    draw = rng.multivariate_hypergeometric(counts, n * left // shards, method="marginals") if n else counts * 0
    return np.concatenate([splitting_tree(draw, left, rng), splitting_tree(counts - draw, shards - left, rng)])


def block_plan(blocks: pd.DataFrame, quota: dict[str, float], shards: int | None, seed: int):
    """From block totals (source, block, tokens) the units (source, block, pass_no, shard, room): ``room`` is null for
    a whole block and the tokens wanted of it for the last, partial one."""
    rng = np.random.default_rng(seed)
    units: list[tuple] = []
    sources = sorted(quota)
    for s in sources:
        mine = blocks[blocks.source == s].sort_values("block")
        ids, tokens = mine.block.to_numpy(), mine.tokens.to_numpy()
        left, pass_no = quota[s], 0
        while left > 0.5:
            order = rng.permutation(len(ids))
            before = np.concatenate([[0], np.cumsum(tokens[order])])
            whole = int(np.searchsorted(before, left, "right")) - 1
            units += [(s, int(ids[i]), pass_no, None) for i in order[:whole]]
            left -= before[whole]
            if whole < len(ids):
                if left > 0.5:
                    units.append((s, int(ids[order[whole]]), pass_no, float(left)))
                break
            pass_no += 1
    if not units:
        return []
    total = sum(quota.values())
    shards = max(1, min(shards or round(total / SHARD_TOKENS), len(units)))
    counts = np.array([sum(u[0] == s for u in units) for s in sources], dtype=np.int64)
    tree = splitting_tree(counts, shards, rng)
    out = []
    for j, s in enumerate(sources):
        mine = [u for u in units if u[0] == s]
        order = rng.permutation(len(mine))
        shard_of = np.repeat(np.arange(shards), tree[:, j])
        out += [(*mine[i][:3], int(shard), mine[i][3]) for i, shard in zip(order, shard_of)]
    return out


PLAN = "source string, block int, pass_no int, shard int, room double"


def mix(
    texts: DataFrame,
    targets: DataFrame,
    *,
    id_col: str,
    size_col: str,
    identity_col: str,
    total: float | None = None,
    shards: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """A mixture: shard, position (from 0 within the shard), id_col, source, pass_no, size.

    texts: one row per text with ``source``, size_col (tokens) and identity_col (equal for equal texts). A text that
    occurs several times is one text, that of its smallest (source, id); its source is the one it then has. targets:
    source, target_share, max_repeats. Texts of no tokens, of no source and of sources without a target take no part;
    targets without texts get nothing, and the others' shares are scaled up. No text is used more than max_repeats
    times. Of repeated target rows the first by share and repeats counts.
    """
    spark = texts.sparkSession
    want = {}
    for r in targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").where("s is not null").orderBy("s", "target_share", "max_repeats").collect():
        want.setdefault(r["s"], (r["target_share"] or 0.0, r["max_repeats"] or 0))
    named = texts.select(F.col(id_col), source_name(F.col("source")).alias("source"), F.col(size_col).cast("long").alias("size"), identity_col)
    named = named.where((F.col("size") > 0) & F.col("source").isin(*want))
    first = F.min(F.struct("source", id_col, "size")).alias("t")
    unique = named.groupBy(identity_col).agg(first).select(f"t.{id_col}", "t.source", "t.size")
    h = F.xxhash64(id_col, F.lit(seed))
    unique = held(unique.withColumn("_h", h))
    tokens = unique.agg(F.sum("size")).collect()[0][0] or 0
    bits = max(BLOCKS, min(MAX_BLOCKS, int(4 * tokens / SHARD_TOKENS))).bit_length() - 1
    placed = unique.withColumn("block", F.shiftrightunsigned("_h", 64 - bits).cast("int"))
    blocks = placed.groupBy("source", "block").agg(F.sum("size").alias("tokens")).toPandas()  # at most len(want) x MAX_BLOCKS rows
    totals = {s: int(t) for s, t in blocks.groupby("source").tokens.sum().items()}
    quota = quotas(totals, {s: w for s, (w, _) in want.items()}, {s: int(r) for s, (_, r) in want.items()}, total)
    units = spark.createDataFrame(block_plan(blocks, quota, shards, seed), PLAN)
    taken = placed.join(F.broadcast(units), ["source", "block"])
    whole = taken.where("room is null")
    last = taken.where("room is not null")  # one block per source
    so_far = F.sum("size").over(Window.partitionBy("source", "block", "pass_no").orderBy("_h", id_col).rowsBetween(Window.unboundedPreceding, -1))
    last = last.withColumn("_before", F.coalesce(so_far, F.lit(0))).where(F.col("_before") + F.col("size") / 2 <= F.col("room")).drop("_before")
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(id_col, "pass_no", F.lit(seed + 1)), id_col, "pass_no")
    return whole.unionByName(last).select(
        "shard", (F.row_number().over(shuffled) - 1).cast("long").alias("position"), id_col, "source", "pass_no", "size"
    )


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """What was reached: source, target_share, max_repeats, texts, times (the most a text was used), tokens,
    actual_share; a row for every target, those without texts with zeros."""
    by = mixture.groupBy("source").agg(F.count("*").alias("texts"), (F.max("pass_no") + 1).cast("long").alias("times"), F.sum("size").alias("tokens"))
    all_ = Window.partitionBy()
    named = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    joined = named.join(by, "source", "left").na.fill(0, ["texts", "times", "tokens"])
    sum_ = F.sum("tokens").over(all_)  # one row per target
    return joined.withColumn("actual_share", F.when(sum_ > 0, F.col("tokens") / sum_).otherwise(0.0))
