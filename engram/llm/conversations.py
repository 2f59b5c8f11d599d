"""Rebuilding conversations from message rows.

Method: rows are partitioned by conversation and sorted within it by depth (the sequence number on the way from the root
to the last message); a finite-state automaton then reads the turns and accepts the conversations that are whole. Long
conversations are cut into bands of depth. In each band the automaton runs from all of its states, giving a function
from state to state; the functions of the bands are composed afterwards, so no task ever holds a whole conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import blank_to_null
from engram.operators.hierarchy import hierarchy
from engram.operators.paths import BAND, main_lines
from engram.operators.sessions import ROLES, session_entries
from engram.session import held

# The automaton. States, and by state the next one after a turn of the user and of the assistant.
START, ASKED, ANSWERED, BROKEN = range(4)
AFTER = {"user": (ASKED, BROKEN, ASKED, BROKEN), "assistant": (BROKEN, ANSWERED, ANSWERED, BROKEN)}
ACCEPTED = ANSWERED


def run_automaton(roles: list[str]) -> list[int]:
    """The state reached from each state after these turns."""
    states = list(range(4))
    for role in roles:
        step = AFTER[role]
        states = [step[s] for s in states]
    return states


def _read_turns(schema: pa.Schema):
    """Rows of main lines (sorted by grp, root, band, falling depth) to turns with what the automaton says of the band:
    grp, root, band, last_band, n (turns in the band), turn (from 0 within the band), id, states."""

    def emit(key, turns) -> list[tuple]:
        turns = turns[::-1]
        states = run_automaton([role for _, role in turns])
        return [(*key, len(turns), n, i, states) for n, (i, _) in enumerate(turns)]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, turns = None, []
        for b in batches:
            out: list[tuple] = []
            cols = [b.column(k).to_pylist() for k in ("grp", "root", "band", "last_band", "id", "role", "is_turn")]
            for *key, i, role, is_turn in zip(*cols):
                if key != at:
                    out += emit(at, turns) if turns else []
                    at, turns = key, []
                if is_turn:
                    turns.append((i, role))
            if out:
                yield _batch(out, schema)
        if turns:
            yield _batch(emit(at, turns), schema)

    return step


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


TURNS = "grp string, root string, band long, last_band long, n long, turn long, id string, states array<int>"


def conversations(lines: DataFrame, *, band: int = BAND) -> DataFrame:
    """The turns of every whole conversation: source_uri, root_id, turn_no (from 0), id.

    A conversation is a tree of session entries; it is broken if it is circular or its root names a parent. Its main
    line runs from the root to the last message by timestamp (an unreadable or null one is earliest, equal ones by line
    number, then by id). Turns are the main line's messages of role user or assistant that have text. Kept are
    conversations whose turns begin with the user, end with the assistant and never have two user turns in a row; those
    without any turn are empty and dropped. Repeated rows count once; rows without an id are no entries.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    entries = session_entries(lines, with_digest=True)
    is_turn = (F.col("type") == "message") & F.col("role").isin(*ROLES) & F.col("digest").isNotNull()
    entries = entries.withColumn("is_turn", F.coalesce(is_turn, F.lit(False))).drop("digest")
    tree = hierarchy(
        entries,
        group_cols=["source_uri"],
        id_col="id",
        parent_col="parentId",
        position_col="line_number",
        keep=["line_number", "type", "role", "at", "is_turn"],
    )
    nodes = held(
        tree.where(F.col("depth") >= 0)
        .select(
            F.col("source_uri").alias("grp"),
            F.col("root_id").alias("root"),
            "id",
            F.col("parentId").alias("parent"),
            "depth",
            "line_number",
            "type",
            "role",
            "at",
            "is_turn",
        )
        .where(F.col("grp").isNotNull())
    )
    last = F.max(F.when(F.col("type") == "message", F.struct("at", "line_number", "id", "depth")))
    leaves = held(
        nodes.groupBy("grp", "root")
        .agg(last.alias("last"), F.max((F.col("depth") == 0) & blank_to_null(F.col("parent")).isNull()).alias("whole"))
        .where(F.col("whole") & F.col("last").isNotNull())
        .select("grp", "root", F.col("last.id").alias("leaf"), F.col("last.depth").alias("leaf_depth"))
    )
    lines_ = main_lines(nodes.select("grp", "root", "id", "parent", "depth", "role", "is_turn"), leaves, band)
    schema = to_arrow_schema(lines_.sparkSession.createDataFrame([], TURNS).schema)
    turns = lines_.select("grp", "root", "band", "last_band", "id", "role", "is_turn").mapInArrow(_read_turns(schema), TURNS)
    short = turns.where("last_band = 0").where(F.col("states")[START] == ACCEPTED)
    out = short.select(F.col("grp").alias("source_uri"), F.col("root").alias("root_id"), F.col("turn").alias("turn_no"), "id")
    if leaves.where(F.col("leaf_depth") >= band).limit(1).count():
        out = out.unionByName(_composed(held(turns.where("last_band > 0"))))
    return out


def _composed(turns: DataFrame) -> DataFrame:
    """Turns of long conversations: the functions of their bands composed in order, and the turns counted on."""
    key = ["grp", "root"]
    bands = turns.where("turn = 0").select(*key, "band", "n", "states")
    order = Window.partitionBy(*key).orderBy("band")
    bands = bands.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = (
        bands.groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("band", "states"))).alias("bands"))
        .where(F.aggregate("bands", F.lit(START), lambda s, b: b["states"][s]) == ACCEPTED)
    )
    kept = bands.join(whole, key, "left_semi").select(*key, "band", "before")
    return turns.join(kept, [*key, "band"]).select(
        F.col("grp").alias("source_uri"), F.col("root").alias("root_id"), (F.col("before") + F.col("turn")).alias("turn_no"), "id"
    )
