"""Deeply nested records to flat, linked tables.

Method: every node of a record gets an interval (pre-order and post-order number) in one depth-first pass. A node lies
inside another exactly where its interval does, so node tables of any two types can be linked by containment without
having been built together. ``label_nodes`` emits the labelled nodes with their type, ``node_tables`` makes a flat table for
each type from them, ``inside`` links the rows of one table to those around them in another.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions.text import JS_SPACE

#: Keys whose string value is JSON itself and counts as the value in it.
ENCODED_KEYS = frozenset({"arguments"})
_MISSING = object()
_SPACE = re.compile(r"[ \t\n\r]*")
_SCAN = json.JSONDecoder().scan_once


def _decode(text):
    try:
        return json.loads(text)
    except ValueError:
        return _MISSING
    except RecursionError:  # too deep for the decoder of Python
        try:
            return _read_deep(text)
        except ValueError:
            return _MISSING


def _read_deep(text: str):
    """``json.loads`` for any depth: keeps its own stack of open objects and arrays, reads scalars with Python's scanner."""
    skip = lambda i: _SPACE.match(text, i).end()
    root: list = []
    around = [root]
    key = None

    def read_key(i: int) -> int:
        nonlocal key
        if text[i : i + 1] != '"':
            raise ValueError("no key")
        key, i = _SCAN(text, i)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("no colon")
        return skip(i + 1)

    at = skip(0)
    while True:
        mark = text[at : at + 1]
        if mark and mark in "{[":
            value, end = ({}, "}") if mark == "{" else ([], "]")
            at = skip(at + 1)
        else:
            try:
                value, at = _SCAN(text, at)
            except StopIteration:
                raise ValueError("no value") from None
            end = None
        if type(around[-1]) is dict:
            around[-1][key] = value
        else:
            around[-1].append(value)
        if end and text[at : at + 1] == end:
            at += 1
        elif end:
            around.append(value)
            if end == "}":
                at = read_key(at)
            continue
        while True:  # behind a value
            at = skip(at)
            if len(around) == 1:
                if at != len(text):
                    raise ValueError("more than one value")
                return root[0]
            is_object = type(around[-1]) is dict
            mark = text[at : at + 1]
            if mark == ",":
                at = skip(at + 1)
                if is_object:
                    at = read_key(at)
                break
            if mark != ("}" if is_object else "]"):
                raise ValueError("not closed")
            around.pop()
            at += 1


def label_document(root: str, value, encoded: frozenset = ENCODED_KEYS):
    """Depth-first labels of one JSON value: (path, kind, pre, post, name, scalar) with kind object, array or scalar.

    A node's interval [pre, post] holds those of all nodes inside it. The traversal keeps its own stack, so depth is
    bounded by memory only.
    """
    out: list[list] = []
    stack = [(root, root, value)]
    clock = 0
    while stack:
        path, name, v = stack.pop()
        if name is None:  # leaving: path is the index of the node
            out[path][3] = clock
            clock += 1
            continue
        if name in encoded and type(v) is str:
            inner = _decode(v)
            if inner is not _MISSING:
                v = inner
        kind = "object" if type(v) is dict else "array" if type(v) is list else "scalar"
        out.append([path, kind, clock, clock, name, v])
        clock += 1
        if kind == "scalar":
            out[-1][3] = clock
            clock += 1
            continue
        stack.append((len(out) - 1, None, None))
        inside = v.items() if kind == "object" else enumerate(v)
        stack.extend([(f"{path}.{k}", f"{k}", x) for k, x in inside][::-1])
    return out


def nearest_container(nodes: list, kind: str = "object") -> list[str]:
    """For nodes of one record in pre-order: the path of the nearest node of ``kind`` whose interval contains theirs,
    '' if none."""
    around: list = []
    found = []
    for node in nodes:
        while around and around[-1][3] < node[3]:
            around.pop()
        found.append(around[-1][0] if around else "")
        if node[1] == kind:
            around.append(node)
    return found


def _record_nodes(content: str | None, usage: str | None):
    for root, text in (("content", content), ("usage", usage)):
        if text is None:
            continue
        value = _decode(text)
        if value is _MISSING:
            continue
        if root == "content" and type(value) is str:
            if value.strip(JS_SPACE):  # a string content is one text block
                value = [{"type": "text", "text": value}]
            else:
                continue
        yield label_document(root, value)


#: Rows in one batch of output.
OUT_ROWS = 50_000


def _node_type(node: list, value) -> str:
    """What kind of thing an object is: what its field ``type`` says, else the last name in its path that is no position."""
    said = value.get("type")
    if type(said) is str and said:
        return said
    return next((part for part in reversed(node[0].split(".")) if not part.isdigit()), node[4])


def _shown(v) -> str | None:
    return v if v is None or type(v) is str else json.dumps(v)


def _node_row(node: list, parent: str) -> tuple:
    path, kind, pre, post, name, v = node
    if kind != "object":
        return path, parent, kind, pre, post, name, None, None if kind == "array" else _shown(v), None
    flat = [(k, _shown(x)) for k, x in v.items() if type(x) is not dict and type(x) is not list]
    return path, parent, kind, pre, post, name, _node_type(node, v), None, [(_text(k), _text(x)) for k, x in flat]


def _node_arrays(batches: Iterator[pa.RecordBatch], objects_only: bool, keys: list[str], schema: pa.Schema):
    for batch in batches:
        rows: list[int] = []
        cols: list[list] = [[] for _ in range(len(schema) - len(keys))]

        def flush() -> pa.RecordBatch:
            taken = pa.array(rows, pa.int32())
            arrays = [batch.column(k).take(taken) for k in keys]
            arrays += [pa.array([_text(v) for v in c], schema.field(len(keys) + j).type) for j, c in enumerate(cols)]
            rows.clear()
            for c in cols:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for i, (c, u) in enumerate(zip(batch.column("content").to_pylist(), batch.column("usage").to_pylist())):
            for nodes in _record_nodes(c, u):
                for node, parent in zip(nodes, nearest_container(nodes)):
                    if objects_only and node[1] != "object":
                        continue
                    for out, x in zip(cols, (node[0], parent, node[2], node[3]) if objects_only else _node_row(node, parent)):
                        out.append(x)
                    rows.append(i)
                if len(rows) >= OUT_ROWS:
                    yield flush()
        yield flush()


def _text(v):
    """Lone surrogates, which no UTF-8 string can hold, become question marks."""
    return v.encode("utf-8", "replace").decode() if type(v) is str and not v.isascii() else v


def label_nodes(records: DataFrame, keys: list[str], *, objects_only: bool = False) -> DataFrame:
    """One row per node of each record's ``content`` and ``usage`` (JSON text).

    Columns: keys, node_path, parent_path (nearest object around, '' if none), pre and post (interval labels within the record
    and root) and, unless ``objects_only``, kind (object, array, scalar), name, value (scalars as text, null for JSON null)
    and for objects node_type (their field ``type``, else the name they go by) and fields (their scalars by name).
    Null, invalid or blank JSON gives no rows; a non-blank string content is one text block ``content.0``. Of repeated
    keys in an object the last counts. Repeated rows of the input give repeated rows here.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType

    text, number = StringType(), IntegerType()
    path, interval = [("node_path", text), ("parent_path", text)], [("pre", number), ("post", number)]
    more = [("kind", text), *interval, ("name", text), ("node_type", text), ("value", text), ("fields", MapType(text, text))]
    fields = [StructField(n, t) for n, t in path + (interval if objects_only else more)]
    source = records.select(*keys, "content", "usage")
    schema = StructType([source.schema[k] for k in keys] + fields)
    arrow = to_arrow_schema(schema)
    return source.mapInArrow(lambda it: _node_arrays(it, objects_only, keys, arrow), schema)


def node_tables(nodes: DataFrame, keys: list[str], types: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    """A flat table for each type of object: keys, root, node_path, parent_path, pre, post and the columns asked for.

    types: node_type to {column: "field type"}, for example {"usage": {"total_tokens": "totalTokens long"}}. A field that is
    absent, no scalar or of another type is null. nodes: all of ``label_nodes``, best kept (``session.cut``), as every table reads it.
    """
    out = {}
    for name, columns in types.items():
        shown = [F.expr(f"try_cast(fields['{field}'] as {kind})").alias(column) for column, (field, kind) in ((c, f.split(" ", 1)) for c, f in columns.items())]
        rows = nodes.where((F.col("kind") == "object") & (F.col("node_type") == name))
        out[name] = rows.select(*keys, F.substring_index("node_path", ".", 1).alias("root"), "node_path", "parent_path", "pre", "post", *shown)
    return out


def inside(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one node table with the nearest row of another around them, by containment of intervals: the columns of
    ``inner`` and ``around``, the node_path there. Rows that lie in none are left out; null keys match nothing."""
    on = [*keys, "root"]
    b = outer.select(*on, F.col("node_path").alias("around"), F.col("pre").alias("_pre"), F.col("post").alias("_post"))
    held_in = inner.join(b, on).where((F.col("_pre") < F.col("pre")) & (F.col("post") < F.col("_post")))
    return held_in.groupBy(*inner.columns).agg(F.max_by("around", "_pre").alias("around"))
