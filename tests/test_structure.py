"""Hierarchies, nested records and changed records on small cases."""

import json
import random

import brute
import pytest

from engram.operators.branches import active_chain
from engram.operators.changes import ChangeStore, changed_leaves, merkle_leaves, merkle_tree, unseen
from engram.operators.hierarchy import descendants, hierarchy, subtree_counts
from engram.operators.nested import _decode, _read_deep, inside, label_document, label_nodes, nearest_container, node_tables

EDGES = "g string, id string, up string, pos long, depth long, root_id string"


@pytest.mark.parametrize("paths", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_tiny_tasks(spark, paths, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(3):
        for i in range(50):
            up = rng.choice([None, "", f"n{rng.randrange(50)}", f"n{max(0, i - 1)}", f"n{max(0, i - 1)}", "missing"])
            rows.append((f"g{g}" if g else None, f"n{i}", up, i if rng.random() < 0.9 else None, 7, "clash"))
    df = spark.createDataFrame(rows, EDGES)
    out = hierarchy(df, group_cols=["g"], id_col="id", parent_col="up", position_col="pos", with_paths=paths, batch_rows=4, block_positions=4).collect()
    want = brute.forest({(r[0], r[1]): r[2] for r in rows})
    assert len(out) == len(rows)
    assert all((r.root_id, r.depth) == want[r.g, r.id] for r in out)
    if paths:
        assert all(r.path is None if r.depth < 0 else len(r.path) == r.depth + 1 and r.path[0] == r.root_id for r in out)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_subtree_counts(spark, partitions):
    rng = random.Random(9)
    rows = [(None if g else "g", f"n{i}", None if i < 3 else f"n{rng.randrange(max(0, i - 9), i)}", i) for g in range(2) for i in range(80)]
    df = spark.createDataFrame(rows, "g string, id string, up string, pos long")
    tree = hierarchy(df, group_cols=["g"], id_col="id", parent_col="up", with_paths=True, batch_rows=16)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {(r.g, r.id): r.n for r in subtree_counts(tree, ["g"], "id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want: dict = {}
    for r in descendants(tree, ["g"], "id").collect():
        want[r.g, r.ancestor] = want.get((r.g, r.ancestor), 0) + 1
    assert got == want and subtree_counts(tree.limit(0), ["g"], "id").count() == 0


def test_long_chain_over_many_tasks(spark):
    n = 300
    df = spark.createDataFrame([("a", str(i), str(i - 1) if i else None, i) for i in range(n)], "g string, id string, up string, pos long")
    out = {r.id: r for r in hierarchy(df, group_cols=["g"], id_col="id", parent_col="up", position_col="pos", batch_rows=16, block_positions=16).collect()}
    assert all(out[str(i)].depth == i and out[str(i)].root_id == "0" for i in range(n))


def test_circles_over_tasks(spark):
    n = 60
    df = spark.createDataFrame([("a", str(i), str((i - 1) % n), i) for i in range(n)] + [("a", "in", "5", 1), ("a", "self", "self", 2)], "g string, id string, up string, pos long")
    out = hierarchy(df, group_cols=["g"], id_col="id", parent_col="up", position_col="pos", batch_rows=8, block_positions=8).collect()
    assert len(out) == n + 2 and {(r.root_id, r.depth) for r in out} == {("", -1)}


def test_empty_and_null_nodes(spark):
    df = spark.createDataFrame([], "g string, id string, up string, pos long")
    assert hierarchy(df, group_cols=["g"], id_col="id", parent_col="up").count() == 0
    df = spark.createDataFrame([("a", None, "x", 1), (None, "x", None, None), (None, "y", "x", None)], "g string, id string, up string, pos long")
    tree = hierarchy(df, group_cols=["g"], id_col="id", parent_col="up", position_col="pos", with_paths=True)
    assert {(r.id, r.root_id, r.depth) for r in tree.collect()} == {("x", "x", 0), ("y", "x", 1)}
    assert [tuple(r) for r in descendants(tree, ["g"], "id").collect()] == [(None, "x", "y", 1)]


def _walk(rows):
    parents, last = {}, {}
    for uri, line, kind, i, up in sorted(rows, key=lambda r: r[1]):
        parents[uri, i] = up
        if kind == "message":
            last[uri] = i
    out = set()
    for uri, at in last.items():
        while (uri, at) in parents and (uri, at) not in out:
            out.add((uri, at))
            at = parents[uri, at]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_active_chain(spark, seed):
    rng = random.Random(seed)
    rows = []
    for f in range(6):
        for i in range(20):
            up = rng.choice([f"e{i - 1}"] * 4 + [f"e{rng.randrange(20)}", None, "gone"])
            rows.append((f"f{f}", i, rng.choice(["message", "message", "model_change"]), f"e{i}", up))
    df = spark.createDataFrame(rows, "source_uri string, line_number long, type string, id string, parentId string")
    assert {tuple(r) for r in active_chain(df).collect()} == _walk(rows)


def test_labels_nest(spark):
    value = {"a": [1, {"b": {}, "arguments": '{"c": [{"d": 1}]}'}, None], "e": "x"}
    nodes = label_document("content", value)
    paths = [n[0] for n in nodes]
    assert paths == ["content", "content.a", "content.a.0", "content.a.1", "content.a.1.b", "content.a.1.arguments", "content.a.1.arguments.c",
                     "content.a.1.arguments.c.0", "content.a.1.arguments.c.0.d", "content.a.2", "content.e"]
    for x in nodes:
        for y in nodes:
            assert (y[0].startswith(x[0] + ".")) == (x[2] < y[2] and y[3] < x[3])
    around = dict(zip(paths, nearest_container(nodes)))
    assert around["content"] == "" and around["content.a.1.b"] == "content.a.1" and around["content.a.1.arguments.c.0"] == "content.a.1.arguments"
    deep = json.loads("[" * 500 + "{}" + "]" * 500)
    assert len(label_document("usage", deep)) == 501


def test_records_deeper_than_the_decoder(spark):
    depth = 20_000
    text = "[" * depth + '{"a": [1, {}, "x\\n"], "b": {"c": null}}' + "]" * depth
    with pytest.raises(RecursionError):
        json.loads(text)
    nodes = label_document("content", _decode(text))
    assert len(nodes) == depth + 7 and sum(n[1] == "object" for n in nodes) == 3
    assert _decode(text[:-1]) is _decode(text + "]") is _decode("no json")
    assert len(label_document("usage", {"arguments": text})) == depth + 8
    df = spark.createDataFrame([("f", text, None)], "source_uri string, content string, usage string")
    assert label_nodes(df, ["source_uri"], objects_only=True).count() == 3


def test_deep_reader_reads_as_json_does():
    for text in ('{"a": [1, -2.5e3, true, null, NaN, "\\u00e9"], "b": {}, "a": [[], {}]}', " [ ] ", '"x"', "1", '[1,]', '{"a":1,}', '{"a" 1}', "[1 2]", "[1}", '{"a":1]', "", " ", "[", '{', '{"a":', "[1]x", "{1:2}", '["\n"]', "[,]", '{"a":,}'):
        try:
            want = repr(json.loads(text))
        except ValueError:
            with pytest.raises(ValueError):
                _read_deep(text)
        else:
            assert repr(_read_deep(text)) == want


def test_node_tables(spark):
    rows = [("k", '"hello"', None), ("k", '"  "', "{"), ("n", None, None), (None, '[{"type":"text","text":"\\ud800"}]', '{"a":{"b":null}}'), ("e", "", "3")]
    df = spark.createDataFrame(rows, "key string, content string, usage string")
    nodes = label_nodes(df, ["key"])
    found = {(r.key, r.node_path, r.parent_path, r.kind) for r in nodes.collect()}
    assert ("k", "content.0", "content", "object") not in found and ("k", "content.0", "", "object") in found
    assert (None, "usage.a", "usage", "object") in found and ("e", "usage", "", "scalar") in found
    tables = node_tables(nodes, ["key"], {"text": {"text": "text string", "n": "n long"}, "usage": {}, "a": {}, "none": {}})
    assert {k: t.count() for k, t in tables.items()} == {"text": 2, "usage": 1, "a": 1, "none": 0}
    assert {(r.key, r.node_path, r.text, r.n) for r in tables["text"].collect()} == {("k", "content.0", "hello", None), (None, "content.0", "?", None)}


def test_tables_are_linked_by_containment(spark):
    call = {"type": "toolCall", "name": "f", "arguments": '{"a": {"type": "toolCall", "arguments": {"x": 1}}, "b": [{"arguments": {}}]}'}
    rows = [("k", json.dumps([call, {"type": "text", "text": "t"}, {"arguments": {}}]), json.dumps({"totalTokens": "7", "cost": {"total": 1}}))]
    nodes = label_nodes(spark.createDataFrame(rows, "key string, content string, usage string"), ["key"])
    tables = node_tables(nodes, ["key"], {"toolCall": {}, "arguments": {}, "usage": {"total": "totalTokens long"}})
    found = {(r.node_path, r.around) for r in inside(tables["arguments"], tables["toolCall"], ["key"]).collect()}
    first = "content.0.arguments"
    assert found == {(first, "content.0"), (f"{first}.a.arguments", f"{first}.a"), (f"{first}.b.0.arguments", "content.0")} and tables["usage"].collect()[0].total == 7
    assert tables["arguments"].count() == 4
    wide = spark.createDataFrame([("k", json.dumps([{"i": i} for i in range(120_000)]), None)], "key string, content string, usage string")
    assert label_nodes(wide, ["key"], objects_only=True).count() == 120_000


def test_empty_records(spark):
    df = spark.createDataFrame([], "key string, content string, usage string")
    assert label_nodes(df.limit(0), ["key"]).count() == 0


def test_merkle(spark):
    a = spark.createDataFrame([(f"k{i}", i) for i in range(200)] + [(None, None)], "k string, v long")
    same = a.repartition(7)
    b = spark.createDataFrame([(f"k{i}", i + (i == 5)) for i in range(199)], "k string, v long")
    leaves = [merkle_leaves(x, ["k"], ["v"]) for x in (a, same, b)]
    assert changed_leaves(leaves[0], leaves[1]).count() == 0
    assert changed_leaves(leaves[0], leaves[2]).count() == 3
    root = [merkle_tree(x).where("level = 0").collect()[0] for x in leaves[:2]]
    assert root[0] == root[1] and root[0].n == 201
    assert {r.k for r in unseen(a, b, ["k"], "v").collect()} == {None, "k5", "k199"}
    assert unseen(a, a.limit(0), ["k"], "v").count() == 201 and unseen(a.limit(0), a, ["k"], "v").count() == 0
    two = b.unionByName(spark.createDataFrame([("k7", 70)], b.schema))
    assert "k7" not in {r.k for r in unseen(a, two, ["k"], "v").collect()} and "k7" in {r.k for r in unseen(a, two, ["k"], "v", every=True).collect()}


def test_change_store_survives_failures(spark, tmp_path):
    store = ChangeStore(spark, str(tmp_path / "s"))
    first = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "k string, v long")
    assert store.run(first, ["k"], "v", lambda d: d).count() == 3
    second = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), (None, 1)], "k string, v long")
    before = store.version

    def fails(d):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.run(second, ["k"], "v", fails)
    assert store.version == before
    assert {tuple(r) for r in store.run(second, ["k"], "v", lambda d: d).collect()} == {("b", 2), ("c", 1)}
    assert store.run(second, ["k"], "v", lambda d: d).count() == 0


def test_a_small_change_reads_and_writes_few_ranges(spark, tmp_path):
    """Changes in one source touch its range of the tree only; all other files stay as they are and are not read."""
    store = ChangeStore(spark, str(tmp_path / "s"))
    rows = [(f"file{i % 97}", f"e{i}", "v1") for i in range(3000)]
    df = lambda r: spark.createDataFrame(r, "source_uri string, entry_id string, version string")
    keys = ["source_uri", "entry_id"]
    assert store.run(df(rows), keys, "version", lambda d: d).count() == 3000
    first = store.state
    changed = [(u, e, "v2" if e == "e5" else v) for u, e, v in rows if e != "e102"] + [("file5", "new", "v1")]  # all in file5
    assert {tuple(r) for r in store.run(df(changed), keys, "version", lambda d: d).collect()} == {("file5", "e5", "v2"), ("file5", "new", "v1")}
    second = store.state
    assert len({r for r in second["ranges"] if second["ranges"][r] != first["ranges"].get(r)}) == 1
    seen = []
    inner = store._ranges
    store._ranges = lambda state, part, ranges: seen.append((part, list(ranges))) or inner(state, part, ranges)
    more = changed + [("file9", "late", None)]
    assert [tuple(r) for r in store.run(df(more), keys, "version", lambda d: d).collect()] == [("file9", "late", None)]
    assert seen and all(len(ranges) == 1 for _, ranges in seen)
    assert store.run(df(more), keys, "version", lambda d: d).count() == 0
    with pytest.raises(ZeroDivisionError):
        store.run(df(rows), keys, "version", lambda d: 1 / 0)
    assert store.version == 4 and store.read("handled").count() == 3001 and store.run(df(more[:10]), keys, "version", lambda d: d).count() == 0


@pytest.mark.parametrize("levels", [3, 4, 6])
def test_levels_give_the_same_result(spark, levels):
    a = spark.createDataFrame([(f"k{i}", i % 5) for i in range(400)], "k string, v int")
    b = spark.createDataFrame([(f"k{i}", i % 5 + (i % 50 == 0)) for i in range(10, 400)], "k string, v int")
    assert {r.k for r in unseen(a, b, ["k"], "v", levels=levels).collect()} == {f"k{i}" for i in range(400) if i < 10 or i % 50 == 0}
