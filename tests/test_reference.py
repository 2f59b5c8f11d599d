"""Behaviour of the engine's own operators: store, recall, forget, index, search, context, fusion."""

import io
import json
import math
import os
import urllib.error

import pytest
from pyspark.sql.types import StringType, StructField, StructType

from engram.client import Client, to_json_rows
from engram.embed import HashingEmbedder, HttpEmbedder, KeywordEmbedder, LocalEmbedder, create_embedder, with_embeddings
from engram.errors import ConfigError, EmbedderError, EngramError, InvalidArgumentError
from engram.index import SessionIndex, index_records, recall_tool
from engram.operators.context import context, tsv, visible_messages
from engram.operators.fusion import first_payload, rrf
from engram.operators.sessions import parse_messages
from engram.sources.config import init, load_config, private_dir, store_path
from engram.sources.jsonl import parse_lines, read_sessions, split_lines
from engram.sources.store import CHUNK_SCHEMA, SnapshotTable
from engram.streaming.indexer import EVENT_SCHEMA, start
from engram.validate import METADATA_LIMIT_BYTES, TEXT_LIMIT_BYTES, check_dim, metadata_json, normalize_chunk


class Fixed:
    """Vectors by text: [a, b, 0, ...]."""

    dim = 64

    def __init__(self, **of):
        self.of, self.asked = of, []

    def embed_batch(self, texts):
        self.asked += texts
        return [[*self.of.get(t, (9.0, 9.0)), *[0.0] * 62] for t in texts]

    def embed(self, text):
        return self.embed_batch([text])[0]


@pytest.fixture
def client(spark, tmp_path):
    return Client(spark, str(tmp_path / "chunks"), Fixed(exact=(1.0, 0.0), near=(0.5, 0.0), far=(0.0, 1.0), q=(1.0, 0.0)))


def test_recall_order_score_and_isolation(client):
    client.store([{"text": "far", "chunkId": "far"}, {"text": " exact ", "chunkId": "exact"}, {"text": "near", "chunkId": "near"}], project_id="p")
    client.store([{"text": "exact", "chunkId": "other"}], project_id="p2")
    rows = client.recall(" q ", project_id="p").collect()
    assert [r.chunk_id for r in rows] == ["exact", "near", "far"] and rows[0].score == 1.0 and rows[0].text == "exact"
    assert math.isclose(rows[1].score, 1 / 1.5)
    assert [r.chunk_id for r in client.recall("q", project_id="p", limit=2).collect()] == ["exact", "near"]
    assert client.status("p") == 3 and client.recall("q", project_id="none").count() == 0


def test_default_limit_is_ten(client):
    client.store([{"text": f"t{i}"} for i in range(12)], project_id="p")
    assert client.recall("q", project_id="p").count() == 10


def test_upsert_keeps_created_at_and_last_wins(client):
    client.store([{"text": "far", "chunkId": "a", "metadata": {"b": 1, "a": [None, True]}}], project_id="p")
    before = client.store_.table.read().collect()[0]
    out = client.store([{"text": "near", "chunkId": "a"}, {"text": "exact", "chunkId": "a"}], project_id="p").collect()
    assert [r.text for r in out] == ["near", "exact"]
    after = client.store_.table.read().collect()
    assert len(after) == 1 and after[0].text == "exact" and after[0].created_at == before.created_at and after[0].metadata_json is None
    assert before.metadata_json == '{"b":1,"a":[null,true]}'


def test_forget_counts_once(client):
    client.store([{"text": "far", "chunkId": "a"}, {"text": "near", "chunkId": "b"}], project_id="p")
    assert client.forget(["a", "a", "zzz"], project_id="p") == 1
    assert client.forget(["b"], project_id="other") == 0 and client.status("p") == 1
    for bad in ([], ["a", ""], "a", [1]):
        with pytest.raises(InvalidArgumentError):
            client.forget(bad, project_id="p")


def test_ids_with_nul_do_not_collide(client):
    client.store([{"text": "far", "chunkId": "b\0c"}], project_id="a")
    client.store([{"text": "near", "chunkId": "c"}], project_id="a\0b")
    assert client.status("a") == 1 and client.status("a\0b") == 1


def test_bad_batches_change_nothing_and_are_not_embedded(client):
    client.store([{"text": "far", "chunkId": "a"}], project_id="p")
    asked = len(client.embedder.asked)
    for bad in ([{"text": "ok"}, {"text": "  "}], [], "x", [{"text": 3}], [{"text": "x", "chunkId": ""}], [{"text": "x", "parentId": None}], [{"text": "x", "lineNumber": 1.5}]):
        with pytest.raises(InvalidArgumentError):
            client.store(bad, project_id="p")
    assert len(client.embedder.asked) == asked and client.status("p") == 1
    client.embedder.embed_batch = lambda texts: [[0.0] * 64]
    with pytest.raises(InvalidArgumentError, match="1 embeddings for 2"):
        client.store([{"text": "x"}, {"text": "y"}], project_id="p")
    client.embedder.embed_batch = lambda texts: [[math.nan] + [0.0] * 63]
    with pytest.raises(EmbedderError):
        client.store([{"text": "x"}], project_id="p")
    assert client.status("p") == 1


def test_store_dataframe_with_extra_columns(spark, tmp_path):
    client = Client(spark, str(tmp_path / "chunks"), HashingEmbedder(64))
    df = spark.createDataFrame([("far", "a", 1.0), ("near", "b", 2.0)], "text string, chunk_id string, score double")
    assert client.store(df, project_id="p").count() == 2 and client.status("p") == 2
    with pytest.raises(InvalidArgumentError):
        client.store(spark.createDataFrame([(None, "a")], "text string, chunk_id string"), project_id="p")
    assert client.status("p") == 2


def test_recall_arguments(client):
    for query, project, limit in (("", "p", 1), ("q", " ", 1), ("q", "p", 0), ("q", "p", 1001), ("q", "p", 1.5), (3, "p", 1)):
        with pytest.raises(InvalidArgumentError):
            client.recall(query, project_id=project, limit=limit)
    client.close()
    with pytest.raises(EngramError):
        client.recall("q", project_id="p")


def test_byte_limits():
    assert normalize_chunk({"text": "x" * TEXT_LIMIT_BYTES}, "p")["text"]
    assert normalize_chunk({"text": "é" * (TEXT_LIMIT_BYTES // 2)}, "p")["text"]
    for text in ("x" * (TEXT_LIMIT_BYTES + 1), "é" * (TEXT_LIMIT_BYTES // 2) + "x"):
        with pytest.raises(InvalidArgumentError):
            normalize_chunk({"text": text}, "p")
    assert len(metadata_json({"a": "x" * (METADATA_LIMIT_BYTES - 8)})) == METADATA_LIMIT_BYTES
    with pytest.raises(InvalidArgumentError):
        metadata_json({"a": "x" * (METADATA_LIMIT_BYTES - 7)})


def test_metadata_rules():
    cyclic = {}
    cyclic["a"] = [cyclic]
    for bad, message in (({"a": float("inf")}, "a must be a finite"), ({"a": {"b": {1}}}, "a.b must be JSON"), ({"a": [object()]}, r"a\[0\] must be JSON"), (cyclic, "cyclic"), ([], "object"), (None, "object")):
        with pytest.raises(InvalidArgumentError, match=message):
            metadata_json(bad)

    class Hook:
        def to_json(self):
            return {"z": 1}

    assert metadata_json({"a": Hook(), "b": True}) == '{"a":{"z":1},"b":true}'
    assert normalize_chunk({"text": "﻿ x ", "chunkId": "c"}, " p ")["text"] == "x" and normalize_chunk({"text": "x"}, " p ")["project_id"] == " p "
    assert len(normalize_chunk({"text": "x"}, "p")["chunk_id"]) == 36
    for bad in (63, 4097, 64.5, "64", True):
        with pytest.raises(InvalidArgumentError):
            check_dim(bad)


def test_store_schema_rules(spark, tmp_path):
    path = str(tmp_path / "t")
    table = SnapshotTable(spark, path, CHUNK_SCHEMA, 64)
    row = spark.createDataFrame([("p", "c", "t", *[None] * 9, "x", "y", [0.0] * 64)], CHUNK_SCHEMA)
    table.replace(lambda cur: row)
    assert SnapshotTable(spark, path, CHUNK_SCHEMA, 64).read().count() == 1
    with pytest.raises(InvalidArgumentError, match="dim=65"):
        SnapshotTable(spark, path, CHUNK_SCHEMA, 65)
    with pytest.raises(InvalidArgumentError, match="missing columns: more"):
        SnapshotTable(spark, path, StructType([*CHUNK_SCHEMA.fields, StructField("more", StringType())]), 64)
    version = table.manifest
    with pytest.raises(ZeroDivisionError):
        table.replace(lambda cur: 1 / 0)
    assert table.manifest == version
    assert table.clean() == 0
    table.replace(lambda cur: cur.limit(0))
    assert table.read().count() == 0 and table.clean() == 1
    with open(os.path.join(path, "_log", f"{table.entry:012d}.json"), "w") as f:
        f.write("{")
    with pytest.raises(EngramError, match="integrity"):
        SnapshotTable(spark, path, CHUNK_SCHEMA, 64)
    with pytest.raises(EngramError, match="unavailable"):
        SnapshotTable(spark, str(tmp_path / "none"), CHUNK_SCHEMA, 64, create=False)
    assert not os.path.exists(tmp_path / "none")


def _chunk_rows(spark, *ids, text="t", at="x"):
    return spark.createDataFrame([("p", i, text, *[None] * 9, at, at, [0.0] * 64) for i in ids], CHUNK_SCHEMA)


def test_overlapping_writers(spark, tmp_path):
    """The second of two writers that started from the same version fails; nothing of the first is lost."""
    path = str(tmp_path / "t")
    a, b = (SnapshotTable(spark, path, CHUNK_SCHEMA, 64) for _ in range(2))
    a.append(_chunk_rows(spark, "zero"))

    def meanwhile(now):
        a.append(_chunk_rows(spark, "a"))
        return now.unionByName(_chunk_rows(spark, "b"))

    with pytest.raises(EngramError, match="another writer"):
        b.replace(meanwhile)
    assert {r.chunk_id for r in b.read().collect()} == {"zero", "a"} and b.clean() == 0
    b.append(_chunk_rows(spark, "b"))
    assert {r.chunk_id for r in a.read().collect()} == {"zero", "a", "b"}


def test_changes_only_add_files(spark, tmp_path):
    path = str(tmp_path / "t")
    table = SnapshotTable(spark, path, CHUNK_SCHEMA, 64)
    state = lambda: {(r.chunk_id, r.text) for r in table.read().collect()}
    table.append(_chunk_rows(spark, "a", "b", "c"))
    files = {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs}
    table.upsert(_chunk_rows(spark, "b", "d", text="new"))
    table.delete(_chunk_rows(spark, "a", "none").select("project_id", "chunk_id"))
    assert files <= {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs}
    assert state() == {("b", "new"), ("c", "t"), ("d", "new")}
    table.append(_chunk_rows(spark, "a", text="back"))
    want = {("a", "back"), ("b", "new"), ("c", "t"), ("d", "new")}
    assert state() == want and table.read("p").count() == 4 and table.read("q").count() == 0
    table.compact()
    assert state() == want and len(table.manifest["parts"]) == 1 and table.clean() == 4
    for part in table.manifest["parts"]:
        os.rename(os.path.join(path, part["at"]), os.path.join(path, "moved"))
    with pytest.raises(EngramError, match="files are missing"):
        SnapshotTable(spark, path, CHUNK_SCHEMA, 64)


SESSION = [
    {"type": "session", "id": "s", "cwd": "/w", "timestamp": "t0"},
    {"type": "message", "id": "u1", "timestamp": "t1", "message": {"role": "user", "content": " sapphire? "}},
    {"type": "message", "id": "a1", "parentId": "u1", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "x"}, {"type": "text", "text": "amber"}, {"type": "text", "text": " "}, {"type": "text", "text": "two"}, {"type": "toolCall", "id": "c", "arguments": {}}]}},
    {"type": "message", "id": "r1", "parentId": "a1", "message": {"role": "toolResult", "content": [{"type": "text", "text": "noise"}]}},
    {"type": "message", "id": "u2", "parentId": "r1", "message": {"role": "user", "content": [{"type": "text", "text": "cedar"}, {"type": "image", "data": "x"}]}},
    {"type": "message", "id": "a2", "parentId": "u2", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "only"}]}},
    {"type": "message", "message": {"role": "user", "content": "no id"}},
    {"type": "message", "id": 42, "message": {"role": "user", "content": "number"}},
    {"type": "custom_message", "id": "c1", "content": "hidden"},
]


def write(path, rows, end="\n"):
    path.write_text(end.join(r if isinstance(r, str) else json.dumps(r) for r in rows) + end)
    return str(path)


def test_session_parse(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", [SESSION[0], "", *SESSION[1:]], "\r\n")
    rows = sorted(parse_messages(read_sessions(spark, path)).collect(), key=lambda r: r.line_number)
    assert [(r.line_number, r.entry_id, r.text, r.cwd) for r in rows] == [(3, "u1", "sapphire?", "/w"), (4, "a1", "amber\ntwo", "/w"), (6, "u2", "cedar", "/w")]
    assert rows[0].parent_id is None and rows[0].timestamp == "t1" and rows[1].parent_id == "u1"
    bad = write(tmp_path / "b.jsonl", [SESSION[1], "{broken"])
    assert read_sessions(spark, bad).count() == 1
    with pytest.raises(Exception, match="Malformed session line 2"):
        read_sessions(spark, bad, strict=True).collect()
    assert parse_messages(read_sessions(spark, path), spark.createDataFrame([], "source_uri string, entry_id string")).count() == 0
    texts = spark.createDataFrame([("u", None), ("v", ""), ("w", "\n\n{}\n3\n[]")], "u string, t string")
    assert [(r.source_uri, r.line_number) for r in parse_lines(split_lines(texts, "u", "t")).collect()] == [("w", 3)]


def test_index_twice_reconcile_and_search(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", SESSION)
    index = SessionIndex(spark, str(tmp_path / "index"), KeywordEmbedder(["sapphire", "amber", "cedar"]))
    assert index.search("x")[1] == "Nothing is indexed yet."
    first = index.index_file(path)
    assert first.ok and (first.indexed, first.skipped_duplicate) == (3, 0), first.error
    again = index.index_file(path)
    assert (again.indexed, again.skipped_duplicate) == (0, 3)
    uri = index.table.read().collect()[0].source_uri
    hits, message = index.search(" sapphire ", limit=2)
    assert message is None and [(r.rank, r.snippet) for r in hits.collect()] == [(1, "sapphire?"), (2, "amber\ntwo")]
    hits, _ = index.search("sapphire", entry_id="u2", source_uri=uri, timestamp_to=None)
    assert [r.sourcePointer.entryId for r in hits.collect()] == ["u2"]
    assert index.search("x", cwd="/none") == (None, "No indexed message passes these filters.")
    for bad in ({"query": " "}, {"query": "x", "limit": 21}, {"query": "x", "line_number": 0}):
        with pytest.raises(InvalidArgumentError):
            index.search(**bad)
    tool = recall_tool(lambda: index)
    answer = tool({"query": "cedar", "limit": 1.0, "lineNumber": 5})
    assert answer["results"][0]["sourcePointer"]["parentId"] == "r1" and "timestamp" not in answer["results"][0]["sourcePointer"]
    for bad in ([], {}, {"query": "x", "cwd": 3}, {"query": "x", "limit": "3"}):
        with pytest.raises(InvalidArgumentError):
            tool(bad)
    index.reconcile(spark.createDataFrame([(uri, "u1")], "source_uri string, entry_id string"))
    assert [r.entry_id for r in index.table.read().collect()] == ["u1"]
    index.reconcile(spark.createDataFrame([], "source_uri string, entry_id string"))
    assert index.table.read().count() == 1
    assert index.index_file(None).ok and index.index_file(str(tmp_path / "no"), at_startup=True).ok
    assert not index.index_file(str(tmp_path / "no")).ok


def test_fork_keeps_active_branch(spark, tmp_path):
    say = lambda i, up: {"type": "message", "id": i, "parentId": up, "message": {"role": "user", "content": i}}
    path = write(tmp_path / "f.jsonl", [say("root", None), say("orphan", "root"), say("active", "root")])
    index = SessionIndex(spark, str(tmp_path / "index"), HashingEmbedder(8))
    empty = spark.createDataFrame([], "source_uri string, entry_id string")
    assert index.index_file(path, empty).indexed == 2
    assert {r.entry_id for r in index.table.read().collect()} == {"root", "active"}


def test_too_broad_filter(spark, tmp_path):
    index = SessionIndex(spark, str(tmp_path / "index"), HashingEmbedder(8))
    rows = spark.range(5001).selectExpr("'f' as source_uri", "string(id) as entry_id", "string(null) as parent_id", "id as line_number", "'t' as timestamp", "'/w' as cwd", "'user' as role", "'x' as text")
    added = with_embeddings(index_records(rows), index.embedder, "snippet")
    index.table.replace(lambda cur: cur.unionByName(added))
    assert index.search("x", cwd="/w") == (None, "These filters pass 5001 rows, of which at most 5000 are searched; narrow them.")


def test_stream_of_events(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", SESSION)
    (tmp_path / "events").mkdir()
    index, reports = SessionIndex(spark, str(tmp_path / "index"), HashingEmbedder(8)), []

    def tell(name, *rows):
        (tmp_path / "events" / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        events = spark.readStream.schema(EVENT_SCHEMA).json(str(tmp_path / "events"))
        start(events, index, str(tmp_path / "cp"), report=reports.append).awaitTermination()

    tell("1.json", {"event": "session_start", "session_file": path}, {"event": "session_shutdown", "session_file": path})
    assert (reports[-1].ok, reports[-1].indexed) == (True, 3), reports
    write(tmp_path / "a.jsonl", [*SESSION, {"type": "message", "id": "u3", "parentId": "a2", "message": {"role": "user", "content": "more"}}])
    tell("2.json", {"event": "agent_end", "session_file": path})
    assert (reports[-1].indexed, index.table.read().count()) == (1, 4)
    tell("3.json", {"event": "agent_end", "session_file": str(tmp_path / "gone.jsonl")})
    assert not reports[-1].ok


def test_one_bad_file_fails_alone(spark, tmp_path):
    """A missing and a malformed file beside good ones: one report each, the good ones are indexed."""
    say = lambda i, up: {"type": "message", "id": i, "parentId": up, "message": {"role": "user", "content": i}}
    good, fork = write(tmp_path / "good.jsonl", SESSION), [say("root", None), say("orphan", "root"), say("active", "root")]
    bad = write(tmp_path / "bad.jsonl", [SESSION[1], "{broken"])
    given, free, derived = (write(tmp_path / f"{n}.jsonl", fork) for n in ("given", "free", "derived"))
    index, reports, closed = SessionIndex(spark, str(tmp_path / "index"), HashingEmbedder(8)), [], []
    (tmp_path / "events").mkdir()
    rows = [
        {"event": "agent_end", "session_file": good}, {"event": "agent_end", "session_file": str(tmp_path / "gone.jsonl")}, {"event": "agent_end", "session_file": bad},
        {"event": "session_start", "session_file": str(tmp_path / "later.jsonl"), "reason": "startup"}, {"event": "session_start", "session_file": str(tmp_path / "lost.jsonl"), "reason": "resume"},
        {"event": "agent_end", "session_file": given, "active_ids": ["root", "orphan"]}, {"event": "agent_end", "session_file": free, "no_branch": True},
        {"event": "agent_end", "session_file": derived, "active_ids": []}, {"event": "session_shutdown"},
    ]
    (tmp_path / "events" / "1.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    events = spark.readStream.schema(EVENT_SCHEMA).json(str(tmp_path / "events"))
    start(events, index, str(tmp_path / "cp"), report=reports.append, on_shutdown=lambda: closed.append(1)).awaitTermination()
    got = {os.path.basename(r.session_file): (r.ok, r.indexed) for r in reports}
    assert got == {"good.jsonl": (True, 3), "gone.jsonl": (False, 0), "bad.jsonl": (False, 0), "later.jsonl": (True, 0), "lost.jsonl": (False, 0), "given.jsonl": (True, 2), "free.jsonl": (True, 3), "derived.jsonl": (True, 2)}, reports
    assert "Malformed session line 2" in next(r.error for r in reports if r.session_file == bad) and closed == [1]
    kept = {os.path.basename(r.source_uri): set() for r in index.table.read().collect()}
    for r in index.table.read().collect():
        kept[os.path.basename(r.source_uri)].add(r.entry_id)
    assert kept["given.jsonl"] == {"root", "orphan"} and kept["free.jsonl"] == {"root", "orphan", "active"} and kept["derived.jsonl"] == {"root", "active"}
    assert not index.index_file(bad).ok and "Malformed session line 2" in index.index_file(bad).error
    assert {r.source_kind for r in index.table.read().collect()} == {"pi-jsonl"}


def test_store_dataframe_without_ids(spark, tmp_path):
    with Client(spark, str(tmp_path / "c"), HashingEmbedder(64)) as client:
        df = spark.createDataFrame([("a", None), ("b", "{}")], "text string, metadata_json string")
        rows = client.store(df, project_id="p").collect()
        assert len({r.chunk_id for r in rows}) == 2 and client.status("p") == 2
        for text, meta in (("a", "[1]"), ("a", "{"), (" ", None), (None, None)):
            client.embedder.embed_batch = None  # checked before anything is embedded
            with pytest.raises(InvalidArgumentError):
                client.store(spark.createDataFrame([(text, meta)], df.schema), project_id="p")
        assert client.status("p") == 2


def test_embedders_from_configuration(tmp_path, monkeypatch):
    local = create_embedder({"engine": "local", "model": str(tmp_path), "dim": 64})
    with pytest.raises(EmbedderError, match="failed to load"):
        local.embed("x")
    with pytest.raises(EmbedderError, match="folder"):
        create_embedder({"engine": "local"})
    monkeypatch.setenv("OLLAMA_HOST", "box:1")
    assert create_embedder({"engine": "http"}).host == "http://box:1" and create_embedder({"engine": "http", "host": "https://a"}).host == "https://a"


def test_context(spark):
    lines = [("f", 2 * i, "message", f"e{i}", None, f"t{i}", ("user" if i % 2 else "assistant", json.dumps(f"m\t{i}"))) for i in range(20)]
    noise = [("f", 2 * i + 1, "message", f"x{i}", None, None, ("toolResult", json.dumps("noise"))) for i in range(20)]
    df = spark.createDataFrame(lines + noise + [("g", 1, "message", None, None, None, ("user", json.dumps([{"type": "text", "text": "a"}, {"type": "text", "text": " "}])))],
                               "source_uri string, line_number long, type string, id string, parentId string, timestamp string, message struct<role:string,content:string>")
    assert visible_messages(df).where("source_uri = 'g'").collect()[0].text == "a\n "
    hits = spark.createDataFrame([("h", "f", 12, ""), ("i", "f", 0, "e0"), ("j", "f", 1, "zz")], "hit_id string, source_uri string, line int, entry string")
    out = context(df, hits).collect()
    assert [r.lineNumber for r in sorted(out, key=lambda r: r.ordinal) if r.hit_id == "h"] == [2 * i for i in range(1, 17)]
    assert {r.lineNumber for r in out if r.hit_id == "i"} == {2 * i for i in range(11)} and not [r for r in out if r.hit_id == "j"]
    assert tsv(context(df, hits)).where("hit_id = 'i' and lineNumber = 2").collect()[0].tsv == "2\te1\t\tt1\tuser\tm\\t1"


def fuse(spark, *lists, **kw):
    rows = [(i, n, x) for i, items in enumerate(lists) for n, x in enumerate(items, 1)]
    return [r.id for r in rrf(spark.createDataFrame(rows, "list_idx int, rank int, id string"), **kw).collect()]


def test_fusion(spark):
    assert fuse(spark) == [] and fuse(spark, ["a", "b"]) == ["a", "b"]
    assert fuse(spark, ["a", "b"], ["b", "c"]) == ["b", "a", "c"]
    assert fuse(spark, ["a"], ["b"]) == ["a", "b"] and fuse(spark, ["b"], ["a"]) == ["b", "a"]
    assert fuse(spark, ["a", "a"], ["b"]) == ["a", "b"] and fuse(spark, [], ["x"], []) == ["x"]
    for k in (0, -1, math.nan, math.inf, "60", True):
        with pytest.raises(InvalidArgumentError):
            fuse(spark, ["a"], k=k)
    payload = spark.createDataFrame([(1, 1, "a", "late"), (0, 3, "a", "early"), (0, 1, None, "n")], "list_idx int, rank int, id string, p string")
    assert {r.id: r.p for r in first_payload(payload, "id", "p").collect()} == {"a": "early", None: "n"}


class Answers:
    def __init__(self, *codes, body=None):
        self.codes, self.body, self.calls = list(codes), body, 0

    def __call__(self, request):
        self.calls += 1
        code = self.codes.pop(0) if self.codes else 200
        if code == "down":
            raise OSError("refused")
        if code != 200:
            raise urllib.error.HTTPError("u", code, "bad", {}, None)
        return io.BytesIO(json.dumps(self.body or {"embeddings": [[0.5] * 64]}).encode())


def test_http_embedder():
    waits = []
    make = lambda a: HttpEmbedder(dim=64, opener=a, sleep=waits.append)
    assert make(Answers(429, 503, 500)).embed("x") == [0.5] * 64 and waits == [0.5, 1.0, 2.0]
    for answers, calls in ((Answers(500, 500, 500, 500), 4), (Answers(404), 1), (Answers("down"), 1), (Answers(body={"x": 1}), 1), (Answers(body={"embeddings": []}), 1), (Answers(body={"embeddings": [[1.0]]}), 1)):
        with pytest.raises(EmbedderError):
            make(answers).embed("x")
        assert answers.calls == calls
    assert make(Answers()).embed_batch([]) == []


def test_other_embedders(spark):
    loads = []

    def load():
        loads.append(1)
        if len(loads) == 1:
            raise OSError("not yet")
        return lambda text: [[3.0] + [0.0] * 63, [1.0] + [0.0] * 63]

    local = LocalEmbedder(load, 64)
    with pytest.raises(EmbedderError):
        local.embed("x")
    assert local.embed("x")[0] == 1.0 and local.embed("y") and len(loads) == 2
    assert create_embedder({"engine": "hashing", "dim": 64}).dim == 64 and create_embedder({"engine": "http"}).dim == 768
    with pytest.raises(EmbedderError):
        create_embedder({"engine": "none"})
    df = spark.createDataFrame([("a b",), (None,), ("",)], "text string")
    assert [r.embedding is None for r in with_embeddings(df, HashingEmbedder(8)).collect()] == [False, True, False]


def test_config(tmp_path):
    base = str(tmp_path / "home")
    with pytest.raises(ConfigError):
        load_config(base)
    init(base)
    assert load_config(base) == {"embedder": {"engine": "hashing", "dim": 768}} and os.stat(base).st_mode & 0o077 == 0
    for raw in ("{", "[]", '{"embedder": []}', '{"embedder": {"engine": "x"}}', '{"embedder": {"engine": "http", "model": ""}}', '{"embedder": {"engine": "http", "dim": 3}}'):
        with open(os.path.join(base, "models.json"), "w") as f:
            f.write(raw)
        with pytest.raises(ConfigError):
            load_config(base)
        with pytest.raises(ConfigError):
            init(base)
    with open(os.path.join(base, "models.json"), "w") as f:
        f.write("{}")
    assert load_config(base) == {"embedder": {"engine": "hashing", "dim": 768}} and os.path.isdir(os.path.join(base, "data", "chunks"))
    with open(os.path.join(base, "models.json"), "w") as f:
        json.dump({"embedder": {"engine": "http", "model": "m", "more": 1}, "x": 2}, f)
    init(base)
    assert load_config(base) == {"embedder": {"engine": "http", "model": "m"}}
    open_dir = tmp_path / "open"
    open_dir.mkdir(mode=0o755)
    os.chmod(open_dir, 0o755)
    with pytest.raises(EngramError, match="too open"):
        private_dir(str(open_dir))
    assert store_path("/x") == "/x" and store_path(" ", env={"ENGRAM_STORE": "/y"}) == "/y" and store_path(env={"ENGRAM_STORE": " "}, home="/h") == "/h/.engram/store"


def test_json_rows(spark):
    assert json.loads(to_json_rows(spark.createDataFrame([(1, None)], "a int, b string"))[0]) == {"a": 1}
