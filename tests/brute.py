"""Plain single-threaded versions of the queries, to test the engine against; rows are lists of dicts."""

from __future__ import annotations

import json
from collections import defaultdict
from datetime import datetime, timezone

import pyarrow.parquet as pq

from engram.functions.text import JS_SPACE

TABLES = "/root/testdata/sf0.001"


def rows(name: str, where: str = TABLES) -> list[dict]:
    """The distinct rows of a table."""
    out, seen = [], set()
    for r in pq.read_table(f"{where}/{name}.parquet").to_pylist():
        key = repr(r)
        if key not in seen:
            seen.add(key)
            out.append(r)
    return out


def instant(t):
    if t is None:
        return None
    try:
        d = datetime.fromisoformat(t.replace("Z", "+00:00").replace(" ", "T"))
    except ValueError:
        return None
    return d if d.tzinfo else d.replace(tzinfo=timezone.utc)


def message_text(content):
    try:
        v = json.loads(content)
    except (TypeError, ValueError):
        return ""
    if isinstance(v, list):
        v = "\n".join(
            b["text"] for b in v if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str) and b["text"].strip(JS_SPACE)
        )
    return v.strip(JS_SPACE) if isinstance(v, str) else ""


def entries(lines):
    last = {}
    for r in lines:
        if r["type"] != "session" and r["id"]:
            k = r["source_uri"], r["id"]
            if k not in last or r["line_number"] > last[k]["line_number"]:
                last[k] = r
    return last


def current(chunks):
    best = {}
    for r in chunks:
        k = r["project_id"], r["chunk_id"]
        if k not in best or instant(r["updated_at"]) > instant(best[k]["updated_at"]):
            best[k] = r
    return best


def forest(parents: dict):
    """{(group, id): parent id} to {(group, id): (root, depth)}."""
    out = {}
    for key in parents:
        path, at = [], key
        while at not in out:
            if at in path:
                out |= dict.fromkeys(path, ("", -1))
                break
            path.append(at)
            up = (at[0], parents[at])
            if not parents[at] or up not in parents:
                out[at] = (at[1], 0)
                path.pop()
                break
            at = up
        for node in reversed(path):
            if node not in out:
                root, depth = out[node[0], parents[node]]
                out[node] = (root, depth + 1 if depth >= 0 else -1)
    return out


def p2(where=TABLES):
    parents = {(("mixed_session", "", uri), i): r["parentId"] for (uri, i), r in entries(rows("mixed_session", where)).items()}
    for r in current(rows("source_chunks", where)).values():
        if r["entry_id"]:
            parents[("source_chunks", r["project_id"], r["source_uri"]), r["entry_id"]] = r["parent_id"]
    return {(*g, i, *x) for (g, i), x in forest(parents).items()}


def p4(where=TABLES):
    out = set()

    def walk(v, path, around, key):
        if isinstance(v, dict):
            out.add((*key, path, around))
            for k, x in v.items():
                if k == "arguments" and isinstance(x, str):
                    try:
                        x = json.loads(x)
                    except ValueError:
                        pass
                walk(x, f"{path}.{k}", path, key)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}.{i}", around, key)

    for r in rows("mixed_session", where):
        for root in ("content", "usage"):
            try:
                v = json.loads((r["message"] or {}).get(root))
            except (TypeError, ValueError):
                continue
            if root == "content" and isinstance(v, str):
                v = [{}] if v.strip(JS_SPACE) else None
            walk(v, root, "", (r["source_uri"], r["line_number"]))
    return out


def p6(where=TABLES):
    ok = {(r["run_id"], r["attempt"]) for r in rows("index_runs", where) if r["status"] == "success"}
    seen = {(r["project_id"], r["chunk_id"], instant(r["seen_updated_at"])) for r in rows("index_ledger", where) if (r["run_id"], r["attempt"]) in ok}
    out = {("source_chunks", *k) for k, r in current(rows("source_chunks", where)).items() if (*k, instant(r["updated_at"])) not in seen}
    index = defaultdict(set)
    for r in rows("pi_jsonl_chunks", where):
        index[r["source_uri"], r["entry_id"]].add(r["snippet"])
    for (uri, i), r in entries(rows("mixed_session", where)).items():
        if r["type"] == "message" and r["message"]["role"] in ("user", "assistant"):
            text = message_text(r["message"]["content"])
            if text and index.get((uri, i)) != {text}:
                out.add(("mixed_session", uri, i))
    return out
