"""Plain versions of the queries of the language-model operators."""

from collections import defaultdict
from datetime import datetime, timezone

from brute import JS_SPACE, TABLES, entries, forest, instant, message_text, rows


def p3(where=TABLES):
    es = entries(rows("mixed_session", where))
    roots = forest({k: r["parentId"] for k, r in es.items()})
    trees = defaultdict(list)
    for k, (root, _) in roots.items():
        if root:
            trees[k[0], root].append(es[k])
    out = set()
    low = datetime.min.replace(tzinfo=timezone.utc)
    for (uri, root), nodes in trees.items():
        messages = [r for r in nodes if r["type"] == "message"]
        if es[uri, root]["parentId"] or not messages:
            continue
        at = max(messages, key=lambda r: (instant(r["timestamp"]) or low, r["line_number"]))
        line = [at]
        while at["parentId"] and (uri, at["parentId"]) in es:
            at = es[uri, at["parentId"]]
            line.append(at)
        turns = [r for r in line[::-1] if r["type"] == "message" and r["message"]["role"] in ("user", "assistant") and message_text(r["message"]["content"])]
        said = [r["message"]["role"] for r in turns]
        if said and said[0] == "user" and said[-1] == "assistant" and ("user", "user") not in zip(said, said[1:]):
            out |= {(uri, root, n, r["id"]) for n, r in enumerate(turns)}
    return out


def p7(where=TABLES, limit=4096):
    return {(r["project_id"], r["chunk_id"]) for r in rows("source_chunks", where) if r["text"] and len(r["text"].strip(JS_SPACE).encode()) > limit}


def p5(where=TABLES, k=5):
    import numpy as np

    groups = defaultdict(dict)
    for r in rows("vec_source_chunks", where):
        e = r["embedding"]
        if e is not None and len(e) == 64 and None not in e and np.isfinite(e).all() and any(e):
            groups[r["project_id"]][r["chunk_id"]] = np.array(e, dtype=np.float64)
    out = set()
    for p, vs in groups.items():
        ids = np.array(sorted(vs))
        x = np.array([vs[i] / np.linalg.norm(vs[i]) for i in ids])
        for n, i in enumerate(ids):
            s = np.round(x @ x[n], 9)
            s[n] = -9
            for o in np.argsort(-s, kind="stable")[: min(k, len(ids) - 1)]:
                out.add((p, *sorted((i, ids[o]))))
    return {(p, str(a), str(b)) for p, a, b in out}
