"""Queries over hierarchies, nested records and changed records (problems 2, 4 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.text import micros
from engram.operators.changes import unseen
from engram.operators.hierarchy import descendants, hierarchy, subtree_counts
from engram.operators.nested import inside, label_nodes, node_tables
from engram.operators.sessions import ROLES, current_versions, forest_nodes, session_entries
from engram.plans import sql
from engram.session import cut, held, read_table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = forest_nodes(read_table(spark, sf_dir, "mixed_session"), read_table(spark, sf_dir, "source_chunks"))
    return hierarchy(
        nodes, group_cols=["origin", "project_id", "source_uri"], id_col="node_id", parent_col="parent_id", position_col="position"
    ).select("origin", "project_id", "source_uri", "node_id", "root_id", "depth")


GROUP = ["origin", "project_id", "source_uri"]


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = forest_nodes(read_table(spark, sf_dir, "mixed_session"), read_table(spark, sf_dir, "source_chunks"))
    return held(hierarchy(nodes, group_cols=GROUP, id_col="node_id", parent_col="parent_id", position_col="position", with_paths=True))


def p2_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with its path and the number of nodes below it."""
    tree = _tree(spark, sf_dir)
    below = subtree_counts(tree, GROUP, "node_id").select(*[F.col(c).alias(f"_{c}") for c in [*GROUP, "node_id"]], "n")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*GROUP, "node_id"]]
    return tree.join(below, same, "left").select(
        *GROUP, "node_id", "root_id", "depth", F.array_join("path", "/").alias("path"), F.coalesce("n", F.lit(0)).alias("descendants")
    )


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a node and one below it, with the number of links between them."""
    return descendants(_tree(spark, sf_dir), GROUP, "node_id")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct line with JSON in it once."""
    return (
        read_table(spark, sf_dir, "mixed_session")
        .where("message.content is not null or message.usage is not null")
        .select("source_uri", "line_number", F.col("message.content").alias("content"), F.col("message.usage").alias("usage"))
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = label_nodes(_records(spark, sf_dir), LINE, objects_only=True)
    return nodes.select(*LINE, "node_path", "parent_path").distinct()


LINE = ["source_uri", "line_number"]
#: The flat tables: the scalars of each type of object that become columns.
NODE_TYPES = {
    "text": {"text": "text string"},
    "thinking": {"thinking": "thinking string"},
    "toolCall": {"call_id": "id string", "tool": "name string"},
    "image": {"mime_type": "mimeType string"},
    "arguments": {},
    "usage": {"input": "input long", "output": "output long", "total_tokens": "totalTokens long"},
}


def _node_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return node_tables(cut(label_nodes(_records(spark, sf_dir).distinct(), LINE)), LINE, NODE_TYPES)  # parsed once


def p4_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat tables one under the other: interval labels, parent and the columns of every type (null where not its own)."""
    tables = _node_tables(spark, sf_dir)
    parts = [t.withColumn("node_type", F.lit(name)) for name, t in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.drop("root")


def p4_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of token counts, where there is one."""
    return _node_tables(spark, sf_dir)["usage"].where("total_tokens is not null").select(*LINE, "node_path", "total_tokens")


def p4_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments linked to the tool call around them, by containment of intervals."""
    tables = _node_tables(spark, sf_dir)
    return inside(tables["arguments"], tables["toolCall"], LINE).select(*LINE, "node_path", "around")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = current_versions(read_table(spark, sf_dir, "source_chunks"), [])
    good = read_table(spark, sf_dir, "index_runs").where("status = 'success'").select("run_id", "attempt").distinct()
    handled = (
        read_table(spark, sf_dir, "index_ledger")
        .join(good, ["run_id", "attempt"], "left_semi")
        .select("project_id", "chunk_id", micros(F.col("seen_updated_at")).alias("instant"))
    )
    new_chunks = unseen(chunks, handled, ["project_id", "chunk_id"], "instant")

    digest = lambda c: F.unhex(F.md5(c))
    entries = session_entries(read_table(spark, sf_dir, "mixed_session"), with_digest=True)
    messages = entries.where((F.col("type") == "message") & F.col("role").isin(*ROLES) & F.col("digest").isNotNull()).select(
        "source_uri", F.col("id").alias("entry_id"), "digest"
    )
    indexed = read_table(spark, sf_dir, "pi_jsonl_chunks").where("entry_id is not null").select("source_uri", "entry_id", digest(F.col("snippet")).alias("digest"))
    new_messages = unseen(messages, indexed, ["source_uri", "entry_id"], "digest", every=True)
    return new_chunks.select(F.lit("source_chunks").alias("origin"), F.col("project_id").alias("key_a"), F.col("chunk_id").alias("key_b")).unionByName(
        new_messages.select(F.lit("mixed_session").alias("origin"), F.col("source_uri").alias("key_a"), F.col("entry_id").alias("key_b"))
    )


QUERIES = {"p6_found": p6_found, "p2_found": p2_found, "p2_tree": p2_tree, "p2_descendants": p2_descendants, "p4_found": p4_found, "p4_nodes": p4_nodes, "p4_usage": p4_usage, "p4_arguments": p4_arguments}


_NODES = f"""(SELECT 'mixed_session' AS origin, '' AS project_id, source_uri, id AS node_id, nullif(parentId, '') AS parent_id FROM {sql.ENTRIES}
    UNION ALL SELECT 'source_chunks', project_id, source_uri, entry_id, nullif(parent_id, '') FROM {sql.CURRENT} WHERE entry_id <> '')"""
#: Nodes are reached from the roots downwards; those never reached are circular.
TREE = f"""WITH RECURSIVE nodes AS MATERIALIZED (SELECT * FROM {_NODES}),
    tree(origin, project_id, source_uri, node_id, root_id, depth) AS (
        SELECT n.origin, n.project_id, n.source_uri, n.node_id, n.node_id, 0::BIGINT FROM nodes n WHERE n.parent_id IS NULL OR NOT EXISTS
            (SELECT 1 FROM nodes p WHERE p.origin = n.origin AND p.project_id = n.project_id AND p.source_uri = n.source_uri AND p.node_id = n.parent_id)
        UNION ALL SELECT n.origin, n.project_id, n.source_uri, n.node_id, t.root_id, t.depth + 1 FROM tree t
            JOIN nodes n ON n.origin = t.origin AND n.project_id = t.project_id AND n.source_uri = t.source_uri AND n.parent_id = t.node_id)"""

#: Every value of content and usage by its path, with the object around it; strings of JSON under ``arguments`` are opened.
_JSON = f"""WITH RECURSIVE rec AS (SELECT DISTINCT source_uri, line_number, message.content AS content, message.usage AS usage FROM mixed_session),
    roots AS (SELECT source_uri, line_number, 'content' AS path, CASE WHEN json_type(content) = 'VARCHAR' THEN to_json([{{'type': 'text', 'text': content::JSON->>'$'}}]) ELSE content::JSON END AS j
            FROM rec WHERE json_valid(content) AND (json_type(content) <> 'VARCHAR' OR {sql.trimmed("(content::JSON->>'$')")} <> '')
        UNION ALL SELECT source_uri, line_number, 'usage', usage::JSON FROM rec WHERE json_valid(usage)),
    nodes(source_uri, line_number, path, name, j, around) AS (SELECT source_uri, line_number, path, path, j, '' FROM roots
        UNION ALL SELECT n.source_uri, n.line_number, n.path || '.' || e.key, e.key,
            CASE WHEN e.key = 'arguments' AND e.type = 'VARCHAR' AND json_valid(e.value->>'$') THEN (e.value->>'$')::JSON ELSE e.value END,
            CASE WHEN json_type(n.j) = 'OBJECT' THEN n.path ELSE n.around END
        FROM nodes n, json_each(n.j) e WHERE json_type(n.j) IN ('OBJECT', 'ARRAY'))"""

PATHS = f"""WITH RECURSIVE nodes AS MATERIALIZED (SELECT * FROM {_NODES}),
    paths(origin, project_id, source_uri, node_id, p) AS (
        SELECT n.origin, n.project_id, n.source_uri, n.node_id, [n.node_id] FROM nodes n WHERE n.parent_id IS NULL OR NOT EXISTS
            (SELECT 1 FROM nodes p WHERE p.origin = n.origin AND p.project_id = n.project_id AND p.source_uri = n.source_uri AND p.node_id = n.parent_id)
        UNION ALL SELECT n.origin, n.project_id, n.source_uri, n.node_id, list_append(t.p, n.node_id) FROM paths t
            JOIN nodes n ON n.origin = t.origin AND n.project_id = t.project_id AND n.source_uri = t.source_uri AND n.parent_id = t.node_id)"""

ORACLE = {
    "p2_found": f"""{TREE} SELECT n.origin, n.project_id, n.source_uri, n.node_id, coalesce(t.root_id, '') AS root_id, coalesce(t.depth, -1) AS depth
        FROM nodes n LEFT JOIN tree t USING (origin, project_id, source_uri, node_id)""",
    "p2_tree": f"""{PATHS}, below AS (SELECT origin, project_id, source_uri, a AS node_id, count(*) AS n FROM paths, unnest(list_slice(p, 1, len(p) - 1)) u(a) GROUP BY ALL)
        SELECT n.origin, n.project_id, n.source_uri, n.node_id, coalesce(t.p[1], '') AS root_id, coalesce(len(t.p) - 1, -1)::BIGINT AS depth, array_to_string(t.p, '/') AS path,
            coalesce(b.n, 0) AS descendants FROM nodes n LEFT JOIN paths t USING (origin, project_id, source_uri, node_id) LEFT JOIN below b USING (origin, project_id, source_uri, node_id)""",
    "p2_descendants": f"""{PATHS} SELECT origin, project_id, source_uri, p[i] AS ancestor, node_id AS descendant, (len(p) - i)::BIGINT AS distance
        FROM paths, unnest(range(1, len(p))) u(i)""",
    "p4_found": f"{_JSON} SELECT DISTINCT source_uri, line_number, path AS node_path, around AS parent_path FROM nodes WHERE json_type(j) = 'OBJECT'",
    "p4_usage": f"""{_JSON} SELECT * FROM (SELECT DISTINCT source_uri, line_number, path AS node_path, CASE WHEN json_type(j->'totalTokens') NOT IN ('OBJECT', 'ARRAY') THEN try_cast(j->>'totalTokens' AS BIGINT) END AS total_tokens
        FROM nodes WHERE json_type(j) = 'OBJECT' AND CASE WHEN json_type(j->'type') = 'VARCHAR' AND j->>'type' <> '' THEN j->>'type' ELSE regexp_extract(path, '([^.]*[^.0-9][^.]*)(\\.[0-9]+)*$', 1) END = 'usage') WHERE total_tokens IS NOT NULL""",
    "p4_arguments": f"""{_JSON}, named AS (SELECT *, CASE WHEN json_type(j->'type') = 'VARCHAR' AND j->>'type' <> '' THEN j->>'type' ELSE regexp_extract(path, '([^.]*[^.0-9][^.]*)(\\.[0-9]+)*$', 1) END AS kind
            FROM nodes WHERE json_type(j) = 'OBJECT')
        SELECT DISTINCT a.source_uri, a.line_number, a.path AS node_path, arg_max(c.path, length(c.path)) AS around FROM named a JOIN named c
            ON a.source_uri = c.source_uri AND a.line_number = c.line_number AND starts_with(a.path, c.path || '.') WHERE a.kind = 'arguments' AND c.kind = 'toolCall' GROUP BY ALL""",
    "p6_found": f"""SELECT 'source_chunks' AS origin, c.project_id AS key_a, c.chunk_id AS key_b FROM {sql.CURRENT} c WHERE NOT EXISTS (SELECT 1 FROM index_ledger l
            JOIN index_runs r ON r.run_id = l.run_id AND r.attempt = l.attempt WHERE r.status = 'success' AND l.project_id = c.project_id AND l.chunk_id = c.chunk_id
            AND {sql.instant('l.seen_updated_at')} = {sql.instant('c.updated_at')})
        UNION ALL SELECT 'mixed_session', e.source_uri, e.id FROM {sql.ENTRIES} e LEFT JOIN (SELECT source_uri, entry_id, list(DISTINCT snippet) AS seen FROM pi_jsonl_chunks
            WHERE entry_id IS NOT NULL GROUP BY ALL) i ON i.source_uri = e.source_uri AND i.entry_id = e.id
        WHERE e.type = 'message' AND e.role IN ('user', 'assistant') AND e.text <> '' AND (i.seen IS NULL OR i.seen <> [e.text])""",
}
