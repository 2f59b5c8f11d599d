"""Queries for the engine's own operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.embed import HashingEmbedder, KeywordEmbedder, with_embeddings
from engram.functions.text import SNIPPET_LIMIT, composite_key as json_key, entry_chunk_id, js_trim, micros, snippet
from engram.functions.vectors import is_valid
from engram.index import TIES, SessionIndex, hit_rows, index_records
from engram.operators.branches import active_chain
from engram.operators.context import context, tsv, visible_messages
from engram.operators.fusion import rrf
from engram.operators.recall import batch_top_k, ranked, search_filter, top_k, top_k_cosine
from engram.operators.sessions import current_versions, first_seen, parse_messages, with_cwd
from engram.operators.state import delete, deleted_count, insert_or_ignore, last_write, new_rows, reconcile, stale_rows, upsert
from engram.plans import sql
from engram.session import held, local_path, read_table
from engram.sources.jsonl import parse_lines, split_lines
from engram.sources.store import CHUNK_SCHEMA, SnapshotTable
from engram.validate import METADATA_LIMIT_BYTES, TEXT_LIMIT_BYTES

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return register


def _vector(df: DataFrame, where: str) -> list[float]:
    """The vector of one row."""
    return df.where(where).select("embedding").limit(1).collect()[0][0]


def _hits(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, F.round("score", 6).alias("score"))


# --- recall -----------------------------------------------------------------------------------------------------------
def _knn_sql(where: str, k: int, query_id: int) -> str:
    return f"""SELECT row_number() OVER (ORDER BY d, vec_id) AS rank, vec_id, round(1 / (1 + d), 6) AS score FROM
        (SELECT vec_id, list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {query_id})) AS d
         FROM embeddings WHERE {where}) ORDER BY d, vec_id LIMIT {k}"""


def _knn(spark, sf_dir, where, k, query_id):
    e = read_table(spark, sf_dir, "embeddings")
    hits = top_k(e, _vector(e, f"vec_id = {query_id}"), k, where=F.expr(where) if where else None, ties=["vec_id"])
    return _hits(ranked(hits, "vec_id"), "rank", "vec_id")


@query(_knn_sql("label = 2", 20, 1))
def recall_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project-scoped nearest neighbours: filter, then rank."""
    return _knn(spark, sf_dir, "label = 2", 20, 1)


@query(_knn_sql("true", 50, 3))
def recall_global_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, None, 50, 3)


@query(_knn_sql("label = 0", 10, 5))
def recall_default_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, "label = 0", 10, 5)


@query("""SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), e.vec_id) AS rank,
        e.vec_id AS id, round(1 / (1 + list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS score
        FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10""")
def recall_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector as a query against all vectors of its project."""
    e = read_table(spark, sf_dir, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = e.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    return _hits(batch_top_k(queries, e, 10, dim=64), "query_id", "rank", "id")


_PROJECT = "'harbor-ledger'"


@query(f"""WITH v AS (SELECT DISTINCT project_id, chunk_id, embedding::DOUBLE[] AS e FROM vec_source_chunks WHERE project_id = {_PROJECT} AND len(embedding) = 64
          AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    q AS (SELECT e FROM v ORDER BY chunk_id LIMIT 1),
    near AS (SELECT project_id, chunk_id, list_distance(e, (SELECT e FROM q)) AS d FROM v ORDER BY d, chunk_id LIMIT 10)
    SELECT chunk_id, round(1 / (1 + d), 6) AS score, c.source_uri, c.entry_id, CASE WHEN length(c.text) <= 800 THEN c.text ELSE substr(c.text, 1, 799) || '…' END AS snippet
    FROM near JOIN {sql.CURRENT} c USING (project_id, chunk_id)""")
def recall_with_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank narrow vectors first, then fetch the text of the few hits."""
    v = read_table(spark, sf_dir, "vec_source_chunks").where(f"project_id = {_PROJECT}").where(is_valid(F.col("embedding"), 64)).drop("chunk_key").distinct()
    first = v.orderBy("chunk_id").limit(1).collect()[0]["embedding"]
    near = top_k(v, first, 10, ties=["chunk_id"]).drop("distance")
    chunks = read_table(spark, sf_dir, "source_chunks").where(f"project_id = {_PROJECT}")
    chunks = chunks.join(F.broadcast(near.select("chunk_id")), "chunk_id", "left_semi")  # ten rows
    current = current_versions(chunks, ["text", "source_kind", "source_uri", "entry_id"])
    return near.join(current, ["project_id", "chunk_id"]).select(
        "chunk_id", F.round("score", 6).alias("score"), "source_uri", "entry_id", snippet(F.col("text")).alias("snippet")
    )


_SESSION_QUERY = [0.5, -0.25, 0.125, 0.75, -0.5, 0.25, 0.0, 1.0]
_CWD = "'/home/dev/harbor-ledger'"


def _index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pi_jsonl_chunks").where("embedding is not null").distinct()


def _filtered(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    where = search_filter(cwd=_CWD.strip("'"), timestamp_from="2026-03-10", timestamp_to="2026-05-10T00:00:00.000Z")
    return ranked(top_k(_index_rows(spark, sf_dir), _SESSION_QUERY, k, where=where, ties=TIES), *TIES)


_FILTERED = f"""(SELECT *, row_number() OVER (ORDER BY d, source_uri, line_number, chunk_id) AS rank FROM
    (SELECT DISTINCT *, list_distance(embedding::DOUBLE[], {_SESSION_QUERY}::DOUBLE[]) AS d FROM pi_jsonl_chunks WHERE embedding IS NOT NULL
     AND cwd = {_CWD} AND timestamp >= '2026-03-10' AND timestamp <= '2026-05-10T00:00:00.000Z'))"""


@query(f"SELECT rank, chunk_id, round(1 / (1 + d), 6) AS score FROM {_FILTERED} WHERE rank <= 20")
def recall_filtered_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_filtered(spark, sf_dir, 20), "rank", "chunk_id")


@query(f"""SELECT rank, round(1 / (1 + d), 6) AS score, chunk_id AS "chunkId", CASE WHEN length(snippet) <= 800 THEN snippet ELSE substr(snippet, 1, 799) || '…' END AS snippet,
    source_uri AS "sourceUri", entry_id AS "entryId", parent_id AS "parentId", line_number AS "lineNumber" FROM {_FILTERED} WHERE rank <= 5""")
def ranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = hit_rows(_filtered(spark, sf_dir, 5))
    return hits.select("rank", F.round("score", 6).alias("score"), "chunkId", "snippet", *[f"sourcePointer.{c}" for c in ("sourceUri", "entryId", "parentId", "lineNumber")])


@query("""SELECT vec_id, round(s, 6) AS similarity FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[],
    (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 10""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return top_k_cosine(e, _vector(e, "vec_id = 7"), 10, ties=["vec_id"]).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("""SELECT project_id, count(*) AS vectors, count(*) FILTER (len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0) AS valid
    FROM (SELECT DISTINCT * FROM vec_source_chunks) GROUP BY project_id""")
def vector_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read_table(spark, sf_dir, "vec_source_chunks").distinct()
    return v.groupBy("project_id").agg(F.count("*").alias("vectors"), F.sum(is_valid(F.col("embedding"), 64).cast("long")).alias("valid"))


# --- filters and counts -----------------------------------------------------------------------------------------------
@query("""SELECT DISTINCT source_uri, chunk_id, entry_id, line_number FROM pi_jsonl_chunks WHERE cwd = '/home/dev/harbor-ledger' AND line_number = 3""")
def filter_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = search_filter(cwd="/home/dev/harbor-ledger", line_number=3)
    return read_table(spark, sf_dir, "pi_jsonl_chunks").where(where).select("source_uri", "chunk_id", "entry_id", "line_number").distinct()


@query("""SELECT DISTINCT chunk_id, timestamp FROM pi_jsonl_chunks WHERE timestamp >= '2026-04-01' AND timestamp <= '2026-04-15T12:00:00Z'""")
def filter_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = search_filter(timestamp_from="2026-04-01", timestamp_to="2026-04-15T12:00:00Z")
    return read_table(spark, sf_dir, "pi_jsonl_chunks").where(where).select("chunk_id", "timestamp").distinct()


@query("SELECT count(*) AS candidates, count(*) > 5000 AS too_broad FROM pi_jsonl_chunks WHERE parent_id <> '' AND timestamp >= '2026-03-15'")
def filter_candidate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_table(spark, sf_dir, "pi_jsonl_chunks").where("parent_id <> ''").where(search_filter(timestamp_from="2026-03-15"))
    return found.agg(F.count("*").alias("candidates"), (F.count("*") > 5000).alias("too_broad"))


@query(f"SELECT project_id, count(*) AS chunks FROM {sql.CURRENT} GROUP BY project_id")
def project_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_versions(read_table(spark, sf_dir, "source_chunks"), []).groupBy("project_id").agg(F.count("*").alias("chunks"))


@query("SELECT DISTINCT source_uri FROM pi_jsonl_chunks WHERE source_uri IS NOT NULL")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pi_jsonl_chunks").select("source_uri").where("source_uri is not null").distinct()


# --- projections and validation ---------------------------------------------------------------------------------------
@query(f"SELECT DISTINCT chunk_id, CASE WHEN length(snippet) <= {SNIPPET_LIMIT} THEN snippet ELSE substr(snippet, 1, {SNIPPET_LIMIT - 1}) || '…' END AS snippet FROM pi_jsonl_chunks")
def snippet_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pi_jsonl_chunks").select("chunk_id", snippet(F.col("snippet")).alias("snippet")).distinct()


@query(f"""SELECT DISTINCT project_id, chunk_id, updated_at, {sql.trimmed('text')} AS text, strlen({sql.trimmed('text')}) AS bytes, nullif(source_uri, '') AS source_uri
    FROM source_chunks WHERE {sql.trimmed('text')} <> '' AND strlen({sql.trimmed('text')}) <= {TEXT_LIMIT_BYTES}""")
def normalize_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = js_trim(F.col("text"))
    rows = read_table(spark, sf_dir, "source_chunks").select(
        "project_id", "chunk_id", "updated_at", text.alias("text"), F.octet_length(text).cast("long").alias("bytes"), F.nullif("source_uri", F.lit("")).alias("source_uri")
    )
    return rows.where((F.col("text") != "") & (F.col("bytes") <= TEXT_LIMIT_BYTES)).distinct()


@query(f"""SELECT count(*) FILTER ({sql.trimmed('text')} = '' OR text IS NULL) AS blank_text, count(*) FILTER (strlen({sql.trimmed('text')}) > {TEXT_LIMIT_BYTES}) AS long_text,
    count(*) FILTER (strlen(metadata_json) > {METADATA_LIMIT_BYTES}) AS long_metadata, count(*) FILTER (metadata_json IS NOT NULL AND NOT json_valid(metadata_json)) AS broken_metadata
    FROM source_chunks""")
def validation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, meta = js_trim(F.col("text")), F.col("metadata_json")
    n = lambda c, name: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(name)
    return read_table(spark, sf_dir, "source_chunks").agg(
        n((text == "") | text.isNull(), "blank_text"),
        n(F.octet_length(text) > TEXT_LIMIT_BYTES, "long_text"),
        n(F.octet_length(meta) > METADATA_LIMIT_BYTES, "long_metadata"),
        n(meta.isNotNull() & F.try_parse_json(meta).isNull(), "broken_metadata"),
    )


@query("SELECT DISTINCT source_uri, id, sha256(source_uri || chr(0) || id) AS chunk_id FROM mixed_session WHERE id <> ''")
def chunk_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "mixed_session").where("id <> ''")
    return rows.select("source_uri", "id", entry_chunk_id(F.col("source_uri"), F.col("id")).alias("chunk_id")).distinct()


@query("""SELECT DISTINCT project_id, chunk_id, json_extract_string(metadata_json, '$.cwd') AS cwd, json_extract_string(metadata_json, '$.role') AS role,
    json_extract_string(metadata_json, '$.tags[0]') AS first_tag, CAST(json_extract_string(metadata_json, '$.review.ok') AS BOOLEAN) AS review_ok
    FROM source_chunks WHERE json_valid(metadata_json)""")
def metadata_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.try_parse_json("metadata_json")
    get = lambda path, kind, name: F.try_variant_get(doc, path, kind).alias(name)
    rows = read_table(spark, sf_dir, "source_chunks").where(doc.isNotNull())
    return rows.select(
        "project_id", "chunk_id", get("$.cwd", "string", "cwd"), get("$.role", "string", "role"), get("$.tags[0]", "string", "first_tag"), get("$.review.ok", "boolean", "review_ok")
    ).distinct()


@query(f"""SELECT DISTINCT chunk_id, '{{"role":' || to_json(role) || ',"sourcePointer":{{"sourceKind":"pi-jsonl","sourceUri":' || to_json(source_uri) || ',"entryId":' || to_json(entry_id)
    || CASE WHEN parent_id IS NULL THEN '' ELSE ',"parentId":' || to_json(parent_id) END || ',"lineNumber":' || line_number
    || CASE WHEN timestamp IS NULL THEN '' ELSE ',"timestamp":' || to_json(timestamp) END || CASE WHEN cwd IS NULL THEN '' ELSE ',"cwd":' || to_json(cwd) END || '}}}}' AS metadata_json
    FROM (SELECT *, sha256(source_uri || chr(0) || entry_id) AS chunk_id FROM {sql.PARSED})""")
def metadata_role_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_records(parse_messages(read_table(spark, sf_dir, "mixed_session").distinct())).select("chunk_id", "metadata_json").distinct()


_KEYWORDS = ("session", "index", "the", "a chunk", "7")


@query("SELECT doc_id, 5 AS dim, " + ", ".join(f"contains(lower(text), '{k}')::INT AS v{i}" for i, k in enumerate(_KEYWORDS)) + " FROM documents WHERE text IS NOT NULL")
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts embedded in Arrow batches, with the values of their vectors."""
    docs = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    done = with_embeddings(docs, KeywordEmbedder(_KEYWORDS))
    return done.select("doc_id", F.size("embedding").alias("dim"), *[F.get("embedding", F.lit(i)).cast("int").alias(f"v{i}") for i in range(len(_KEYWORDS))])


# --- fusion -----------------------------------------------------------------------------------------------------------
def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    out = None
    for i, q in enumerate((1, 2, 3)):
        hits = ranked(top_k(e, _vector(e, f"vec_id = {q}"), 50, ties=["vec_id"]), "vec_id")
        part = hits.select(F.lit(i).alias("list_idx"), "rank", F.col("vec_id").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def _rrf_sql(k: int) -> str:
    lists = " UNION ALL ".join(
        f"""(SELECT {i} AS list_idx, row_number() OVER (ORDER BY d, vec_id) AS rank, vec_id FROM (SELECT vec_id, list_distance(embedding::DOUBLE[],
        (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {q})) AS d FROM embeddings) ORDER BY d, vec_id LIMIT 50)"""
        for i, q in enumerate((1, 2, 3))
    )
    return f"""SELECT id, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, seen) AS position FROM
        (SELECT vec_id AS id, sum(1.0::DOUBLE / ({k} + rank) ORDER BY list_idx, rank) AS score, min((list_idx, rank)) AS seen FROM ({lists}) GROUP BY vec_id)"""


def _fused(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    order = Window.orderBy(F.desc("score"), "list_idx", "rank")  # at most three lists of fifty
    return rrf(_lists(spark, sf_dir), k=k).select("id", F.round("score", 9).alias("score"), F.row_number().over(order).alias("position"))


@query(_rrf_sql(60))
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, 60)


@query(_rrf_sql(1))
def rrf_custom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, 1)


@query("SELECT DISTINCT project_id, chunk_id, chunk_key FROM vec_source_chunks WHERE project_id IS NOT NULL AND chunk_id IS NOT NULL AND chunk_key IS NOT NULL")
def composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of each vector as it is built here; the SQL reads the one in the table."""
    rows = read_table(spark, sf_dir, "vec_source_chunks").where("project_id is not null and chunk_id is not null and chunk_key is not null")
    return rows.select("project_id", "chunk_id", json_key(F.col("project_id"), F.col("chunk_id")).alias("chunk_key")).distinct()


# --- sessions ---------------------------------------------------------------------------------------------------------
def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "mixed_session")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line once, with the columns that parsing needs."""
    message = F.when(F.col("message").isNotNull(), F.struct("message.role", "message.content")).alias("message")
    return _raw(spark, sf_dir).select("source_uri", "line_number", "type", "id", "parentId", "timestamp", "cwd", message).distinct()


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_messages(_lines(spark, sf_dir))


@query(f'SELECT source_uri, "lineNumber", "entryId", role, text FROM {sql.VISIBLE}')
def parse_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible_messages(read_table(spark, sf_dir, "mixed_session")).select("source_uri", "lineNumber", "entryId", "role", "text")


@query(f"SELECT * FROM {sql.PARSED}")
def text_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is indexed of the session files: text blocks joined, cwd carried forward."""
    return _parsed(spark, sf_dir)


@query(f"""SELECT source_uri, line_number, last_value(CASE WHEN type = 'session' THEN nullif(cwd, '') END IGNORE NULLS)
    OVER (PARTITION BY source_uri ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_cwd FROM {sql.LINES}""")
def cwd_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_cwd(_lines(spark, sf_dir)).select("source_uri", "line_number", "session_cwd")


_FIRST = f"(SELECT * FROM {sql.PARSED} QUALIFY row_number() OVER (PARTITION BY source_uri, entry_id ORDER BY line_number, text) = 1)"
_INDEX = "(SELECT DISTINCT * FROM pi_jsonl_chunks WHERE entry_id IS NOT NULL)"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pi_jsonl_chunks").where("entry_id is not null").distinct()


@query(f"SELECT source_uri, entry_id, line_number, text FROM {_FIRST}")
def dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_seen(_parsed(spark, sf_dir)).select("source_uri", "entry_id", "line_number", "text")


@query(f"SELECT source_uri, entry_id, line_number FROM {_FIRST} f ANTI JOIN {_INDEX} i USING (source_uri, entry_id)")
def new_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_rows(_index(spark, sf_dir), first_seen(_parsed(spark, sf_dir))).select("source_uri", "entry_id", "line_number")


@query(f"SELECT * FROM {sql.CHAIN}")
def active_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active chain of every file."""
    return active_chain(_raw(spark, sf_dir))


@query(f"SELECT p.source_uri, p.entry_id, p.line_number FROM {sql.PARSED} p SEMI JOIN {sql.CHAIN} c USING (source_uri, entry_id)")
def active_branch_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return parse_messages(lines, active_chain(_raw(spark, sf_dir))).select("source_uri", "entry_id", "line_number")


@query(f"""SELECT i.source_uri, i.entry_id FROM {_INDEX} i SEMI JOIN (SELECT DISTINCT source_uri FROM {sql.CHAIN}) f USING (source_uri)
    ANTI JOIN {sql.CHAIN} c ON i.source_uri = c.source_uri AND i.entry_id = c.entry_id""")
def stale_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stale_rows(_index(spark, sf_dir), active_chain(_raw(spark, sf_dir))).select("source_uri", "entry_id")


@query(f"""WITH chain AS MATERIALIZED (SELECT * FROM {sql.CHAIN}) SELECT chunk_id, source_uri, entry_id FROM {_INDEX} i WHERE source_uri NOT IN (SELECT source_uri FROM chain)
    OR EXISTS (SELECT 1 FROM chain c WHERE c.source_uri = i.source_uri AND c.entry_id = i.entry_id)""")
def reconcile_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile(_index(spark, sf_dir), held(active_chain(_raw(spark, sf_dir)))).select("chunk_id", "source_uri", "entry_id")


@query(f"""SELECT (SELECT count(*) FROM {_FIRST} f ANTI JOIN {_INDEX} i USING (source_uri, entry_id)) AS indexed, (SELECT count(*) FROM {sql.PARSED}) AS messages,
    (SELECT count(*) FROM {sql.PARSED}) - (SELECT count(*) FROM {_FIRST} f ANTI JOIN {_INDEX} i USING (source_uri, entry_id)) AS skipped_duplicate""")
def index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = held(_parsed(spark, sf_dir))
    new = new_rows(_index(spark, sf_dir), first_seen(parsed)).agg(F.count("*").alias("indexed"))
    both = parsed.agg(F.count("*").alias("messages")).join(new)  # one row each
    return both.select("indexed", "messages", (F.col("messages") - F.col("indexed")).alias("skipped_duplicate"))


# --- context ----------------------------------------------------------------------------------------------------------
_NUMBERED = f'(SELECT *, row_number() OVER (PARTITION BY source_uri ORDER BY "lineNumber", "entryId", text) AS ordinal FROM {sql.VISIBLE})'
#: One hit per file: the line (or entry) of its last indexed message.
_HITS = "(SELECT source_uri, max(line_number) AS line, max_by(entry_id, (line_number, entry_id)) AS entry FROM pi_jsonl_chunks WHERE entry_id IS NOT NULL AND line_number IS NOT NULL GROUP BY source_uri)"


def _context_sql(match: str, cols: str) -> str:
    return f"""WITH n AS MATERIALIZED (SELECT * FROM {_NUMBERED}), mid AS (SELECT n.source_uri, min(n.ordinal) AS middle FROM n JOIN {_HITS} h USING (source_uri) WHERE {match} GROUP BY n.source_uri)
        SELECT {cols} FROM n JOIN mid USING (source_uri) WHERE n.ordinal BETWEEN middle - 5 AND middle + 10"""


def _around(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "pi_jsonl_chunks").where("entry_id is not null and line_number is not null")
    hits = rows.groupBy("source_uri").agg(F.max("line_number").alias("line"), F.max_by("entry_id", F.struct("line_number", "entry_id")).alias("entry"))
    return context(read_table(spark, sf_dir, "mixed_session"), hits.select(F.col("source_uri").alias("hit_id"), "source_uri", by))


@query(_context_sql('n."lineNumber" = h.line', 'n.source_uri, n.ordinal, n."lineNumber", n.role, n.text'))
def context_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(spark, sf_dir, "line").select("source_uri", "ordinal", "lineNumber", "role", "text")


@query(_context_sql("""h.entry <> '' AND n."entryId" = h.entry""", 'n.source_uri, n.ordinal, n."lineNumber", n."entryId"'))
def context_by_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(spark, sf_dir, "entry").select("source_uri", "ordinal", "lineNumber", "entryId")


def _esc(c: str) -> str:
    return rf"replace(replace(replace(replace({c}, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r')"


@query(
    _context_sql(
        'n."lineNumber" = h.line',
        f"""n.source_uri, n.ordinal, concat_ws(chr(9), n."lineNumber"::VARCHAR, {_esc('n."entryId"')}, {_esc('n."parentId"')}, {_esc('n.timestamp')}, {_esc('n.role')}, {_esc('n.text')}) AS tsv""",
    )
)
def context_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsv(_around(spark, sf_dir, "line")).select("source_uri", "ordinal", "tsv")


# --- state changes ----------------------------------------------------------------------------------------------------
_CUTOFF = "2026-04-15T00:00:00Z"
_STATE_COLUMNS = ["text", "source_kind", "created_at", "updated_at"]


def _version_sql(sign: str) -> str:
    return f"""(SELECT project_id, chunk_id, text, source_kind, created_at, updated_at, {sql.instant('updated_at')} AS i FROM source_chunks WHERE i {sign} {sql.instant(f"'{_CUTOFF}'")}
        QUALIFY row_number() OVER (PARTITION BY project_id, chunk_id ORDER BY i DESC, text NULLS FIRST, source_kind NULLS FIRST, created_at NULLS FIRST, updated_at) = 1)"""


def _versions(spark: SparkSession, sf_dir: str, late: bool) -> DataFrame:
    from engram.functions.text import micros

    chunks = read_table(spark, sf_dir, "source_chunks")
    at, cut_at = micros(F.col("updated_at")), micros(F.lit(_CUTOFF))
    return current_versions(chunks.where(at >= cut_at if late else at < cut_at), _STATE_COLUMNS).drop("instant")


@query(f"""WITH cur AS MATERIALIZED (SELECT * FROM {_version_sql('<')}), batch AS MATERIALIZED (SELECT * FROM {_version_sql('>=')})
    SELECT project_id, chunk_id, text, source_kind, created_at, updated_at FROM cur ANTI JOIN batch USING (project_id, chunk_id) UNION ALL
    SELECT b.project_id, b.chunk_id, b.text, b.source_kind, CASE WHEN c.chunk_id IS NULL THEN b.created_at ELSE c.created_at END, b.updated_at FROM batch b LEFT JOIN cur c USING (project_id, chunk_id)""")
def upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store before a moment, upserted with all later versions."""
    return upsert(_versions(spark, sf_dir, False), _versions(spark, sf_dir, True))


@query(f"""SELECT source_uri, entry_id, snippet FROM {_INDEX} UNION ALL SELECT source_uri, entry_id, text FROM {_FIRST} f ANTI JOIN {_INDEX} i USING (source_uri, entry_id)""")
def insert_or_ignore_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = _index(spark, sf_dir).select("source_uri", "entry_id", "snippet")
    return insert_or_ignore(current, first_seen(_parsed(spark, sf_dir)).withColumnRenamed("text", "snippet"))


_GONE = "SELECT chunk_id FROM vec_source_chunks WHERE project_id = 'harbor-ledger'"


@query(f"SELECT project_id, chunk_id FROM {sql.CURRENT} WHERE NOT (project_id = 'harbor-ledger' AND chunk_id IN ({_GONE}))")
def delete_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = current_versions(read_table(spark, sf_dir, "source_chunks"), []).select("project_id", "chunk_id")
    return delete(chunks, "harbor-ledger", read_table(spark, sf_dir, "vec_source_chunks").where("project_id = 'harbor-ledger'"))


@query(f"SELECT count(DISTINCT chunk_id) AS deleted FROM source_chunks WHERE project_id = 'harbor-ledger' AND chunk_id IN ({_GONE})")
def delete_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_table(spark, sf_dir, "source_chunks").select("project_id", "chunk_id")
    return deleted_count(chunks, "harbor-ledger", read_table(spark, sf_dir, "vec_source_chunks").where("project_id = 'harbor-ledger'"))


# --- stores and files -------------------------------------------------------------------------------------------------
_PART_LINES = 1_000


@query(f"""SELECT source_uri || '#' || (line_number // {_PART_LINES}) AS source_uri, row_number() OVER (PARTITION BY source_uri, line_number // {_PART_LINES} ORDER BY line_number, type, id)::BIGINT AS line_number,
    type, id, text FROM (SELECT DISTINCT source_uri, line_number, type, coalesce(id, '') AS id, coalesce("content", '') AS text FROM mixed_session WHERE source_uri IS NOT NULL AND type IS NOT NULL)""")
def jsonl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as JSON text, up to 1,000 to a file, then split, numbered and parsed again."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = _raw(spark, sf_dir).where("source_uri is not null and type is not null").select("source_uri", "line_number", "type", blank("id").alias("id"), blank("content").alias("content")).distinct()
    line = F.to_json(F.struct("type", "id", "content"))
    name = F.concat_ws("#", "source_uri", F.floor(F.col("line_number") / _PART_LINES).cast("string"))
    lines = F.array_sort(F.collect_list(F.struct("line_number", "type", "id", line.alias("line"))))  # at most 1,000, and repeats
    files = rows.groupBy(name.alias("uri")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\r\n").alias("text"))
    return parse_lines(split_lines(files, "uri", "text")).select("source_uri", "line_number", "type", "id", F.col("content").alias("text"))


@query(f"""SELECT project_id, chunk_id, max({sql.instant('updated_at')}) AS at, count(*) AS versions FROM (SELECT DISTINCT project_id, chunk_id, updated_at FROM source_chunks
    WHERE project_id IS NOT NULL AND chunk_id IS NOT NULL AND updated_at IS NOT NULL) GROUP BY ALL""")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a batch with repeated keys the last write, and how many there were."""
    rows = read_table(spark, sf_dir, "source_chunks").where("project_id is not null and chunk_id is not null and updated_at is not null")
    rows = rows.select("project_id", "chunk_id", "updated_at").distinct().withColumn("at", micros(F.col("updated_at")))
    counts = rows.groupBy("project_id", "chunk_id").agg(F.count("*").alias("versions"))
    return last_write(rows, ["project_id", "chunk_id"], "at").select("project_id", "chunk_id", "at").join(counts, ["project_id", "chunk_id"])


def _stored(spark: SparkSession, sf_dir: str) -> SnapshotTable:
    """A store filled by an append of half of the chunks in an old state, an upsert of all and a delete of some."""
    chunks = held(
        current_versions(read_table(spark, sf_dir, "source_chunks"), ["text"])
        .where("project_id is not null and chunk_id is not null and text is not null")
        .select("project_id", "chunk_id", "text")
    )
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in CHUNK_SCHEMA if f.name not in chunks.columns]
    rows = chunks.select("*", *absent).select(CHUNK_SCHEMA.names)
    table = SnapshotTable(spark, local_path(spark, "store"), CHUNK_SCHEMA, 64)
    table.append(rows.where("length(chunk_id) % 2 = 0").withColumn("text", F.lit("old")))
    table.upsert(rows)
    table.delete(chunks.where("chunk_id like '%7'"))
    return table


@query(f"SELECT project_id, chunk_id, text FROM {sql.CURRENT} WHERE text IS NOT NULL AND project_id IS NOT NULL AND chunk_id IS NOT NULL AND chunk_id NOT LIKE '%7'")
def store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).read().select("project_id", "chunk_id", "text")


@query(f"SELECT project_id, chunk_id, text FROM {sql.CURRENT} WHERE text IS NOT NULL AND chunk_id IS NOT NULL AND chunk_id NOT LIKE '%7' AND project_id = {_PROJECT}")
def store_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project of a store, from its bucket alone, after its log has been folded."""
    table = _stored(spark, sf_dir)
    table.compact()
    return table.read(_PROJECT.strip("'")).select("project_id", "chunk_id", "text")


@query(f"SELECT source_uri, entry_id, text AS snippet, cwd FROM {_FIRST} f SEMI JOIN {sql.CHAIN} c USING (source_uri, entry_id)")
def index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session index after all messages were added, the rows of abandoned branches taken away and the files seen again."""
    lines = _lines(spark, sf_dir)
    index = SessionIndex(spark, local_path(spark, "index"), HashingEmbedder(8))
    index.index_lines(lines)
    index.index_lines(lines, spark.createDataFrame([], "source_uri string, entry_id string"))
    return index.table.read().select("source_uri", "entry_id", "snippet", "cwd")
