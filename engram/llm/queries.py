"""Queries of the operators in this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.conversations import conversations
from engram.llm.mentions import mentions, redacted
from engram.llm.mixing import mix, shares
from engram.llm.packing import CAPACITY, fill_report, pack
from engram.llm.sentences import sentences
from engram.llm.splitting import split_texts
from engram.llm.tokens import with_tokens
from engram.llm.vectors import nearest, neighbour_pairs
from engram.functions.text import message_text
from engram.plans import sql
from engram.plans.structure import TREE
from engram.session import cut, read_table


def _free_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin, key_a, key_b, text of all chunk versions and all messages."""
    chunks = read_table(spark, sf_dir, "source_chunks").select(
        F.lit("source_chunks").alias("origin"), F.col("project_id").alias("key_a"), F.col("chunk_id").alias("key_b"), "text"
    )
    messages = read_table(spark, sf_dir, "mixed_session").where("type = 'message'").select(
        F.lit("mixed_session").alias("origin"),
        F.col("source_uri").alias("key_a"),
        F.col("line_number").cast("string").alias("key_b"),
        message_text(F.col("message.content")).alias("text"),
    )
    return chunks.unionByName(messages)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(_free_texts(spark, sf_dir), ["origin", "key_a", "key_b"]).select("origin", "key_a", "key_b", "kind", "found").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(_free_texts(spark, sf_dir), ["origin", "key_a", "key_b"]).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(read_table(spark, sf_dir, "mixed_session"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_pairs(nearest(read_table(spark, sf_dir, "vec_source_chunks"), dim=64, k=5))


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every version of every chunk."""
    versions = read_table(spark, sf_dir, "source_chunks").select("project_id", "chunk_id", "updated_at", "text", "line_start").distinct()
    return split_texts(versions, ["project_id", "chunk_id", "updated_at"])


def p7_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every version's trimmed text, put together again from its pieces without their overlaps."""
    key = ["project_id", "chunk_id", "updated_at"]
    versions = read_table(spark, sf_dir, "source_chunks").select(*key, "text", "line_start").distinct()
    versions = versions.withColumn("mark", F.xxhash64("text", "line_start"))
    pieces = split_texts(versions, [*key, "mark"])
    before = F.lag("end_pos").over(Window.partitionBy(*key, "mark").orderBy("piece_no"))
    added = F.expr("substring(piece, cast(greatest(coalesce(_before, start_pos) - start_pos, 0) + 1 as int))")
    parts = pieces.withColumn("_before", before).withColumn("added", added)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "added"))), lambda x: x["added"]), "")
    return parts.groupBy(*key, "mark").agg(F.md5(text).alias("body")).select(*key, "body").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_table(spark, sf_dir, "source_chunks")
    return split_texts(chunks, ["project_id", "chunk_id"]).where("n_pieces > 1").select("project_id", "chunk_id").distinct()


def _sizes(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return with_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text", *more))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_sizes(spark, sf_dir), id_col="doc_id", size_col="n_tokens")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p8_pack(spark, sf_dir))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the documents packed, containers that hold too much, and documents not packed exactly once, whole if they fit."""
    sizes = _sizes(spark, sf_dir)
    packed = cut(pack(sizes, id_col="doc_id", size_col="n_tokens"))
    full = packed.groupBy("container").agg(F.sum("size").alias("used")).where(F.col("used") > CAPACITY).agg(F.count("*").alias("overfull"))
    by = packed.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count("*").alias("parts"))
    parts = F.greatest(F.ceil(F.col("n_tokens") / CAPACITY), F.lit(1))
    wrong = F.coalesce((F.col("size") != F.col("n_tokens")) | (F.col("parts") != parts), F.lit(True))
    documents = sizes.join(by, "doc_id", "left").agg(F.count("*").alias("documents"), F.count_if(wrong).alias("wrong"))
    none = F.lit(0).cast("long")
    rows = documents.withColumn("overfull", none).unionByName(full.select(none.alias("documents"), none.alias("wrong"), "overfull"))
    return rows.agg(*[F.sum(c).alias(c) for c in rows.columns])


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.unhex(F.md5("text")).alias("same"))
    return mix(with_tokens(documents), read_table(spark, sf_dir, "mix_targets"), id_col="doc_id", size_col="n_tokens", identity_col="same")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(cut(_mixture(spark, sf_dir)), read_table(spark, sf_dir, "mix_targets"))


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: sources used too often, and sources more than one text away from their share."""
    largest = _sizes(spark, sf_dir).agg(F.max("n_tokens")).collect()[0][0] or 0
    reached = p9_shares(spark, sf_dir)  # a row for each target
    some, all_ = Window.partitionBy(), F.sum("tokens")
    weight = F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(some)
    off = F.abs(F.col("tokens") - F.col("target_share") / weight * all_.over(some)) > 2 * largest
    marked = reached.select((F.col("times") > F.col("max_repeats")).alias("often"), ((F.col("tokens") > 0) & off).alias("off"))
    return marked.agg(F.count_if("often").alias("too_often"), F.count_if("off").alias("off_share"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(read_table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "end_pos")


_ON_LINE = f"""{TREE}, e AS MATERIALIZED (SELECT * FROM {sql.ENTRIES}),
    k AS MATERIALIZED (SELECT e.*, t.root_id, t.depth FROM e JOIN tree t ON t.origin = 'mixed_session' AND t.source_uri = e.source_uri AND t.node_id = e.id),
    leaf AS (SELECT source_uri, root_id, id FROM k WHERE type = 'message' QUALIFY row_number() OVER (PARTITION BY source_uri, root_id ORDER BY said_at DESC NULLS LAST, line_number DESC) = 1),
    line(source_uri, root_id, id) AS (SELECT source_uri, root_id, id FROM leaf UNION ALL SELECT l.source_uri, l.root_id, k.parentId FROM line l
        JOIN k ON k.source_uri = l.source_uri AND k.id = l.id WHERE k.depth > 0),
    turn AS (SELECT k.source_uri, k.root_id, k.id, k.role, row_number() OVER w - 1 AS turn_no, lag(k.role) OVER w AS before, lead(k.role) OVER w AS after FROM line JOIN k USING (source_uri, root_id, id)
        WHERE k.type = 'message' AND k.role IN ('user', 'assistant') AND k.text <> '' WINDOW w AS (PARTITION BY k.source_uri, k.root_id ORDER BY k.depth))"""

ORACLE = {
    "p3_found": f"""{_ON_LINE} SELECT source_uri, root_id, turn_no, id FROM turn
        WHERE (source_uri, root_id) IN (SELECT (source_uri, id) FROM k WHERE coalesce(parentId, '') = '')
        AND (source_uri, root_id) NOT IN (SELECT (source_uri, root_id) FROM turn WHERE (before IS NULL AND role <> 'user') OR (after IS NULL AND role <> 'assistant') OR (role = 'user' AND before = 'user'))""",
    "p5_found": """WITH v AS MATERIALIZED (SELECT DISTINCT project_id, chunk_id, embedding::DOUBLE[] AS e FROM vec_source_chunks WHERE len(embedding) = 64
          AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        near AS (SELECT a.project_id, a.chunk_id AS q, b.chunk_id AS m FROM v a JOIN v b ON a.project_id = b.project_id AND a.chunk_id <> b.chunk_id
          QUALIFY row_number() OVER (PARTITION BY a.project_id, a.chunk_id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.chunk_id) <= 5)
        SELECT DISTINCT project_id, least(q, m) AS chunk_id_a, greatest(q, m) AS chunk_id_b FROM near""",
    "p7_rebuilt": f"SELECT DISTINCT project_id, chunk_id, updated_at, md5({sql.trimmed('text')}) AS body FROM source_chunks WHERE {sql.trimmed('text')} <> ''",
    "p8_check": "SELECT count(*) AS documents, 0 AS wrong, 0 AS overfull FROM documents",
    "p9_check": "SELECT 0 AS too_often, 0 AS off_share",
    "p7_found": f"SELECT DISTINCT project_id, chunk_id FROM source_chunks WHERE strlen({sql.trimmed('text')}) > 4096",
}

QUERIES = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p7_found": p7_found,
    "p7_pieces": p7_pieces,
    "p7_rebuilt": p7_rebuilt,
    "p8_pack": p8_pack,
    "p8_fill": p8_fill,
    "p8_check": p8_check,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_check": p9_check,
    "p10_found": p10_found,
}
