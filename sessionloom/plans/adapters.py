"""The driver's tables in the roles of the session-log model, as DataFrames and as SQL.

Each role is a function ``(spark, sf_dir) -> DataFrame``; ``ROLE_SQL`` has the same role for the
checks in DuckDB, and ``with_roles`` puts the ones that a statement names in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAMP = "yyyy-MM-dd HH:mm:ss"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sessions(spark, sf_dir):
    """Orders as sessions: priority is the project, status the source kind ('P' has none), one customer each."""
    stamp = F.date_format("o_orderdate", STAMP)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("/work/"), F.col("o_custkey").cast("string"), F.lit("/"), "o_orderpriority").alias("project_path"),
        F.col("o_orderpriority").alias("project_slug"),
        F.expr("nullif(o_orderstatus, 'P')").alias("source_kind"),
        stamp.alias("created_at"),
        stamp.alias("modified_at"),
        F.col("o_custkey").alias("owner"),
        F.round("o_totalprice").cast("long").alias("message_count"),
    )


def tool_calls(spark, sf_dir):
    """Line items as tool calls: flag and status are the tool, part and supplier the input and output blobs."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.col("l_orderkey").alias("session_id"),
        F.col("l_linenumber").alias("turn_index"),
        F.concat("l_returnflag", "l_linestatus").alias("tool_name"),
        F.date_format("l_shipdate", STAMP).alias("timestamp"),
        F.col("l_partkey").alias("input_hash"),
        F.col("l_suppkey").alias("output_hash"),
        F.round("l_extendedprice").cast("long").alias("size"),
    )


def session_messages(spark, sf_dir):
    """Line items as the messages of the sessions above."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"))


def messages(spark, sf_dir):
    """Conversation turns as messages."""
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("turn_index"),
        F.col("role").alias("type"),
        F.coalesce("text", F.lit("")).alias("content"),
    )


def content_store(spark, sf_dir):
    """Distinct document texts, content-addressed; the first document's source is the kind."""
    return blob_references(spark, sf_dir).groupBy("hash").agg(
        F.min_by("content", "doc_id").alias("content"),
        F.min_by("kind", "doc_id").alias("kind"),
        F.min_by("size", "doc_id").alias("size"),
    )


def blob_references(spark, sf_dir):
    """One reference for each document with a text."""
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(
        "doc_id", F.sha2("text", 256).alias("hash"), F.col("text").alias("content"), F.col("source").alias("kind"), F.octet_length("text").cast("long").alias("size")
    )


def outcomes(spark, sf_dir):
    """Documents as sessions, labels as their outcomes: quality is success or failure, toxic the reason."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("session_id"),
        F.col("source").alias("project_slug"),
        F.expr("CASE quality WHEN 1 THEN 'success' WHEN 0 THEN 'failed' END").alias("outcome"),
        F.expr("CASE WHEN toxic = 1 THEN 'tool_misuse' WHEN quality = 0 AND doc_id % 3 = 0 THEN 'unknown' END").alias("reason_code"),
        F.coalesce("n_chars", F.lit(0)).alias("message_count"),
    )


def file_references(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("src/part"), F.col("l_partkey").cast("string"), F.expr("CASE WHEN l_partkey % 3 = 0 THEN '.py' ELSE '.rs' END")).alias("file_path"),
        F.col("l_orderkey").alias("session_id"),
        F.col("l_linenumber").alias("message_id"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'read' WHEN 'N' THEN 'write' ELSE 'edit' END").alias("operation"),
    )


def event_calls(spark, sf_dir):
    """Events as tool calls of users, with whole seconds."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("session_id"),
        F.col("event_type").alias("tool_name"),
        F.expr("unix_seconds(date_trunc('SECOND', cast(ts AS timestamp)))").alias("sec"),
        F.to_date("ts").alias("day"),
        "value",
        "props",
    )


ROLE_SQL = {
    "sessions": """SELECT o_orderkey AS id, '/work/' || o_custkey || '/' || o_orderpriority AS project_path, o_orderpriority AS project_slug,
        nullif(o_orderstatus, 'P') AS source_kind, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS modified_at, o_custkey AS owner, CAST(round(o_totalprice) AS BIGINT) AS message_count FROM orders""",
    "tool_calls": """SELECT l_orderkey || '-' || l_linenumber AS id, l_orderkey AS session_id, l_linenumber AS turn_index, l_returnflag || l_linestatus AS tool_name,
        strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS "timestamp", l_partkey AS input_hash, l_suppkey AS output_hash,
        CAST(round(l_extendedprice) AS BIGINT) AS size FROM lineitem""",
    "session_messages": "SELECT l_orderkey AS session_id FROM lineitem",
    "messages": """SELECT conv_id || '-' || turn AS id, conv_id AS session_id, turn AS turn_index, role AS type, coalesce(text, '') AS content FROM conversations""",
    "blob_references": """SELECT doc_id, sha256(text) AS hash, text AS content, source AS kind, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL""",
    "content_store": """SELECT sha256(text) AS hash, arg_min(text, doc_id) AS content, arg_min(source, doc_id) AS kind,
        CAST(arg_min(strlen(text), doc_id) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    "outcomes": """SELECT d.doc_id AS session_id, source AS project_slug, CASE quality WHEN 1 THEN 'success' WHEN 0 THEN 'failed' END AS outcome,
        CASE WHEN toxic = 1 THEN 'tool_misuse' WHEN quality = 0 AND d.doc_id % 3 = 0 THEN 'unknown' END AS reason_code,
        coalesce(n_chars, 0) AS message_count FROM documents d LEFT JOIN labels USING (doc_id)""",
    "file_references": """SELECT 'src/part' || l_partkey || CASE WHEN l_partkey % 3 = 0 THEN '.py' ELSE '.rs' END AS file_path, l_orderkey AS session_id,
        l_linenumber AS message_id, CASE l_returnflag WHEN 'A' THEN 'read' WHEN 'N' THEN 'write' ELSE 'edit' END AS operation FROM lineitem""",
    "event_calls": """SELECT event_id AS id, user_id AS session_id, event_type AS tool_name, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec,
        CAST(ts AS DATE) AS day, value, props FROM events""",
}


def with_roles(statement: str) -> str:
    """``statement`` preceded by the roles that it names as common table expressions."""
    body = statement.strip()
    named = [r for r in ROLE_SQL if re.search(rf"\b{r}\b", statement)]
    head = ",\n".join(f"{r} AS ({ROLE_SQL[r]})" for r in named)
    if not named:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[14:]}"
    return f"WITH {head}{',' + chr(10) + body[4:] if body.upper().startswith('WITH') else chr(10) + body}"
