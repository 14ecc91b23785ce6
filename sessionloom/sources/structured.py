"""Parsing the small structured artifacts: indexes, tasks, facets, the stats cache, plans, prompt history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import epoch_millis_text, last_segment
from .sessions import stem

EPOCH = "1970-01-01T00:00:00Z"
INDEX = (
    "version INT, originalPath STRING, entries ARRAY<STRUCT<sessionId STRING, fullPath STRING, fileMtime BIGINT, firstPrompt STRING, summary STRING, "
    "messageCount INT, created STRING, modified STRING, gitBranch STRING, projectPath STRING, isSidechain BOOLEAN>>"
)
DESKTOP = "sessionId STRING, cwd STRING, createdAt BIGINT, lastActivityAt BIGINT, model STRING, title STRING"
TASK = "id STRING, subject STRING, description STRING, activeForm STRING, status STRING, blocks ARRAY<STRING>, blockedBy ARRAY<STRING>"
FACET = (
    "session_id STRING, underlying_goal STRING, goal_categories MAP<STRING, INT>, outcome STRING, user_satisfaction_counts MAP<STRING, INT>, "
    "claude_helpfulness STRING, session_type STRING, friction_counts MAP<STRING, INT>, friction_detail STRING, primary_success STRING, brief_summary STRING"
)
STATS = (
    "version INT, lastComputedDate STRING, dailyActivity ARRAY<STRUCT<date STRING, messageCount BIGINT, sessionCount BIGINT, toolCallCount BIGINT>>, "
    "modelUsage MAP<STRING, STRUCT<input_tokens BIGINT, output_tokens BIGINT, cache_read_tokens BIGINT, cache_creation_tokens BIGINT>>"
)


def whole(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, value) of whole files."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def decoded(files: DataFrame, schema: str) -> DataFrame:
    """Files that hold an object of the schema; unknown fields are ignored, missing ones are null."""
    return files.withColumn("x", F.from_json("value", schema)).filter(F.try_parse_json("value").isNotNull() & F.col("x").isNotNull())


def session_index(files: DataFrame) -> DataFrame:
    """Sessions of index files; a session's path falls back to the index's own."""
    e = F.col("e")
    path = F.coalesce(e["projectPath"], F.col("x.originalPath"), F.lit(""))
    created = F.coalesce(e["created"], F.lit(EPOCH))
    return decoded(files, INDEX).select("file", "x", F.explode("x.entries").alias("e")).select(
        e["sessionId"].alias("id"), path.alias("project_path"), last_segment(path).alias("project_slug"), e["firstPrompt"].alias("first_prompt"), e["summary"].alias("summary"),
        F.coalesce(e["messageCount"], F.lit(0)).alias("message_count"), created.alias("created_at"), F.coalesce(e["modified"], created).alias("modified_at"), e["gitBranch"].alias("git_branch"),
        F.coalesce(e["isSidechain"], F.lit(False)).alias("is_sidechain"), F.col("file").alias("source_file"),
    )


def desktop_index(files: DataFrame) -> DataFrame:
    x = F.col("x")
    path = F.coalesce(x["cwd"], F.lit(""))
    return decoded(files, DESKTOP).filter(x["sessionId"].isNotNull()).select(
        x["sessionId"].alias("id"), path.alias("project_path"), last_segment(path).alias("project_slug"), x["title"].alias("first_prompt"), F.lit(None).cast("string").alias("summary"), F.lit(0).alias("message_count"),
        epoch_millis_text(x["createdAt"]).alias("created_at"), epoch_millis_text(x["lastActivityAt"]).alias("modified_at"), F.lit(None).cast("string").alias("git_branch"), F.lit(False).alias("is_sidechain"), F.col("file").alias("source_file"),
    )


def tasks(files: DataFrame) -> DataFrame:
    """Tasks; the session is the folder that holds the file."""
    x = F.col("x")
    return decoded(files, TASK).filter(x["id"].isNotNull()).select(
        F.regexp_extract("file", r"([^/]*)/[^/]*$", 1).alias("session_id"), x["id"].alias("id"), x["subject"].alias("subject"), x["description"].alias("description"), x["activeForm"].alias("active_form"), x["status"].alias("status"),
        F.coalesce(x["blockedBy"], F.array().cast("array<string>")).alias("blocked_by"),
    )


def dependencies(rows: DataFrame) -> DataFrame:
    return rows.select("session_id", F.col("id").alias("task_id"), F.explode("blocked_by").alias("depends_on")).distinct()


def facets(files: DataFrame) -> DataFrame:
    """Outcomes; the session is the field, else the file's stem, else 'unknown'."""
    x = F.col("x")
    name = F.when(stem(F.col("file")) != "", stem(F.col("file")))
    return decoded(files, FACET).select(F.coalesce(x["session_id"], name, F.lit("unknown")).alias("session"), "x.*").select(
        F.col("session").alias("session_id"), "underlying_goal", "outcome", F.col("claude_helpfulness").alias("helpfulness"), "session_type", "primary_success", "friction_detail", "brief_summary", "goal_categories", "friction_counts"
    )


def counted(rows: DataFrame, counts: str, name: str) -> DataFrame:
    """(session_id, name, count) of a map column."""
    return rows.select("session_id", F.explode(counts).alias(name, "count"))


def stats_cache(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(daily activity, model usage) of the first stats cache by path; null counts are 0."""
    first = decoded(files, STATS).groupBy().agg(F.min_by("x", "file").alias("x")).filter("x IS NOT NULL")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    d, u = F.col("d"), F.col("u")
    days = first.select(F.explode("x.dailyActivity").alias("d")).select(d["date"].alias("date"), zero(d["messageCount"]).alias("message_count"), zero(d["sessionCount"]).alias("session_count"), zero(d["toolCallCount"]).alias("tool_call_count"))
    usage = first.select(F.explode("x.modelUsage").alias("model", "u")).select("model", *[zero(u[c]).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")])
    return days, usage


def texts(rows: DataFrame, text: Column, kind: str) -> DataFrame:
    """(file, text, kind) of non-blank texts, as blobs to store and index."""
    return rows.select("file", text.alias("text"), F.lit(kind).alias("kind")).filter(F.col("text").rlike(r"\S"))


def plans(files: DataFrame) -> DataFrame:
    return texts(files, F.col("value"), "plan")


def history(rows: DataFrame) -> DataFrame:
    """Prompts of history lines (file, ord, value); lines without one, or that do not parse, are skipped."""
    return texts(rows, F.try_variant_get(F.try_parse_json("value"), "$.display", "string"), "history_prompt")
