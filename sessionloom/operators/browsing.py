"""Lists, details and pages of sessions, messages, tool calls, files and blobs.

Pages have a total order: the stored order first, then the key. A page's rows are chosen
before anything is joined to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, order: list, limit: int = 20, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


ORDER = ("turn_index", "id")


def first_user_text(messages: DataFrame, chars: int = 200, order: tuple = ORDER) -> DataFrame:
    """(session_id, first_text): the first ``chars`` characters of each session's first user message."""
    users = messages.filter("type = 'user'")
    return users.groupBy("session_id").agg(F.min_by(F.substring("content", 1, chars), F.struct(*order)).alias("first_text"))


def session_list(messages: DataFrame, outcomes: DataFrame, outcome: str | None = None, limit: int = 20, offset: int = 0, order: tuple = ORDER) -> DataFrame:
    """A page of sessions with message count, first user text and outcome, newest (largest id) first.

    With ``outcome`` only sessions of that outcome are listed and counted. Counts and texts are taken of the page's messages only.
    """
    sessions = messages.select("session_id").distinct().join(outcomes.select("session_id", "outcome", "reason_code"), "session_id", "left")
    if outcome is not None:
        sessions = sessions.filter(F.col("outcome") == outcome)
    chosen = page(sessions, [F.desc("session_id")], limit, offset)
    mine = messages.join(F.broadcast(chosen.select("session_id")), "session_id", "left_semi")  # one page
    first = F.min_by(F.when(F.col("type") == "user", F.substring("content", 1, 200)), F.struct((F.col("type") != "user").alias("_"), *order))
    counts = mine.groupBy("session_id").agg(F.count("*").alias("message_count"), first.alias("first_text"))
    return chosen.join(counts, "session_id", "left")


def session_total(messages: DataFrame, outcomes: DataFrame, outcome: str | None = None) -> DataFrame:
    sessions = messages.select("session_id").distinct().join(outcomes.select("session_id", "outcome"), "session_id", "left")
    return (sessions.filter(F.col("outcome") == outcome) if outcome is not None else sessions).agg(F.count("*").alias("total"))


def display_title(approved: Column, title: Column, first_prompt: Column, first_text: Column) -> Column:
    """Approved title, else the stored prompt, else the first user text."""
    return F.coalesce(F.when(approved, title), first_prompt, first_text)


def titled(listed: DataFrame, enrichments: DataFrame, sessions: DataFrame) -> DataFrame:
    """A page of ``session_list`` with the title that each session is shown by: that of an approved enrichment, else its stored prompt, else its
    first user text.

    Only what belongs to the page is read of enrichments (session_id, title, approval_status) and sessions (session_id, first_prompt).
    """
    ids = F.broadcast(listed.select("session_id"))  # one page
    known = enrichments.join(ids, "session_id", "left_semi").select("session_id", F.col("title").alias("_title"), (F.col("approval_status") == "approved").alias("_approved"))
    prompts = sessions.join(ids, "session_id", "left_semi").select("session_id", "first_prompt")
    rows = listed.join(known, "session_id", "left").join(prompts, "session_id", "left")
    title = display_title(F.col("_approved"), F.col("_title"), F.col("first_prompt"), F.col("first_text"))
    return rows.withColumn("title", title).drop("_title", "_approved", "first_prompt")


def message_page(messages: DataFrame, session_id, limit: int = 100, offset: int = 0) -> DataFrame:
    rows = messages.filter(F.col("session_id") == session_id)
    return page(rows, ["turn_index", "id"], limit, offset).select("id", "turn_index", "type", F.substring("content", 1, 100).alias("preview"), F.octet_length("content").cast("long").alias("size"))


def messages_with_blocks(messages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Messages with their content blocks as one ordered array of structs."""
    grouped = blocks.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("block_index", "block_type", "content_hash", "tool_name"))).alias("blocks"))
    return messages.join(grouped.withColumnRenamed("message_id", "id"), "id", "left")


def blocks_with_contents(blocks: DataFrame, blobs: DataFrame) -> DataFrame:
    """Content blocks with the texts of their content and of their tool input; null where there is no such blob."""
    text = lambda key, name: blobs.select(F.col("hash").alias(key), F.col("content").alias(name))
    return blocks.join(text("content_hash", "content"), "content_hash", "left").join(text("tool_input_hash", "tool_input"), "tool_input_hash", "left")


def session_tools(calls: DataFrame, inputs: DataFrame, outputs: DataFrame, session_id) -> DataFrame:
    """Tool calls of a session by time, with the contents of both blobs; missing blobs are null."""
    rows = calls.filter(F.col("session_id") == session_id)
    return (
        rows.join(inputs.select(F.col("hash").alias("input_hash"), F.col("content").alias("input")), "input_hash", "left")
        .join(outputs.select(F.col("hash").alias("output_hash"), F.col("content").alias("output")), "output_hash", "left")
        .select("id", "timestamp", "tool_name", "input", "output")
        .orderBy("timestamp", "id")  # one session
    )


def file_page(files: DataFrame, path: str, contains: str | None = None, limit: int = 20, offset: int = 0, ties: tuple = ()) -> DataFrame:
    """A page of files whose path contains a text, in either case; % and _ in it are wildcards. Equal paths are ordered by ``ties``."""
    rows = files.filter(F.col(path).ilike(f"%{contains}%")) if contains is not None else files
    return page(rows, [path, *ties], limit, offset)


def blob(blobs: DataFrame, digest: Column | str) -> DataFrame:
    """The blob of one hash; the predicate is pushed into the scan of a stored table."""
    return blobs.filter(F.col("hash") == digest)


def references_of(references: DataFrame, digest: str) -> DataFrame:
    return references.filter(F.col("hash") == digest)


def without(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key no row of ``others`` has (sessions without enrichment, files no longer there)."""
    return rows.join(others.select(key).distinct(), key, "left_anti")


def within(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return rows.join(others.select(key).distinct(), key, "left_semi")


def tags_of(rows: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """Rows with their tags, highest confidence first, as one array."""
    listed = tags.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("o"), "tag"))), lambda t: t["tag"]).alias("tags"))
    return rows.join(listed, key, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def review_queue(enrichments: DataFrame, sessions: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Pending enrichments with their session, latest first."""
    rows = enrichments.filter("approval_status = 'pending_review'").join(sessions, "session_id")
    return page(rows, [F.desc("enriched_at"), "session_id"], limit, offset)
