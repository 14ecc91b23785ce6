"""From session artifacts to the tables of the session-log model, as one lazy plan for each table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import last_segment
from ..operators.store import content_hash, first_wins, redacted, session_fingerprint
from . import ranges, scan, sessions, structured

FORMATS = {"session_log": sessions.session_logs, "chat_session": sessions.chat_sessions, "rollout": sessions.rollouts}


#: Columns of the table of sessions, whatever artifact a row comes from.
SESSION = (
    "id STRING, project_path STRING, project_slug STRING, first_prompt STRING, summary STRING, message_count INT, created_at STRING, modified_at STRING, "
    "git_branch STRING, is_sidechain BOOLEAN, app_version STRING, source_file STRING"
)


def with_columns_of(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema``, null where ``rows`` has none."""
    kinds = rows.sparkSession.createDataFrame([], schema).schema
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])


def said(blocks: DataFrame, redact: bool, extra: list[str]) -> DataFrame:
    """(id, content, size): the texts of each message in order, and the bytes of all its blocks."""
    text = F.when(F.col("block_type") == "text", F.col("text"))
    parts = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("block_index", text.alias("t")))), lambda b: b["t"]), lambda t: t.isNotNull())
    content = F.array_join(parts, "\n")
    rows = blocks.groupBy(F.col("message_id").alias("id")).agg(content.alias("content"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("input"), F.lit(0))).cast("long").alias("size"))
    return rows.withColumn("content", redacted(F.col("content"), list(extra))) if redact else rows


def tables_of(messages: DataFrame, blocks: DataFrame, redact: bool = True, extra: list[str] = (), pending: DataFrame | None = None) -> dict[str, DataFrame]:
    """The message tables of parsed sessions. Keys are natural, so ingesting twice gives the same tables.

    Blobs are known by the hash of their original text; what is stored is redacted. ``pending`` are file uses of an earlier
    part of the same files that had no result there; ``outputs`` are results by tool use, also of uses that are not here.
    """
    order = ["file", "ord"]
    messages = first_wins(messages, ["id"], order).withColumn("fingerprint", F.sha2(F.concat("type", "digest_parts"), 256))
    blocks = blocks.withColumn("content_hash", content_hash("text")).withColumn("tool_input_hash", content_hash("input"))
    real = blocks.filter("block_type NOT IN ('tool_output', 'plan')")
    real = first_wins(real, ["message_id", "block_index", "block_type"], order)
    messages = messages.join(said(first_wins(blocks.filter("block_type NOT IN ('tool_output', 'plan')"), ["message_id", "block_index", "block_type"], order), redact, extra), "id", "left")
    messages = messages.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
    links = blocks.filter("block_type IN ('tool_result', 'tool_output')").groupBy("tool_use_id").agg(F.max_by("content_hash", F.struct(*order)).alias("output_hash"))
    calls = first_wins(blocks.filter("block_type = 'tool_use'"), ["tool_use_id"], order).join(links, "tool_use_id", "left")
    clean = redacted(F.col("content"), list(extra)) if redact else F.col("content")
    stored = blocks.filter("text IS NOT NULL").select(*order, "block_index", F.col("content_hash").alias("hash"), F.col("text").alias("content"), "kind", "searchable").unionByName(
        blocks.filter("input IS NOT NULL").select(*order, "block_index", F.col("tool_input_hash").alias("hash"), F.col("input").alias("content"), F.lit("tool_input").alias("kind"), F.lit(False).alias("searchable"))
    )
    store = first_wins(stored, ["hash"], [*order, "block_index"]).withColumn("content", clean)
    search = first_wins(stored.filter("searchable"), ["hash"], [*order, "block_index"]).withColumn("content", clean)
    return {
        "messages": messages.drop("digest_parts"),
        "content_blocks": real.select("message_id", "block_index", "block_type", "content_hash", "tool_name", "tool_use_id", "tool_input_hash"),
        "tool_calls": calls.select(
            F.col("tool_use_id").alias("id"), "message_id", "session_id", "tool_name", F.col("tool_input_hash").alias("input_hash"), "output_hash", "timestamp", F.sha2(F.concat("tool_name", "tool_input_hash"), 256).alias("fingerprint")
        ),
        "content_store": store.select("hash", "content", F.octet_length("content").cast("long").alias("size"), "kind"),
        "blob_references": blocks.filter("context IS NOT NULL AND content_hash IS NOT NULL").select(F.col("content_hash").alias("hash"), "message_id", "context").distinct(),
        "file_uses": file_uses(blocks),
        "outputs": links,
        "file_references": file_references(blocks, pending),
        "search": search.select("hash", "kind", "content"),
        "fingerprints": session_fingerprint(messages, ["timestamp", "turn_index", "id"]),
    }


def file_uses(blocks: DataFrame) -> DataFrame:
    """Uses of tools that read or change the file they name."""
    operation = F.create_map(*[F.lit(x) for pair in sessions.FILE_TOOLS.items() for x in pair])
    rows = blocks.filter(F.col("path").isNotNull() & F.col("tool_name").isin(list(sessions.FILE_TOOLS)))
    return rows.select("file", "tool_use_id", "ord", "block_index", "path", operation[F.col("tool_name")].alias("operation"))


def file_references(blocks: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """Files that a tool read or changed: each use with the first later result of its id in the same file."""
    uses = file_uses(blocks)
    uses = uses if pending is None else uses.unionByName(pending)
    uses = uses.select("file", "tool_use_id", F.struct("ord", "block_index").alias("used"), "path", "operation")
    results = blocks.filter("block_type = 'tool_result'").select("file", "tool_use_id", F.struct("ord", "block_index").alias("got"), "content_hash", "session_id", "message_id")
    first = uses.join(results, ["file", "tool_use_id"]).filter("used.ord < got.ord").groupBy("file", "tool_use_id").agg(F.min_by(F.struct("path", "content_hash", "session_id", "message_id", "operation"), F.struct("got", "used")).alias("r"))
    return first.select(F.col("r.path").alias("file_path"), "r.content_hash", "r.session_id", "r.message_id", "r.operation").distinct()


def minimal_sessions(messages: DataFrame) -> DataFrame:
    """Sessions as their first message shows them, for those that no index names."""
    first = messages.groupBy("session_id").agg(F.min_by(F.struct("cwd", "timestamp", "git_branch", "file"), F.struct("file", "ord")).alias("m"), F.max("timestamp").alias("modified_at"))
    return first.select(
        F.col("session_id").alias("id"), F.coalesce("m.cwd", F.lit("")).alias("project_path"), F.coalesce(last_segment(F.col("m.cwd")), F.lit("")).alias("project_slug"), F.col("m.timestamp").alias("created_at"), "modified_at",
        F.col("m.git_branch").alias("git_branch"), F.col("m.file").alias("source_file"),
    )


def tagged(rows: DataFrame, name: str | None, kind: str | None) -> DataFrame:
    """Rows with the name and the kind, in lower case, of the source that they come from."""
    return rows.withColumn("source_name", F.lit(name).cast("string")).withColumn("source_kind", F.lower(F.lit(kind).cast("string")))


def ingest(spark: SparkSession, root: str, files: DataFrame | None = None, source: tuple[str, str] | None = None, keep=None, pending=None, **how) -> dict[str, DataFrame]:
    """All tables of the artifacts below ``root``, or of those of its manifest's rows in ``files``.

    ``source`` is the (name, kind) that sessions and messages are tagged with. ``indexed_sessions`` are those that an index
    names, ``found_sessions`` those that a log or chat shows; ``sessions`` are the former and of the latter those that no index names.
    A log is read from the ``start`` of its row, if it has one. ``keep(name, df)`` stores what several tables are made of and
    returns it as stored: with it each log is read and parsed once, and all tables show the same lines. ``pending(results)`` gives file
    uses of earlier parts of the logs that the results may belong to.
    """
    name, tag = source or (None, None)
    keep = keep or (lambda _, df: df)
    files = scan.manifest(spark, root) if files is None else files
    start = F.coalesce("start", F.lit(0)) if "start" in files.columns else F.lit(0)
    kinds = {r["kind"]: r["bytes"] for r in files.groupBy("kind").agg(F.sum(F.col("size") - start).alias("bytes")).collect()}  # a row for each kind
    of = lambda kind: files.filter(F.col("kind") == kind).dropDuplicates(["path"])
    logs = {kind: keep(f"lines_{kind}", ranges.lines(of(kind), kinds[kind])) for kind in ("session_log", "rollout", "history") if kind in kinds}
    texts = {kind: keep(f"files_{kind}", ranges.whole(of(kind))) for kind in kinds.keys() - {"session_log", "rollout", "history", "tool_result", "todo"}}
    parts = [parse(logs.get(kind, texts.get(kind))) for kind, parse in FORMATS.items() if kind in kinds]
    out: dict[str, DataFrame] = {"manifest": files}
    if "session_log" in logs:
        out["lines"] = logs["session_log"]
    if parts:
        messages, blocks = (keep(what, reduce(DataFrame.unionByName, [p[i] for p in parts])) for i, what in enumerate(("parsed_messages", "parsed_blocks")))
        before = pending(blocks.filter("block_type = 'tool_result'").select("file", "tool_use_id").distinct()) if pending else None
        out |= tables_of(messages, blocks, pending=before, **how)
        out["messages"] = tagged(out["messages"], name, tag)
        declared = []
        if "rollout" in kinds:
            rows = sessions.rollout_sessions(logs["rollout"])
            declared.append(first_wins(rows, ["id"], ["file", "ord"]).drop("ord").withColumnRenamed("file", "source_file"))
        if "chat_session" in kinds:
            rows = sessions.chat_session_rows(texts["chat_session"])
            declared.append(first_wins(rows, ["id"], ["file"]).withColumnRenamed("file", "source_file"))
        stubs = with_columns_of(minimal_sessions(out["messages"]), SESSION)
        if declared:
            declared = reduce(DataFrame.unionByName, [with_columns_of(d, SESSION) for d in declared])
            stubs = declared.unionByName(stubs.join(declared.select("id"), "id", "left_anti"))
        out["found_sessions"] = out["sessions"] = tagged(stubs, name, tag)
    if "session_log" in kinds:
        out["parse_errors"] = sessions.parse_errors(logs["session_log"])
    indexed = [parse(texts[k]) for k, parse in (("session_index", structured.session_index), ("desktop_index", structured.desktop_index)) if k in kinds]
    if indexed:
        named = tagged(with_columns_of(reduce(DataFrame.unionByName, indexed), SESSION), name, tag)
        out["indexed_sessions"] = named = first_wins(named, ["id"], [F.desc("source_file"), F.desc("modified_at")])
        out["sessions"] = named.unionByName(out["sessions"].join(named.select("id"), "id", "left_anti")) if "sessions" in out else named
    tasks = [structured.tasks(texts["task"])] if "task" in kinds else []
    if "rollout" in kinds:
        tasks.append(sessions.rollout_tasks(logs["rollout"]))
    if tasks:
        out["tasks"] = reduce(DataFrame.unionByName, tasks)
        out["task_dependencies"] = structured.dependencies(out["tasks"])
    if "facet" in kinds:
        out["session_outcomes"] = structured.facets(texts["facet"])
    if "stats_cache" in kinds:
        out["daily_stats"], out["model_usage"] = structured.stats_cache(texts["stats_cache"])
    notes = []
    if "plan" in kinds:
        notes.append(structured.plans(texts["plan"]))
    if "history" in kinds:
        first = logs["history"].join(F.broadcast(of("history").agg(F.min("path").alias("file"))), "file", "left_semi")  # one row
        notes.append(structured.history(first))
    if notes:
        out["notes"] = reduce(DataFrame.unionByName, notes).withColumn("hash", content_hash("text"))
    return out
