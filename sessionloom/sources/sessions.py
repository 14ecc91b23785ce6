"""Parsing session logs of three formats into messages and blocks, with built-in functions only.

Each parser returns two DataFrames. Messages: one row each, with the text that its fingerprint
is taken over. Blocks: (file, ord, session_id, message_id, timestamp, block_index, block_type,
kind, text, context, searchable, tool_name, tool_use_id, input, path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import last_segment, pretty_json

MESSAGE = ["file", "ord", "id", "session_id", "parent_id", "type", "timestamp", "model", "stop_reason", "cwd", "git_branch", "duration_ms", "turn_index", "digest_parts"]
BLOCK = ["file", "ord", "session_id", "message_id", "timestamp", "block_index", "block_type", "kind", "text", "context", "searchable", "tool_name", "tool_use_id", "input", "path"]
#: Characters of a project's hash that name it.
SLUG = 8
#: Tools whose result is the content of the file that they name.
FILE_TOOLS = {"Read": "read", "Write": "write", "Edit": "edit", "MultiEdit": "edit"}
# Lines that hold one of these are dropped before they are parsed.
SKIPPED = ['"type":"progress"', '"type": "progress"', '"type":"queue-operation"', '"type": "queue-operation"']
TYPES = ["user", "assistant", "system", "summary", "progress", "file-history-snapshot", "queue-operation"]
BLOCK_TYPES = ["text", "tool_use", "tool_result", "thinking"]


def lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, ord, value) of non-blank lines; ord orders the lines of a file, however it is split."""
    order = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), order.alias("ord"), "value")
    return rows.filter(F.col("value").rlike(r"\S"))


def stem(file: Column) -> Column:
    return F.regexp_replace(last_segment(file), r"\.[^.]*$", "")


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _text(v: Column) -> Column:
    """A variant's string; null if it is anything else."""
    return F.when(_is(v, "STRING"), v.cast("string"))


def _list(v: Column) -> Column:
    return F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def _block(index, block_type, kind, text, context, searchable, tool_name=None, tool_use_id=None, input=None, path=None) -> Column:
    col = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(
        (index if isinstance(index, Column) else F.lit(index)).cast("long").alias("block_index"), col(block_type).alias("block_type"), col(kind).alias("kind"), text.alias("text"), col(context).alias("context"),
        (searchable if isinstance(searchable, Column) else F.lit(searchable)).alias("searchable"), col(tool_name).alias("tool_name"), col(tool_use_id).alias("tool_use_id"), col(input).alias("input"), col(path).alias("path"),
    )


def _block_part(b: Column) -> Column:
    """What a block adds to its message's digest: its content's hash, or its tool's fingerprint."""
    tool = F.sha2(F.concat(b["tool_name"], F.sha2(b["input"], 256)), 256)
    return F.when(b["block_type"] == "tool_use", tool).otherwise(F.sha2(b["text"], 256))


def parsed_lines(rows: DataFrame) -> DataFrame:
    """Adds v, type and bad (no JSON, or an unknown type); skippable lines are dropped unparsed."""
    keep = rows
    for mark in SKIPPED:
        keep = keep.filter(~F.contains("value", F.lit(mark)))
    keep = keep.withColumn("v", F.try_parse_json("value")).withColumn("type", _get(F.col("v"), "$.type"))
    return keep.withColumn("bad", ~F.coalesce(F.col("type").isin(TYPES), F.lit(False)))


def session_logs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Logs of one JSON object a line: user and assistant turns, system notes, summaries.

    Content is a string or a list of blocks. Progress, queue and snapshot lines are dropped, and
    so are lines that do not parse (``parse_errors`` counts them). A summary belongs to the
    session that its file is named after.
    """
    v, kind = F.col("v"), F.col("type")
    good = parsed_lines(rows).filter("NOT bad").filter(kind.isin("user", "assistant", "system", "summary"))
    content = F.try_variant_get(v, "$.message.content", "variant")
    text_kind = F.when(kind == "user", "user_text").otherwise("text")
    whole_context = F.when(kind == "user", "user_prompt").otherwise("response_text")
    list_context = F.when(kind == "assistant", "response_text")

    def one(b, i):
        bt = _get(b, "$.type")
        body = F.try_variant_get(b, "$.content", "variant")
        tool_input = F.try_variant_get(b, "$.input", "variant")
        assistant = kind == "assistant"
        return (
            F.when(bt == "text", _block(i, "text", text_kind, _get(b, "$.text"), list_context, True))
            .when((bt == "tool_use") & assistant, _block(i, "tool_use", "tool_input", F.lit(None).cast("string"), None, False, _get(b, "$.name"), _get(b, "$.id"), F.to_json(tool_input), _text(F.try_variant_get(b, "$.input.file_path", "variant"))))
            .when((bt == "thinking") & assistant, _block(i, "thinking", "thinking", _get(b, "$.thinking"), None, False))
            .when((bt == "tool_result") & (kind == "user"), _block(i, "tool_result", "tool_output", F.coalesce(F.to_json(body), F.lit("null")), "tool_result", True, None, _get(b, "$.tool_use_id")))
        )

    turn = F.when(_is(content, "STRING"), F.array(_block(0, "text", text_kind, content.cast("string"), whole_context, True))).otherwise(
        F.filter(F.transform(_list(content), one), lambda b: b.isNotNull())
    )
    note = F.when(_get(v, "$.content").isNotNull(), F.array(_block(0, "text", "system", _get(v, "$.content"), None, True)))
    summary = F.array(_block(0, "text", "summary", _get(v, "$.summary"), "summary", True))
    rows = good.withColumn("blocks", F.when(kind == "system", note).when(kind == "summary", summary).otherwise(turn))
    is_summary = kind == "summary"
    rows = rows.select(
        "file", "ord", "type", "blocks",
        F.when(is_summary, F.concat(F.lit("summary-"), F.coalesce(_get(v, "$.leafUuid"), F.lit("unknown")))).otherwise(_get(v, "$.uuid")).alias("id"),
        F.when(is_summary, stem(F.col("file"))).otherwise(_get(v, "$.sessionId")).alias("session_id"),
        F.when(kind.isin("user", "assistant"), _get(v, "$.parentUuid")).alias("parent_id"),
        F.when(is_summary, "").otherwise(_get(v, "$.timestamp")).alias("timestamp"),
        F.when(kind == "assistant", _get(v, "$.message.model")).alias("model"),
        F.when(kind == "assistant", _get(v, "$.message.stop_reason")).alias("stop_reason"),
        _get(v, "$.cwd").alias("cwd"),
        _get(v, "$.gitBranch").alias("git_branch"),
        _get(v, "$.durationMs", "long").alias("duration_ms"),
        F.lit(None).cast("int").alias("turn_index"),
        F.coalesce(_get(v, "$.summary"), F.lit("")).alias("summary"),
    ).filter("id IS NOT NULL AND session_id IS NOT NULL")
    parts = F.array_join(F.transform(F.coalesce("blocks", F.array().cast(rows.schema["blocks"].dataType)), _block_part), "")
    rows = rows.withColumn("digest_parts", F.when(F.col("type") == "summary", F.col("summary")).otherwise(F.concat("timestamp", parts)))
    return rows.select(*MESSAGE), _exploded(rows)


def _exploded(rows: DataFrame) -> DataFrame:
    blocks = rows.select("file", "ord", "session_id", F.col("id").alias("message_id"), "timestamp", F.explode("blocks").alias("b"))
    return blocks.select("file", "ord", "session_id", "message_id", "timestamp", "b.*")


def parse_errors(rows: DataFrame) -> DataFrame:
    """(file, parse_errors): lines that are no JSON object of a known type, or hold an unknown block."""
    content = F.try_variant_get(F.col("v"), "$.message.content", "variant")
    strange = F.exists(_list(content), lambda b: ~F.coalesce(_get(b, "$.type").isin(BLOCK_TYPES), F.lit(False)))
    bad = F.col("bad") | F.coalesce(strange, F.lit(False))
    return parsed_lines(rows).groupBy("file").agg(F.count_if(bad).alias("parse_errors"))


def chat_sessions(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole-file JSON chats (file, value): messages with text or parts, thoughts and tool calls."""
    v = F.try_parse_json("value")
    rows = files.withColumn("v", v).filter("v IS NOT NULL").select("file", _get(F.col("v"), "$.sessionId").alias("session_id"), F.posexplode(F.try_variant_get("v", "$.messages", "array<variant>")).alias("turn", "m"))
    m = F.col("m")
    content = F.try_variant_get(m, "$.content", "variant")
    text = F.when(_is(content, "STRING"), content.cast("string")).otherwise(F.array_join(F.filter(F.transform(_list(content), lambda p: _get(p, "$.text")), lambda t: t.isNotNull()), ""))
    empty = F.array().cast("array<variant>")
    thoughts = F.coalesce(F.try_variant_get(m, "$.thoughts", "array<variant>"), empty)
    calls = F.coalesce(F.try_variant_get(m, "$.toolCalls", "array<variant>"), empty)
    said = F.when(F.coalesce(text, F.lit("")) != "", F.array(_block(0, "text", "text", text, "response_text", True)))
    thought = F.transform(thoughts, lambda t, i: _block(i + 1, "thinking", "thinking", F.to_json(t), "thinking", False))
    used = F.transform(calls, lambda c, i: _block(i + 1000, "tool_use", "tool_input", F.lit(None).cast("string"), None, False, _get(c, "$.name"), _get(c, "$.id"), F.coalesce(F.to_json(F.try_variant_get(c, "$.args", "variant")), F.lit("null"))))
    given = F.filter(F.transform(calls, lambda c: F.when(F.try_variant_get(c, "$.result", "variant").isNotNull(), _block(F.lit(-1), "tool_output", "tool_output", F.to_json(F.try_variant_get(c, "$.result", "variant")), None, False, None, _get(c, "$.id")))), lambda b: b.isNotNull())
    rows = rows.withColumn("blocks", F.concat(F.coalesce(said, F.array().cast("array<" + _BLOCK_TYPE + ">")), thought, used, given))
    output = lambda b: F.array_max(F.transform(F.filter("blocks", lambda o: (o["block_type"] == "tool_output") & (o["tool_use_id"] == b["tool_use_id"])), lambda o: F.sha2(o["text"], 256)))
    part = lambda b: F.when(b["block_type"] == "thinking", F.sha2(b["text"], 256)).when(b["block_type"] == "tool_use", F.sha2(F.concat(b["tool_name"], F.sha2(b["input"], 256), F.coalesce(output(b), F.lit(""))), 256)).otherwise(F.lit(""))
    none = F.lit(None).cast("string")
    rows = rows.select(
        "file", F.struct(F.lit(0).cast("long").alias("block"), F.col("turn").cast("long").alias("n")).alias("ord"), _get(m, "$.id").alias("id"), "session_id", none.alias("parent_id"), _get(m, "$.type").alias("type"),
        _get(m, "$.timestamp").alias("timestamp"), _get(m, "$.model").alias("model"), none.alias("stop_reason"), none.alias("cwd"), none.alias("git_branch"), F.lit(None).cast("long").alias("duration_ms"),
        F.col("turn").alias("turn_index"), F.concat(_get(m, "$.timestamp"), F.coalesce(text, F.lit("")), F.array_join(F.transform("blocks", part), "")).alias("digest_parts"), "blocks",
    )
    return rows.select(*MESSAGE), _exploded(rows)


_BLOCK_TYPE = (
    "struct<block_index:bigint,block_type:string,kind:string,text:string,context:string,searchable:boolean,tool_name:string,tool_use_id:string,input:string,path:string>"
)


def rollouts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rollout logs of one JSON object a line. Lines before a file's session_meta are dropped.

    Tool calls belong to the last assistant message before them, responses to the last user
    message; before any message the parent is ``<session>-init``. Files are independent, so the
    windows run within a file.
    """
    v = F.col("v")
    order = Window.partitionBy("file").orderBy("ord")
    sofar, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("v", F.try_parse_json("value")).withColumn("kind", _get(v, "$.type")).withColumn("timestamp", _get(v, "$.timestamp"))
    rows = rows.withColumn("session_id", F.last(F.when(F.col("kind") == "session_meta", _get(v, "$.payload.id")), ignorenulls=True).over(sofar)).filter("session_id IS NOT NULL")
    answer, asked = F.col("kind").isin("response_item", "final"), F.col("kind").isin("request_item", "commentary")
    rows = rows.withColumn("turn_index", F.sum(F.when(answer | asked, 1).otherwise(0)).over(sofar).cast("int") - 1)
    ident = F.concat("session_id", F.lit("-"), F.col("turn_index").cast("string"))
    init = F.concat("session_id", F.lit("-init"))
    rows = rows.withColumn("id", F.when(answer | asked, ident))
    rows = rows.withColumn("answered", F.coalesce(F.last(F.when(answer, F.col("id")), ignorenulls=True).over(before), init)).withColumn("asked", F.coalesce(F.last(F.when(asked, F.col("id")), ignorenulls=True).over(before), init))
    content = F.try_variant_get(v, "$.payload.content", "variant")
    text = F.when(_is(content, "STRING"), content.cast("string")).otherwise(F.array_join(F.filter(F.transform(_list(content), lambda p: _text(F.try_variant_get(p, "$.text", "variant"))), lambda t: t.isNotNull()), ""))
    text = F.coalesce(text, F.lit(""))
    plan = F.try_variant_get(v, "$.payload.plan", "variant")
    rows = rows.withColumn("pretty", pretty_json(F.when((F.col("kind") == "plan_update") & ~_is(plan, "STRING"), F.to_json(plan))))
    use, result = _get(v, "$.payload.id"), _get(v, "$.payload.toolUseId")
    none = F.lit(None).cast("string")
    block = (
        F.when(F.col("id").isNotNull() & (text != ""), _block(0, "text", "text", text, "text", True))
        .when(F.col("kind") == "tool_call", _block(F.ascii(use) + 1000, "tool_use", "tool_input", none, None, False, _get(v, "$.payload.name"), use, F.coalesce(F.to_json(F.try_variant_get(v, "$.payload.input", "variant")), F.lit("null"))))
        .when(F.col("kind") == "tool_response", _block(F.ascii(result) + 2000, "tool_result", "tool_output", F.coalesce(F.to_json(content), F.lit("null")), None, False, None, result))
        .when((F.col("kind") == "plan_update") & plan.isNotNull(), _block(-1, "plan", "plan", F.when(_is(plan, "STRING"), plan.cast("string")).otherwise(F.col("pretty")), None, True))
    )
    rows = rows.withColumn("block", block).withColumn("text", text)
    messages = rows.filter("id IS NOT NULL").select(
        "file", "ord", "id", "session_id", none.alias("parent_id"), F.when(answer, "assistant").otherwise("user").alias("type"), "timestamp", none.alias("model"), none.alias("stop_reason"), none.alias("cwd"),
        none.alias("git_branch"), F.lit(None).cast("long").alias("duration_ms"), "turn_index", F.concat("timestamp", "text").alias("digest_parts"),
    )
    owner = F.when(F.col("kind") == "tool_call", F.col("answered")).when(F.col("kind") == "tool_response", F.col("asked")).otherwise(F.col("id"))
    blocks = rows.filter("block IS NOT NULL").select("file", "ord", "session_id", owner.alias("message_id"), "timestamp", "block.*")
    return messages, blocks


def rollout_sessions(rows: DataFrame) -> DataFrame:
    """Sessions that rollout files declare, a row for each declaration: id, path, slug, times and version; a path that is not given is 'unknown'."""
    v = F.try_parse_json("value")
    rows = rows.withColumn("v", v).filter(_get(F.col("v"), "$.type") == "session_meta")
    get = lambda p: _get(F.col("v"), f"$.payload.{p}")
    path = F.coalesce(get("cwd"), F.lit("unknown"))
    return rows.filter(get("id").isNotNull()).select(
        "file", "ord", get("id").alias("id"), path.alias("project_path"), last_segment(path).alias("project_slug"), get("timestamp").alias("created_at"), get("timestamp").alias("modified_at"), get("cli_version").alias("app_version")
    )


def chat_session_rows(files: DataFrame) -> DataFrame:
    """The session of each whole-file chat: its project's hash is the path, whose first SLUG characters are the slug."""
    v = F.try_parse_json("value")
    get = lambda p: _get(F.col("v"), f"$.{p}")
    path = F.coalesce(get("projectHash"), F.lit("unknown"))
    return files.withColumn("v", v).filter(get("sessionId").isNotNull()).select(
        "file", get("sessionId").alias("id"), path.alias("project_path"), F.substring(path, 1, SLUG).alias("project_slug"), get("startTime").alias("created_at"), get("lastUpdated").alias("modified_at")
    )


def rollout_tasks(rows: DataFrame) -> DataFrame:
    """Task updates of rollout files, the last of each task; dependencies as an array."""
    v = F.col("v")
    order = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("v", F.try_parse_json("value")).withColumn("kind", _get(v, "$.type"))
    rows = rows.withColumn("session_id", F.last(F.when(F.col("kind") == "session_meta", _get(v, "$.payload.id")), ignorenulls=True).over(order)).filter("kind = 'task_update' AND session_id IS NOT NULL")
    get = lambda p, t="string": _get(v, f"$.payload.{p}", t)
    task = F.struct("file", "ord", get("subject").alias("subject"), get("description").alias("description"), get("activeForm").alias("active_form"), get("status").alias("status"), get("blockedBy", "array<string>").alias("blocked_by"))
    last = rows.groupBy("session_id", get("id").alias("id")).agg(F.max_by(task, F.struct("file", "ord")).alias("t"))
    return last.select("session_id", "id", "t.subject", "t.description", "t.active_form", "t.status", F.coalesce("t.blocked_by", F.array().cast("array<string>")).alias("blocked_by"))
