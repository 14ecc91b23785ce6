"""Counts and breakdowns over sessions, messages, tool calls, blobs and outcomes.

All functions take DataFrames of the session-log model and return a DataFrame; optional
bounds that are None add no predicate. Dates are compared as the strings they are stored as.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def between(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Closed range on a string column; an absent bound adds nothing."""
    bounds = [F.col(column) >= start if start is not None else None, F.col(column) <= end if end is not None else None]
    return reduce(DataFrame.filter, [b for b in bounds if b is not None], df)


def guarded(part: Column, whole: Column, times: float = 1.0) -> Column:
    """part / whole * times, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole * times)


def overview(sessions: DataFrame, messages: DataFrame, blobs: DataFrame) -> DataFrame:
    """One row of totals with the first and last session."""
    s = sessions.agg(F.count("*").alias("total_sessions"), F.min("created_at").alias("first_session"), F.max("modified_at").alias("last_session"))
    m = messages.agg(F.count("*").alias("total_messages"))
    b = blobs.agg(F.count("*").alias("total_blobs"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_blob_bytes"))
    return s.crossJoin(m).crossJoin(b)  # three one-row frames


def daily(events: DataFrame, day: str = "day", start: str | None = None, end: str | None = None, call: Column | None = None) -> DataFrame:
    """Messages, sessions and tool calls of each day, by date; ``call`` tells which rows are calls, else those with a tool."""
    call = F.col("tool_name").isNotNull() if call is None else call
    rows = between(events.withColumn("date", F.col(day).cast("string")), "date", start, end)
    return rows.groupBy("date").agg(
        F.count("*").alias("message_count"),
        F.countDistinct("session_id").alias("session_count"),
        F.count_if(F.coalesce(call, F.lit(False))).alias("tool_call_count"),
    )


def token_totals(usage: DataFrame, model: str, columns: list[str]) -> DataFrame:
    """Sums of the token columns of each model, largest total first; null counts are 0."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns]
    total = reduce(Column.__add__, [F.col(c) for c in columns])
    return usage.groupBy(model).agg(*sums).withColumn("total", total).orderBy(F.desc("total"), model)


def tool_frequency(calls: DataFrame, limit: int = 20, start: str | None = None, end: str | None = None) -> DataFrame:
    """The most used tools; ties by name. The range is applied to the call's timestamp."""
    rows = between(calls, "timestamp", start, end) if start or end else calls
    return rows.groupBy("tool_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tool_name").limit(limit)


def breakdown(sessions: DataFrame, messages: DataFrame, calls: DataFrame, key: Column, name: str, start=None, end=None) -> DataFrame:
    """Sessions, messages and tool calls for each value of ``key`` of a session.

    Messages and calls are counted for each session before they meet the sessions, so nothing
    fans out and only slim counts are shuffled.
    """
    rows = between(sessions, "created_at", start, end).select("id", key.alias(name))
    count = lambda df, n: df.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias(n))
    return (
        rows.join(count(messages, "m"), "id", "left")
        .join(count(calls, "c"), "id", "left")
        .groupBy(name)
        .agg(
            F.count("*").alias("session_count"),
            F.coalesce(F.sum("m"), F.lit(0)).cast("long").alias("message_count"),
            F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("tool_call_count"),
        )
    )


def by_project(sessions: DataFrame, messages: DataFrame, calls: DataFrame, start=None, end=None) -> DataFrame:
    return breakdown(sessions, messages, calls, F.col("project_slug"), "project_slug", start, end)


def by_source_kind(sessions: DataFrame, messages: DataFrame, calls: DataFrame, start=None, end=None) -> DataFrame:
    """As ``by_project``; sessions without a source kind count as 'unknown'."""
    return breakdown(sessions, messages, calls, F.coalesce("source_kind", F.lit("unknown")), "source_kind", start, end)


def day_of(stamp: str) -> Column:
    """UTC date of a time string; null where it is none, as for the empty string."""
    return F.to_date(F.try_to_timestamp(F.col(stamp)))


def daily_projects(sessions: DataFrame, start=None, end=None) -> DataFrame:
    """Sessions of each (date, project); sessions without a readable time share the null date."""
    rows = between(sessions, "created_at", start, end)
    return rows.groupBy(day_of("created_at").alias("date"), "project_slug").agg(F.count("*").alias("session_count"))


def coverage(entries: DataFrame) -> DataFrame:
    """One row: files, bytes and owners, and the share of them that is indexed. entries: size, owner, indexed."""
    done = F.col("indexed")
    totals = entries.agg(
        F.count("*").alias("files"),
        F.count_if(done).alias("indexed_files"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"),
        F.coalesce(F.sum(F.when(done, F.col("size"))), F.lit(0)).cast("long").alias("indexed_bytes"),
        F.countDistinct("owner").alias("owners"),
        F.countDistinct(F.when(done, F.col("owner"))).alias("indexed_owners"),
    )
    for what in ("files", "bytes", "owners"):
        totals = totals.withColumn(f"{what}_percent", F.round(guarded(F.col(f"indexed_{what}"), F.col(what), 100), 6))
    return totals


def coverage_by_kind(paths: DataFrame, path: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Files of each kind: the first rule (LIKE pattern without regard to case, kind) that fits, else 'other'."""
    kind = reduce(lambda c, r: c.when(F.col(path).ilike(r[0]), r[1]), rules, F).otherwise("other")
    return paths.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def outcome_distribution(outcomes: DataFrame) -> DataFrame:
    """Sessions of each stored outcome; null and a literal 'unknown' stay two rows of that name."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n")).select(F.coalesce("outcome", F.lit("unknown")).alias("outcome"), "n")


def failure_reasons(outcomes: DataFrame) -> DataFrame:
    """Reasons of sessions that did not succeed or have no outcome; null joins 'unknown'."""
    failed = outcomes.filter(~F.col("outcome").eqNullSafe("success"))
    return failed.groupBy(F.coalesce("reason_code", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))


def with_shares(counts: DataFrame, n: str = "n") -> DataFrame:
    """Share of the sum and of the largest, for short lists of groups."""
    every = Window.partitionBy()
    return counts.withColumn("share_of_total", F.round(guarded(F.col(n), F.sum(n).over(every)), 9)).withColumn(
        "share_of_max", F.round(guarded(F.col(n), F.max(n).over(every)), 9)
    )


def storage_overview(blobs: DataFrame, references: DataFrame) -> DataFrame:
    """Blobs, bytes, references and the share of references that deduplication saves (may be negative)."""
    b = blobs.agg(F.count("*").alias("blobs"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
    r = references.agg(F.count("*").alias("refs"))
    ratio = F.when(F.col("refs") == 0, F.lit(0.0)).otherwise(1 - F.col("blobs").cast("double") / F.col("refs"))
    return b.crossJoin(r).withColumn("dedup_ratio", F.round(ratio, 9))  # two one-row frames


def storage_by_kind(blobs: DataFrame) -> DataFrame:
    return blobs.groupBy("kind").agg(F.count("*").alias("blobs"), F.sum("size").cast("long").alias("bytes"))


def largest_blobs(blobs: DataFrame, limit: int = 20) -> DataFrame:
    return blobs.orderBy(F.desc("size"), "hash").select("hash", "kind", "size").limit(limit)


def projects_page(sessions: DataFrame, messages: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """Each project with counts, first and last session, distinct files and the path of its latest session."""
    base = sessions.groupBy("project_slug").agg(
        F.min("created_at").alias("first_session"),
        F.max("modified_at").alias("last_session"),
        F.max_by("project_path", F.struct("modified_at", "id")).alias("project_path"),
    )
    slugs = sessions.select(F.col("id").alias("session_id"), "project_slug")
    # distinct (project, file) pairs first: the set of files of one project never meets in one task
    touched = files.join(slugs, "session_id").select("project_slug", "file_path").distinct()
    touched = touched.groupBy("project_slug").agg(F.count("file_path").alias("files_touched"))
    return (
        by_project(sessions, messages, calls)
        .join(base, "project_slug", "left")
        .join(touched, "project_slug", "left")
        .withColumn("files_touched", F.coalesce("files_touched", F.lit(0)))
    )


def top_tools(sessions: DataFrame, calls: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most used tools of each project, ranked, ties by name."""
    counts = (
        calls.join(sessions.select(F.col("id").alias("session_id"), "project_slug"), "session_id")
        .groupBy("project_slug", "tool_name")
        .agg(F.count("*").alias("n"))
    )
    order = Window.partitionBy("project_slug").orderBy(F.desc("n"), "tool_name")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def file_provenance(files: DataFrame, limit: int = 50) -> DataFrame:
    """Files by the number of sessions that touched them, with their operations and the latest session.

    Sessions are counted after the rows of each (file, session) have become one, whose operations are merged for the file
    by their distinct values only: neither step keeps a set that grows with the rows.
    """
    each = files.groupBy("file_path", "session_id").agg(F.sort_array(F.collect_set("operation")).alias("operations"))
    return (
        each.groupBy("file_path", "operations")
        .agg(F.count("session_id").alias("n"), F.max("session_id").alias("last_session"))
        .groupBy("file_path")
        .agg(
            F.sum("n").alias("sessions"),
            F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("operations")))), ",").alias("operations"),
            F.max("last_session").alias("last_session"),
        )
        .orderBy(F.desc("sessions"), "file_path")
        .limit(limit)
    )


def digest_stats(sessions: DataFrame, start: str, end: str, finished: str, open_: str) -> DataFrame:
    """Conditional counts over sessions created in [start, end) by source kind; one row, no row's sum is null."""
    rows = sessions.filter((F.col("created_at") >= start) & (F.col("created_at") < end))
    state = lambda s: F.count_if(F.col("source_kind").eqNullSafe(s))
    return rows.agg(
        F.count("*").alias("sessions"),
        state(finished).alias("finished"),
        state(open_).alias("open"),
        F.count_if(F.col("source_kind").isNull()).alias("unknown"),
        F.coalesce(F.sum("message_count"), F.lit(0)).cast("long").alias("messages"),
    )


def heatmap(days: DataFrame, date: str = "date", n: str = "session_count", full: int = 8) -> DataFrame:
    """Cells of an activity calendar: week (from the first day's, Sunday first), weekday (0 Sunday), intensity up to 1."""
    day = F.to_date(date)
    sunday = F.date_sub(day, F.dayofweek(day) - 1)
    first = days.agg(F.min(sunday).alias("first"))
    return days.crossJoin(F.broadcast(first)).select(  # one row
        date, n, F.floor(F.datediff(sunday, "first") / 7).cast("long").alias("week"), (F.dayofweek(day) - 1).alias("weekday"), F.least(F.col(n) / F.lit(float(full)), F.lit(1.0)).alias("intensity")
    )


def day_projects(sessions: DataFrame) -> DataFrame:
    """(date, projects): the projects of each day's sessions in order, for the cells of the calendar."""
    pairs = daily_projects(sessions).select("date", "project_slug").distinct()
    return pairs.groupBy("date").agg(F.array_sort(F.collect_list("project_slug")).alias("projects"))


def card(rows: DataFrame, slug: str, title: Column, colours: int = 8) -> DataFrame:
    """Colour number (sum of the slug's character codes modulo ``colours``) and title of at most 100 characters."""
    codes = F.transform(F.split(F.col(slug), ""), lambda c: F.ascii(c))
    return rows.select("*", F.pmod(F.aggregate(codes, F.lit(0), lambda a, c: a + c), F.lit(colours)).alias("colour"), F.coalesce(F.substring(title, 1, 100), F.lit("Untitled session")).alias("title"))


def age(stamp: Column, now: Column) -> Column:
    """How long ago a time was: within the hour 'just now', within the day its whole hours, then 'yesterday', from two days on month and day.

    Times yet to come are 'just now'; null is null.
    """
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(stamp.cast("timestamp"))) / 3.6e9
    return (
        F.when(hours < 1, "just now")
        .when(hours < 24, F.concat(F.floor(hours).cast("string"), F.lit("h ago")))
        .when(hours < 48, "yesterday")
        .otherwise(F.date_format(stamp.cast("timestamp"), "MMM d"))
    )


def model_sessions(messages: DataFrame) -> DataFrame:
    """Messages and distinct sessions of each model, most messages first; (model, session) pairs are counted before models are."""
    pairs = messages.filter("model IS NOT NULL").groupBy("model", "session_id").agg(F.count("*").alias("n"))
    return pairs.groupBy("model").agg(F.sum("n").alias("messages"), F.count("session_id").alias("sessions")).orderBy(F.desc("messages"), "model")


def reads_by_extension(calls: DataFrame, inputs: DataFrame, tool: Column) -> DataFrame:
    """Calls of a tool by the extension of the path that their input blob names; 'none' without a path or an extension."""
    rows = calls.filter(tool).join(inputs.select(F.col("hash").alias("input_hash"), "path"), "input_hash", "left")
    found = F.lower(F.regexp_extract(F.coalesce("path", F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    return rows.groupBy(F.when(found == "", "none").otherwise(found).alias("extension")).agg(F.count("*").alias("calls"), F.countDistinct("path").alias("files"))


def outdated(rows: DataFrame, version: str, current: int) -> DataFrame:
    """How many rows were made by no or an earlier version, of how many."""
    old = F.col(version).isNull() | (F.col(version) < current)
    return rows.agg(F.count_if(old).alias("outdated"), F.count("*").alias("total"))


def page_numbers(total: Column, limit: int, offset: int) -> list[Column]:
    """Number of pages, one at least, and of the page at ``offset``, from 1."""
    return [F.greatest(F.lit(1), F.ceil(total / limit)).cast("long").alias("pages"), F.lit(offset // limit + 1).cast("long").alias("page")]


def progress(done: Column, total: Column) -> Column:
    """Percent done, at most 100; 0 of nothing."""
    return F.least(F.lit(100.0), F.round(guarded(done, total, 100), 6))


def marked_cut(text: Column, most: int, mark: str = "\n... (truncated)") -> Column:
    """A text of more than ``most`` characters cut there and marked."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def trailing_start(today: Column, days: int | None) -> Column:
    """The first day of the window of ``days`` days that ends today, as text; null for all time."""
    return F.lit(None).cast("string") if days is None else F.date_sub(today, days).cast("string")


def sizes_by_tool(calls: DataFrame, size: str = "size") -> DataFrame:
    """Calls, bytes and mean bytes of each tool."""
    return calls.groupBy("tool_name").agg(F.count("*").alias("calls"), F.sum(size).cast("long").alias("bytes"), F.round(F.avg(size), 6).alias("avg_bytes"))
