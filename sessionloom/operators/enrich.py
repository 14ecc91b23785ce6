"""Enrichment: session digests, and titles, tags and outcomes from a pluggable backend.

A backend is a function from digest text to a struct of Columns. The one here is a
deterministic heuristic; a model server is called by ``backends.call_all``, whose replies ``enriched_replies`` reads.
Outcomes are learned in ``outcomes``; the key words here are the stand-in where no user has set any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut_bytes, tokens
from . import backends, store
from .warehouse import Warehouse

# The messages that a digest looks at, the texts it takes of them, and the bytes after which it takes no more.
BLOCKS, TEXTS, BYTES = 40, 20, 7500


def digests(messages: DataFrame, order: list[str], cut: int = 500) -> DataFrame:
    """(session_id, digest): the first BLOCKS messages, of those at most TEXTS with a text, each cut to
    ``cut`` bytes, as long as fewer than BYTES bytes came before."""
    by = Window.partitionBy("session_id").orderBy(*order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = messages.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= BLOCKS).filter("content <> ''")
    line = F.concat("type", F.lit(": "), cut_bytes(F.col("content"), cut))
    rows = rows.withColumn("line", line).withColumn("number", F.row_number().over(by)).filter(F.col("number") <= TEXTS)
    rows = rows.withColumn("bytes", F.coalesce(F.sum(F.octet_length("line")).over(before), F.lit(0))).filter(F.col("bytes") < BYTES)
    lines = F.sort_array(F.collect_list(F.struct("number", "line")))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("digest"))


def heuristic(digest: Column) -> Column:
    """Title: the first words; tags: the longest distinct words with a confidence by length; outcome by key words."""
    words = F.array_distinct(tokens(digest))
    longest = F.slice(F.array_sort(F.transform(F.filter(words, lambda w: F.length(w) > 5), lambda w: F.struct((-F.length(w)).alias("o"), w.alias("w")))), 1, 5)
    tags = F.transform(longest, lambda x: F.struct(x["w"].alias("tag"), F.least(F.lit(1.0), -x["o"] / 20.0).alias("confidence")))
    failed = digest.rlike("(?i)error|fail|crash|broken")
    return F.struct(
        cut_bytes(F.regexp_extract(digest, "^[^:\n]*: ([^\n]*)", 1), 60).alias("title"),
        tags.alias("tags"),
        F.when(failed, "failed").otherwise("success").alias("outcome"),
    )


def json_of_reply(text: Column) -> Column:
    """The JSON in a model's reply: what a code fence around all of it holds, else from the first { to the last }, else all."""
    whole = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    fenced = F.regexp_extract(whole, r"(?s)^```(?:json)?(.*)```$", 1)
    braced = F.regexp_extract(whole, r"(?s)(\{.*\})", 1)
    inner = F.regexp_replace(fenced, r"^\s+|\s+$", "")
    return F.when(whole.rlike(r"(?s)^```.*```$") & (F.length(whole) >= 6), inner).when(braced != "", braced).otherwise(whole)


def result_of_output(text: Column) -> Column:
    """The reply in a command's JSON lines: the text 'result' of the first line of type 'result', else that of the whole as one object, else all."""
    get = lambda v, path: F.try_variant_get(v, path, "string")
    told = F.transform(F.split(text, r"\r?\n"), lambda line: F.try_parse_json(line))
    found = F.transform(F.filter(told, lambda v: (get(v, "$.type") == "result") & _text(v)), lambda v: get(v, "$.result"))
    whole = F.try_parse_json(text)
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.when(_text(whole), get(whole, "$.result")), text)


def _text(v: Column) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, "$.result", "variant")) == "STRING"


def enrich(rows: DataFrame, backend=heuristic, approve_at: float = 0.8) -> DataFrame:
    """Title, outcome, tags and approval of each digest: approved iff there are tags and all reach ``approve_at``."""
    out = rows.withColumn("e", backend(F.col("digest"))).select("session_id", "e.*")
    sure = (F.size("tags") > 0) & F.forall("tags", lambda t: t["confidence"] >= approve_at)
    return out.withColumn("approval_status", F.when(sure, "approved").otherwise("pending_review"))


def enriched_replies(replies: DataFrame, approve_at: float = 0.8) -> DataFrame:
    """What ``enrich`` gives, of the replies (session_id, reply) of a backend: JSON with title, outcome and tags, maybe within other text.

    Failed calls, and replies that hold no such JSON, are left out: their sessions stay candidates.
    """
    shape = "title STRING, tags ARRAY<STRUCT<tag STRING, confidence DOUBLE>>, outcome STRING"
    rows = replies.filter("reply IS NOT NULL").withColumn("e", F.from_json(json_of_reply(result_of_output(F.col("reply"))), shape)).filter("e.title IS NOT NULL")
    out = rows.select("session_id", "e.title", F.coalesce("e.tags", F.array().cast("array<struct<tag:string,confidence:double>>")).alias("tags"), "e.outcome")
    sure = (F.size("tags") > 0) & F.forall("tags", lambda t: F.coalesce(t["confidence"] >= approve_at, F.lit(False)))
    return out.withColumn("approval_status", F.when(sure, "approved").otherwise("pending_review"))


#: The version of what an enrichment holds.
VERSION = 1


def enrich_sessions(house: Warehouse, backend: backends.Backend | None, model: str, now: str, approve_at: float = 0.8, limit: int | None = None, version: int = VERSION, **how) -> dict:
    """Enrich the sessions of a warehouse that have no enrichment of this version, latest first; without a backend by ``heuristic``.

    Stored are title, approval and tags, the tags with their session, so a new enrichment replaces all old tags. Returns the numbers of
    candidates, of those enriched, of those skipped as they have no digest, and of those that failed; the latter two stay candidates.
    """
    messages, sessions, stored = house.table("messages"), house.table("sessions"), house.table("session_enrichments")
    if messages is None or sessions is None:
        return dict.fromkeys(("total_candidates", "enriched", "skipped", "failed"), 0)
    wanted = sessions if stored is None else sessions.join(stored.filter(F.col("version") >= version).select(F.col("session_id").alias("id")), "id", "left_anti")
    wanted = wanted.orderBy(F.desc("modified_at"), "id").select(F.col("id").alias("session_id"))
    wanted = wanted if limit is None else wanted.limit(limit)
    rows = digests(messages, ["turn_index", "timestamp", "id"]).join(wanted, "session_id", "left_semi")
    done = enrich(rows, approve_at=approve_at) if backend is None else enriched_replies(backends.call_all(rows, backend, model, **how), approve_at)
    with house.staged(done) as done:
        found, tags = store.stored_enrichments(done, model, now, version)
        tags = tags.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("tag", "confidence"))).alias("tags"))
        none = F.array().cast("array<struct<tag:string,confidence:double>>")
        house.commit({"session_enrichments": found.join(tags, "session_id", "left").withColumn("tags", F.coalesce("tags", none))})
        counts = {"total_candidates": wanted.count(), "enriched": done.count()}
    asked = rows.count()
    return counts | {"skipped": counts["total_candidates"] - asked, "failed": asked - counts["enriched"]}


def candidates(sessions: DataFrame, outcomes: DataFrame, limit: int | None = None) -> DataFrame:
    """Sessions to classify, latest first: without an outcome, or with one that no user has set."""
    known = outcomes.filter("is_user_labeled").select(F.col("session_id").alias("id"))
    rows = sessions.join(known, "id", "left_anti").orderBy(F.desc("modified_at"), "id")
    return rows if limit is None else rows.limit(limit)


def classify(rows: DataFrame, backend=heuristic) -> DataFrame:
    """(session_id, outcome, reason_code) of digests; a failure without a known reason is 'unknown'."""
    digest = F.col("digest")
    reason = (
        F.when(digest.rlike("(?i)cannot reproduce|no repro"), "repro_missing")
        .when(digest.rlike("(?i)dependency|version conflict|install"), "dependency_trap")
        .when(digest.rlike("(?i)tool|command not found"), "tool_misuse")
        .otherwise("unknown")
    )
    out = rows.withColumn("outcome", backend(digest)["outcome"])
    return out.select("session_id", "outcome", F.when(F.col("outcome") != "success", reason).alias("reason_code"))


def digest_rows(weeks: DataFrame, start: str, end: str, now: str) -> DataFrame:
    """What ``weekly`` gives as a row to append to the table of digests."""
    return weeks.select(F.lit(start).alias("start_date"), F.lit(end).alias("end_date"), F.lit(now).alias("created_at"), "*")


def weekly(sessions: DataFrame, outcomes: DataFrame, start: str, end: str, limit: int = 50) -> DataFrame:
    """One row: counts of the sessions created in [start, end) by outcome, and a text of the first ``limit`` of them.

    No row if there is no session.
    """
    rows = sessions.filter((F.col("created_at") >= start) & (F.col("created_at") < end)).join(outcomes.select(F.col("session_id").alias("id"), "outcome", "reason_code"), "id", "left")
    kinds = ("success", "failed", "partial", "abandoned")
    stats = rows.agg(F.count("*").alias("session_count"), *[F.count_if(F.coalesce(F.col("outcome") == k, F.lit(False))).alias(f"{k}_count") for k in kinds], F.coalesce(F.sum("message_count"), F.lit(0)).cast("long").alias("message_count"))
    line = F.concat("project_slug", F.lit(" "), F.col("id").cast("string"), F.lit(": "), F.coalesce("outcome", F.lit("unlabeled")), F.coalesce(F.concat(F.lit(" ("), "reason_code", F.lit(")")), F.lit("")))
    first = rows.orderBy("created_at", "id").limit(limit)
    text = first.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("created_at", "id", line.alias("line")))), lambda x: x["line"]), "\n").alias("content"))
    return stats.crossJoin(text).filter("session_count > 0")  # two one-row frames
