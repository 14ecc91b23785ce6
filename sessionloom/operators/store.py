"""Content store semantics: hashes, first-wins and last-wins writes, fingerprints, redaction, change detection."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The patterns of secrets that are replaced, in this order.
SECRETS = [
    r"sk-[a-zA-Z0-9]{48}",
    r"xox[bapts]-[a-zA-Z0-9-]{10,}",
    r"ghp_[a-zA-Z0-9]{36}",
    r"(?:https?://)[a-zA-Z0-9]{20,}:[a-zA-Z0-9]{20,}@",
    r"AIza[0-9A-Za-z-_]{35}",
]
REDACTED = "[REDACTED]"
#: Texts of at least this many bytes are worth deduplicating.
DEDUP_BYTES = 256


def content_hash(text: Column | str) -> Column:
    return F.sha2(text, 256)


def worth_dedup(text: Column | str) -> Column:
    return F.octet_length(text) >= DEDUP_BYTES


def redacted(text: Column | str, extra: list[str] = ()) -> Column:
    """Secrets replaced one pattern after the other; an extra pattern that is no regular expression is skipped."""
    patterns = list(SECRETS)
    for pattern in extra:
        try:
            re.compile(pattern)
            patterns.append(pattern)
        except re.error:
            continue
    return reduce(lambda c, p: F.regexp_replace(c, p, REDACTED), patterns, F.col(text) if isinstance(text, str) else text)


def first_wins(new: DataFrame, keys: list[str], order: list[str], old: DataFrame | None = None) -> DataFrame:
    """Insert-or-ignore: rows of ``new`` whose key is not stored, the first of each key by ``order``."""
    rows = new if old is None else new.join(old.select(*keys).distinct(), keys, "left_anti")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def last_wins(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert-or-replace: the last new row of each key, whole, and the stored rows no new one replaces."""
    latest = first_wins(new, keys, [F.desc(c) for c in order])
    kept = old.join(latest.select(*keys), keys, "left_anti")
    return kept.unionByName(latest.select(*old.columns))


def link_outputs(uses: DataFrame, results: DataFrame, key: str, output: str, order: str) -> DataFrame:
    """Tool uses with the output that the last result in order gave their id; unknown ids are ignored."""
    last = results.groupBy(key).agg(F.max_by(output, order).alias(output))
    return uses.drop(output).join(last, key, "left")


def match_first_result(uses: DataFrame, results: DataFrame, keys: list[str], bucket: int = 3600) -> DataFrame:
    """Each use with the first later result of the same keys (by sec); uses without one are left out.

    Both sides are one log, cut into buckets of ``bucket`` seconds: within one, a running minimum from its end finds the next result; a use with
    none takes the first result of the next bucket that has any. So a busy key is as many groups as it has buckets, each sorted once.
    """
    some = F.struct(F.col("sec"), F.col("id"))
    none = F.lit(None).cast(uses.select(some.alias("r")).schema["r"].dataType)
    log = uses.select(*keys, "id", "sec", none.alias("r")).unionByName(results.select(*keys, "id", "sec", some.alias("r")))
    log = log.withColumn("bucket", F.floor(F.col("sec") / bucket))
    same = F.min("r").over(Window.partitionBy(*keys, "bucket").orderBy(F.desc("sec")).rangeBetween(Window.unboundedPreceding, -1))
    found = log.withColumn("same", same).filter("r IS NULL").drop("r")
    of_bucket = log.groupBy(*keys, "bucket").agg(F.min("r").alias("first"))
    after = F.min("first").over(Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1))
    later = of_bucket.withColumn("after", after).filter("after IS NOT NULL").drop("first")
    found = found.join(later, [*keys, "bucket"], "left").withColumn("next", F.coalesce("same", "after")).filter("next IS NOT NULL")
    return found.select(*keys, "id", F.col("next.id").alias("result_id"), F.col("next.sec").alias("result_sec"))


def consumed_uses(log: DataFrame, keys: list[str], order: list[str], is_use: Column) -> DataFrame:
    """Results that consume a use, of one log of both: a result takes the row before it if that is a use.

    A use that follows another replaces it, and a result behind a result finds nothing, so each use is taken once, by the first
    later result. Returns keys, use_id, result_id. The streaming form is ``streaming.consume``.
    """
    sorted_log = Window.partitionBy(*keys).orderBy(*order)
    rows = log.withColumn("_use", is_use)
    rows = rows.withColumn("use_id", F.lag(F.when(F.col("_use"), F.col("id"))).over(sorted_log))
    return rows.filter(~F.col("_use") & F.col("use_id").isNotNull()).select(*keys, "use_id", F.col("id").alias("result_id"))


def message_fingerprint(kind: Column, timestamp: Column, parts: Column) -> Column:
    return F.sha2(F.concat(kind, timestamp, F.array_join(parts, "")), 256)


def session_fingerprint(messages: DataFrame, order: list[str], fingerprint: str = "fingerprint") -> DataFrame:
    """Hash of a session's message fingerprints in order, nulls dropped: a Merkle node over its messages."""
    ordered = F.sort_array(F.collect_list(F.struct(*order, F.col(fingerprint).alias("fp"))))
    kept = F.filter(F.transform(ordered, lambda m: m["fp"]), lambda x: x.isNotNull())
    return messages.groupBy("session_id").agg(F.sha2(F.array_join(kept, ""), 256).alias("fingerprint"))


def changes(now: DataFrame, known: DataFrame) -> DataFrame:
    """Status of each file (path, mtime, size) against what was indexed (path, mtime, size, offset).

    Unchanged only if time and size both are; a modified file resumes at its stored offset.
    """
    before = known.select("path", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), "offset")
    same = (F.col("mtime") == F.col("old_mtime")) & (F.col("size") == F.col("old_size"))
    status = F.when(F.col("old_mtime").isNull(), "new").when(same, "unchanged").otherwise("modified")
    start = F.when(status == "modified", F.col("offset")).otherwise(F.lit(0).cast("long"))
    return now.join(before, "path", "left").select("path", status.alias("status"), start.alias("start"))


def deleted(now: DataFrame, known: DataFrame) -> DataFrame:
    return known.select("path").join(now.select("path"), "path", "left_anti")


def backfilled(blobs: DataFrame) -> DataFrame:
    """Sizes of 0 replaced by the content's bytes."""
    return blobs.withColumn("size", F.when(F.col("size") == 0, F.octet_length("content").cast("long")).otherwise(F.col("size")))


def auto_approved(tags: DataFrame, least: float) -> DataFrame:
    """(session_id, approval_status) of tagged sessions: approved if all tags reach ``least``, else pending."""
    worst = tags.groupBy("session_id").agg(F.min("confidence").alias("worst"))
    return worst.select("session_id", F.when(F.col("worst") >= least, "approved").otherwise("pending_review").alias("approval_status"))


def reviewed(enrichments: DataFrame, ids: DataFrame | None, verdict: str) -> DataFrame:
    """Pending enrichments (all, or those of ``ids``) get the verdict; others stay as they are."""
    rows = enrichments if ids is None else enrichments.join(ids.select("session_id", F.lit(True).alias("_hit")).distinct(), "session_id", "left")
    hit = F.col("approval_status") == "pending_review"
    if ids is not None:
        hit = hit & F.coalesce("_hit", F.lit(False))
    out = rows.withColumn("approval_status", F.when(hit, verdict).otherwise(F.col("approval_status")))
    return out if ids is None else out.drop("_hit")


def stored_enrichments(enriched: DataFrame, model: str, now: str, version: int) -> tuple[DataFrame, DataFrame]:
    """Rows of enrichments and of their tags, as they are stored, of enriched sessions (title, tags, approval_status).

    What is approved at once is reviewed at once; a tag that a session has twice keeps its highest confidence.
    """
    done = F.when(F.col("approval_status") == "approved", F.lit(now))
    rows = enriched.select("session_id", "title", F.lit(now).alias("enriched_at"), F.lit(model).alias("model"), F.lit(version).alias("version"), "approval_status", done.alias("reviewed_at"))
    tags = enriched.select("session_id", F.explode("tags").alias("t")).groupBy("session_id", F.col("t.tag").alias("tag")).agg(F.max("t.confidence").alias("confidence"))
    return rows, tags


def retagged(tags: DataFrame, new: DataFrame, sessions: DataFrame) -> DataFrame:
    """Stored tags after the enrichment of ``sessions``: all their old tags go, also where there is no new one."""
    return tags.join(sessions.select("session_id").distinct(), "session_id", "left_anti").unionByName(new.select(*tags.columns))


def labelled(outcomes: DataFrame, labels: DataFrame, by_user: bool) -> DataFrame:
    """Outcomes (session_id, outcome, reason_code, is_user_labeled) in which the labelled sessions have their new ones.

    Of labels that repeat a session the last by (outcome, reason) counts, nulls first.
    """
    new = labels.select("session_id", "outcome", "reason_code", F.lit(by_user).alias("is_user_labeled"))
    return last_wins(outcomes, new, ["session_id"], ["outcome", "reason_code"])


def newest(rows: DataFrame, stamp: str, key: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of runs, digests or backups, latest first."""
    return rows.orderBy(F.desc(stamp), key).offset(offset).limit(limit)


def expired(backups: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    """Backups older than ``days`` by their 'yyyy-MM-dd HH:mm:ss' stamp; none where days is 0."""
    if days <= 0:
        return backups.limit(0)
    bound = F.date_format((F.current_timestamp() if now is None else now) - F.make_dt_interval(F.lit(days)), "yyyy-MM-dd HH:mm:ss")
    return backups.filter(F.col("backed_up_at") < bound)
