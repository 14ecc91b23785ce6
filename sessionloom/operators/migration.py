"""Bringing a warehouse of earlier runs up to date: fingerprints that are missing or old, and sessions without a backup.

What is to do follows from the tables alone, so a migration that was stopped, or whose executors were lost, goes on
with what is left when it is called again, and one that has nothing to do writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import remove
from ..sources import ranges
from .store import session_fingerprint
from .warehouse import Warehouse, backup, contents, run_name

# Sources whose files the first version did not copy, by kind and by folder.
COPIED_KINDS = ("gemini", "codex")
COPIED_FOLDERS = r"\.(gemini|codex)"
#: Sessions that one step takes.
CHUNK = 100_000


def copied(sessions: DataFrame) -> Column:
    """Whether a migration backs up a session's file."""
    kind = F.coalesce(F.col("source_kind").isin(*COPIED_KINDS), F.lit(False)) if "source_kind" in sessions.columns else F.lit(False)
    return F.col("source_file").isNotNull() & (kind | F.col("source_file").rlike(COPIED_FOLDERS))


def unprinted(house: Warehouse) -> DataFrame:
    """(session_id, fingerprint) of sessions whose stored fingerprint is missing or is not that of their messages."""
    messages, stored = house.table("messages"), house.table("fingerprints")
    if messages is None:
        return house.spark.createDataFrame([], "session_id STRING, fingerprint STRING")
    now = session_fingerprint(messages, ["timestamp", "turn_index", "id"])
    return now if stored is None else now.join(stored.select("session_id", "fingerprint"), ["session_id", "fingerprint"], "left_anti")


def unsaved(house: Warehouse) -> DataFrame:
    """(id, source_file) of sessions without a backup, by their id or their file."""
    sessions, stored = house.table("sessions"), house.table("session_backups")
    if sessions is None:
        return house.spark.createDataFrame([], "id STRING, source_file STRING")
    rows = sessions.filter(copied(sessions)).select("id", "source_file")
    if stored is None:
        return rows
    rows = rows.join(stored.select(F.col("session_id").alias("id")).distinct(), "id", "left_anti")
    return rows.join(stored.select(F.col("original_path").alias("source_file")).distinct(), "source_file", "left_anti")


def pending(house: Warehouse) -> DataFrame:
    """One row: sessions whose fingerprint is to be made anew, and sessions whose file is to be copied."""
    return unprinted(house).agg(F.count("*").alias("fingerprints")).crossJoin(unsaved(house).agg(F.count("*").alias("backups")))  # one-row frames


def sizes(files: DataFrame) -> DataFrame:
    """(path, size) of the files (path) that are still there; one that is gone, or cannot be read, is left out."""

    def stat(batches):
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                try:
                    with ranges.opened(path) as f:
                        found.append((path, f.size()))
                except OSError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["path", "size"])

    return files.select("path").mapInArrow(stat, "path string, size long")


def migrate(house: Warehouse, backups: str, now: str, chunk: int = CHUNK, publish: Callable[[dict], None] = lambda progress: None, stop: Callable[[], bool] | None = None) -> dict:
    """Make what ``pending`` counts, in steps of about ``chunk`` sessions; returns the last progress.

    The fingerprints are computed in one pass over the messages and files are looked up once; a step then appends its share of both, so
    a step that ended is kept whatever becomes of later ones. Between steps ``publish`` gets the progress and ``stop`` is asked. A session whose
    file is gone has no backup; it stays pending.
    """
    spark, at = house.spark, f"{house.path}/_staged/{run_name()}"
    todo = pending(house).first()
    total = todo["fingerprints"] + todo["backups"]
    steps = max(1, -(-max(todo["fingerprints"], todo["backups"]) // chunk))
    progress = {"total_sessions": total, "fingerprints_updated": 0, "backed_up": 0, "step": 0, "steps": steps, "status": "completed"}
    if total == 0:
        publish(dict(progress))
        return progress
    part = lambda key: F.pmod(F.xxhash64(key), F.lit(steps)).cast("int").alias("part")
    try:
        unprinted(house).select("*", part("session_id")).repartition("part").write.partitionBy("part").parquet(f"{at}/fingerprints")
        files = unsaved(house).groupBy(F.col("source_file").alias("path")).agg(F.count("*").alias("sessions"))
        files = files.join(sizes(files), "path").select("*", part("path"))
        files.write.partitionBy("part").parquet(f"{at}/files")
        prints = spark.read.schema("session_id STRING, fingerprint STRING, part INT").parquet(f"{at}/fingerprints")
        files = spark.read.schema("path STRING, sessions BIGINT, size BIGINT, part INT").parquet(f"{at}/files")
        for step in range(steps):
            if stop is not None and stop():
                progress["status"] = "cancelled"
                break
            mine, copies = prints.filter(F.col("part") == step).drop("part"), files.filter(F.col("part") == step)
            done = {"fingerprints": mine.count(), "files": copies.count()}  # of the footers
            if done["fingerprints"]:
                house.commit({"fingerprints": mine})
            if done["files"]:
                house.commit({"session_backups": backup(contents(copies.select("path", "size")), backups, now)})
            progress |= {"fingerprints_updated": progress["fingerprints_updated"] + done["fingerprints"], "backed_up": progress["backed_up"] + done["files"], "step": step + 1}
            publish(dict(progress))
    finally:
        remove(spark, at)
    return progress
