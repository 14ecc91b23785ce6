"""Writing the tables: incremental runs with a ledger, backups by content hash, retention.

Tables are plain Parquet folders partitioned by ``run``. A run appends the rows of keys that are not stored; tables whose
rows are replaced get the new row, and the latest run's row of a key counts. What a run that did not complete has left is not read.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..functions.shared import exists, remove
from ..sources import ingest, ranges, scan, sessions
from .store import changes, content_hash, deleted, expired, first_wins, session_fingerprint

KEYS = {
    "messages": ["id"],
    "content_blocks": ["message_id", "block_index", "block_type"],
    "tool_calls": ["id"],
    "content_store": ["hash"],
    "blob_references": ["hash", "message_id", "context"],
    "file_references": ["file_path", "content_hash", "message_id", "operation"],
    "file_uses": ["file", "tool_use_id", "ord", "block_index"],
    "search": ["hash"],
    "tasks": ["session_id", "id"],
    "task_dependencies": ["session_id", "task_id", "depends_on"],
    "session_outcomes": ["session_id"],
    "session_enrichments": ["session_id"],
    "daily_stats": ["date"],
    "model_usage": ["model"],
    "notes": ["hash"],
    "sessions": ["id"],
    "fingerprints": ["session_id"],
    "indexed_files": ["path"],
    "session_backups": ["session_id", "original_path"],
}
#: Tables in which a new row replaces the stored one; elsewhere the first row of a key stays.
REPLACED = {"tasks", "session_outcomes", "session_enrichments", "daily_stats", "model_usage", "sessions", "fingerprints", "tool_calls", "indexed_files", "session_backups"}
#: What a run counts, each in the pass that writes or reads the rows.
COUNTERS = (
    "sessions_added", "messages_added", "blobs_added", "tool_calls_added", "tasks_added", "facets_added", "plans_added", "history_added", "messages_skipped", "parse_errors", "files", "unchanged",
)
LEDGER = "run_id STRING, step INT, started_at STRING, finished_at STRING, status STRING, full BOOLEAN, deleted BIGINT, error STRING, " + ", ".join(f"{c} BIGINT" for c in COUNTERS)
MANIFEST = "path STRING, mtime BIGINT, size BIGINT, offset BIGINT, probe STRING"
#: The counter of the rows that a run appends to a table; that of ``notes`` is by kind.
COUNTED = {
    "sessions": "sessions_added", "messages": "messages_added", "content_store": "blobs_added", "tool_calls": "tool_calls_added", "tasks": "tasks_added", "session_outcomes": "facets_added",
}


class Cancelled(Exception):
    """The run was asked to stop."""


class Warehouse:
    """The tables below one folder."""

    def __init__(self, spark: SparkSession, path: str, own: str | None = None):
        """``own`` is the run that writes: what it has written so far is no part of the tables that it reads."""
        self.spark, self.path, self.own = spark, path.rstrip("/"), own

    def unfinished(self) -> list[str]:
        """Runs that the ledger does not call completed."""
        runs = self.table("index_runs")
        return [] if runs is None else [r["run_id"] for r in runs.filter("status <> 'completed'").select("run_id").collect()]

    def table(self, name: str) -> DataFrame | None:
        """A table as its completed runs left it; None if no run wrote it."""
        at = f"{self.path}/{name}"
        if not exists(self.spark, at):
            return None
        if name == "index_runs":
            rows = self.spark.read.schema(LEDGER).parquet(at)
            return rows.groupBy("run_id").agg(F.max_by(F.struct(*rows.columns), "step").alias("r")).select("r.*").drop("step")
        rows = self.spark.read.option("mergeSchema", True).parquet(at).withColumn("run", F.col("run").cast("string"))
        if unfinished := self.unfinished() + ([self.own] if self.own else []):
            rows = rows.filter(~F.col("run").isin(unfinished))
        if name in REPLACED:
            latest = Window.partitionBy(*KEYS[name]).orderBy(F.desc("run"))
            rows = rows.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")
        return rows.drop("run")

    def fresh(self, name: str, new: DataFrame, absent: bool = False) -> DataFrame:
        """The rows of ``new`` that a run appends: of each key the first (or, where rows are replaced, the last) by (file, line), else by all columns.

        Keys that are stored stay out where rows are not replaced, and with ``absent`` in any table.
        """
        known = [c for c in ("file", "ord", "source_file") if c in new.columns]
        order = known + [f.name for f in new.schema if f.name not in known and not isinstance(f.dataType, MapType)]
        last = name in REPLACED and not absent
        rows = first_wins(new, KEYS[name], [F.desc(c) for c in order] if last else order)
        old = None if last else self.table(name)
        return rows if old is None else rows.join(old.select(*KEYS[name]), KEYS[name], "left_anti")

    def merged(self, name: str, new: DataFrame, absent: bool = False) -> DataFrame:
        """The table as it is once a run has appended ``new``."""
        old, rows = self.table(name), self.fresh(name, new, absent)
        if old is None:
            return rows
        return old.join(rows.select(*KEYS[name]), KEYS[name], "left_anti").unionByName(rows, allowMissingColumns=True)

    def append(self, run_id: str, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/run={run_id}")

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Append tables outside of a run."""
        for name, rows in tables.items():
            self.append(run_name(), name, rows)

    @contextmanager
    def staged(self, rows: DataFrame) -> Iterator[DataFrame]:
        """``rows``, computed once and written, for as long as they are needed."""
        at = f"{self.path}/_staged/{run_name()}"
        rows.write.parquet(at)
        try:
            yield self.spark.read.schema(rows.schema).parquet(at)
        finally:
            remove(self.spark, at)

    def record(self, row: dict, step: int) -> None:
        """Add a state of a run to the ledger, of which the last counts."""
        self.spark.createDataFrame([row | {"step": step}], LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/index_runs")


def run_name() -> str:
    """A name by which later runs sort behind earlier ones."""
    return f"r{dt.datetime.now(dt.UTC):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:6]}"


class _Run:
    """One indexing run: what it stages, counts and appends."""

    def __init__(self, house: Warehouse, run_id: str, stop: Callable[[], bool] | None, pause: Callable[[], bool] | None):
        self.house, self.spark, self.run_id, self.stop, self.pause = house, house.spark, run_id, stop, pause
        self.counts: dict[str, int] = {}

    def may_go_on(self) -> None:
        """Between phases: waits while paused, raises ``Cancelled`` if asked to stop."""
        while self.pause is not None and self.pause() and not (self.stop is not None and self.stop()):
            time.sleep(0.1)
        if self.stop is not None and self.stop():
            raise Cancelled("cancelled")

    def _observed(self, df: DataFrame, **counted) -> tuple[DataFrame, Observation | None]:
        if not counted:
            return df, None
        seen = Observation()
        return df.observe(seen, *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name) for name, c in counted.items()]), seen

    def keep(self, name: str, df: DataFrame, **counted) -> DataFrame:
        """Store what several tables are made of, once, and count in the same pass."""
        self.may_go_on()
        path = f"{self.house.path}/_staged/{self.run_id}/{name}"
        if name == "lines_session_log":
            marks = F.lit(False)
            for mark in sessions.SKIPPED:
                marks = marks | F.contains("value", F.lit(mark))
            counted["messages_skipped"] = F.when(marks, 1)
        df, seen = self._observed(df, **counted)
        df.write.mode("overwrite").parquet(path)
        if seen is not None:
            self.counts |= seen.get
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, name: str, rows: DataFrame) -> None:
        self.may_go_on()
        counted = {COUNTED[name]: F.lit(1)} if name in COUNTED else {}
        if name == "notes":
            counted = {"plans_added": F.when(F.col("kind") == "plan", 1), "history_added": F.when(F.col("kind") == "history_prompt", 1)}
        rows, seen = self._observed(rows, **counted)
        self.house.append(self.run_id, name, rows)
        if seen is not None:
            self.counts |= seen.get

    def resumed(self, files: DataFrame, known: DataFrame, status: DataFrame) -> DataFrame:
        """Files with the offset that each is read from: session logs that only grew from where they were read to, all others from 0.

        A log only grew if it is as long at least and the bytes before the offset are those that were there.
        """
        logs = files.filter("kind = 'session_log'").join(status.filter("status = 'modified'").select("path"), "path", "left_semi").join(known.select("path", "offset", F.col("probe").alias("stored")), "path")
        logs = logs.filter("offset > 0 AND size >= offset")
        same = ranges.probes(logs, "offset").join(logs.select("path", "offset", "stored"), "path").filter("probe = stored")
        return files.join(same.select("path", F.col("offset").alias("start")), "path", "left").withColumn("start", F.coalesce("start", F.lit(0).cast("long")))

    def pending(self, results: DataFrame) -> DataFrame | None:
        """Stored file uses that have had no result yet, of those that the new results name."""
        uses, blocks = self.house.table("file_uses"), self.house.table("content_blocks")
        if uses is None:
            return None
        uses = uses.join(results, ["file", "tool_use_id"], "left_semi")
        return uses.join(blocks.filter("block_type = 'tool_result'").select("tool_use_id"), "tool_use_id", "left_anti")

    def index(self, root: str, files: DataFrame, known: DataFrame, todo: DataFrame, status: DataFrame, full: bool, **how) -> None:
        """Parse the files of ``todo`` once and append what is new."""
        todo = self.keep("todo", todo.withColumn("start", F.lit(0).cast("long")) if full else self.resumed(todo, known, status))
        found = ingest.ingest(self.spark, root, todo, keep=self.keep, pending=self.pending, **how)
        self.store(found)
        # what was read, not what is there by now
        reached = todo.select("path", "mtime", "size", "start", "kind")
        if "lines" in found:
            ends = found["lines"].groupBy(F.col("file").alias("path")).agg(F.max("next").alias("read_to"))
            reached = reached.join(ends, "path", "left")
        else:
            reached = reached.withColumn("read_to", F.lit(None).cast("long"))
        offset = F.when(F.col("kind") == "session_log", F.coalesce("read_to", "start")).otherwise(F.col("size"))
        reached = reached.select("path", "mtime", "size", offset.alias("offset")).dropDuplicates(["path"])
        self.append("indexed_files", reached.join(ranges.probes(reached, "offset"), "path", "left"))

    def store(self, found: dict[str, DataFrame]) -> None:
        """Append what is new of the tables of an ``ingest``."""
        house = self.house
        if "parse_errors" in found:
            self.counts["parse_errors"] = found["parse_errors"].agg(F.coalesce(F.sum("parse_errors"), F.lit(0))).first()[0]
        new = {name: df for name, df in found.items() if name in KEYS and name not in ("sessions", "messages", "tool_calls", "fingerprints")}
        for name, df in new.items():
            self.append(name, house.fresh(name, df))
        named, stubs = found.get("indexed_sessions"), found.get("found_sessions")
        if named is not None or stubs is not None:
            rows = None if named is None else house.fresh("sessions", named)
            if stubs is not None:
                absent = house.fresh("sessions", stubs, absent=True)
                rows = absent if rows is None else rows.unionByName(absent.join(rows.select("id"), "id", "left_anti"), allowMissingColumns=True)
            self.append("sessions", rows)
        if "messages" in found:
            stored = house.table("messages")
            messages = self.keep("messages", house.fresh("messages", found["messages"]))
            self.append("messages", messages)
            touched = messages.select("session_id").distinct()
            every = messages if stored is None else stored.join(touched, "session_id", "left_semi").unionByName(messages, allowMissingColumns=True)
            self.append("fingerprints", session_fingerprint(every, ["timestamp", "turn_index", "id"]))
            calls, old = house.fresh("tool_calls", found["tool_calls"]), house.table("tool_calls")
            if old is not None:  # results of calls that an earlier run stored
                late = found["outputs"].select(F.col("tool_use_id").alias("id"), F.col("output_hash").alias("late"))
                late = old.join(calls.select("id"), "id", "left_anti").join(late, "id").withColumn("output_hash", F.coalesce("late", "output_hash")).drop("late")
                calls = calls.unionByName(late)
            self.append("tool_calls", calls)


def run(spark: SparkSession, root: str, path: str, full: bool = False, now: str | None = None, stop: Callable[[], bool] | None = None, pause: Callable[[], bool] | None = None, backups: str | None = None, keep_days: int = 0, **how) -> dict:
    """One indexing run over ``root``: only new and modified files are parsed; returns its ledger row.

    The files are listed once; no byte behind the listed sizes is read, and just what was read is marked, so lines written
    meanwhile are left to the next run. A log that grew is read from where the last run came to; other modified files from
    their start. So a run over an appended, a rewritten or an unchanged tree ends in the same tables as a full run. The ledger
    has the run as 'running' from its start; one that was cut off stays so, and its rows do not count. ``stop`` and ``pause`` are asked between phases;
    a run that is stopped is 'cancelled', leaves all tables as they were, and may be interrupted within a phase by ``cancel``.
    ``backups`` is the folder to which files are copied, with what is older than ``keep_days`` days removed after the run.
    """
    clock = lambda: now or f"{dt.datetime.now(dt.UTC):%Y-%m-%d %H:%M:%S}"
    run_id = run_name()
    house = Warehouse(spark, path, run_id)
    row = dict.fromkeys((c.split()[0] for c in LEDGER.split(", ")), None) | {"run_id": run_id, "started_at": clock(), "status": "running", "full": full}
    house.record(row, 0)
    this = _Run(house, run_id, stop, pause)
    tag = tag_of(path)
    spark.addTag(tag)
    try:
        files = this.keep("manifest", scan.manifest(spark, root, list(how.pop("exclude", ()))))
        every = house.table("indexed_files")
        every = spark.createDataFrame([], MANIFEST) if every is None else every
        known = every.filter(scan.below("path", root))  # other sources may share the tables
        status = this.keep("status", changes(files, known))
        counts = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}
        row["deleted"] = deleted(files, known).count()
        todo = files if full else files.join(status.filter("status <> 'unchanged'").select("path"), "path", "left_semi")
        this.counts |= {"files": sum(counts.values()) if full else counts.get("new", 0) + counts.get("modified", 0), "unchanged": 0 if full else counts.get("unchanged", 0)}
        if this.counts["files"]:
            this.index(root, files, known, todo, status, full, **how)
            if backups:
                logs = todo.filter(F.col("kind").isin(*ingest.FORMATS)).select("path", F.col("size").cast("long").alias("size"))
                this.append("session_backups", backup(contents(logs), backups, clock()))
        this.may_go_on()
        row |= {"status": "completed"}
    except Cancelled:
        row |= {"status": "cancelled"}
    except Exception as e:  # a run that fails is recorded, then reported
        cancelled = "cancelled" in str(e).lower() and stop is not None and stop()
        row |= {"status": "cancelled"} if cancelled else {"status": "failed", "error": str(e)[:500]}
        if not cancelled:
            raise
    finally:
        spark.removeTag(tag)
        row |= {c: this.counts.get(c, 0) for c in COUNTERS} if row["status"] == "completed" else {c: 0 for c in COUNTERS}
        row["finished_at"] = clock()
        house.record(row, 1)
        remove(spark, f"{house.path}/_staged/{run_id}")
        if backups and keep_days > 0 and row["status"] == "completed":
            retain(Warehouse(spark, path), backups, keep_days, now)
    return row


def tag_of(path: str) -> str:
    """The tag that the jobs of a run over the warehouse at ``path`` carry."""
    return f"index-{uuid.uuid5(uuid.NAMESPACE_URL, path.rstrip(chr(47))).hex}"


def cancel(spark: SparkSession, path: str) -> list[str]:
    """Interrupt the jobs of the run over the warehouse at ``path``; its ``stop`` should be true by then."""
    return spark.interruptTag(tag_of(path))


def contents(files: DataFrame) -> DataFrame:
    """(path, content) of files (path, size), up to the listed size."""
    spark = files.sparkSession
    schema = "path string, content binary"

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                with ranges.opened(r["path"]) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([f.read_at(r["size"], 0)], pa.binary())], ["path", "content"])

    return files.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(read, schema)


def retain(house: Warehouse, backups: str, days: int, now: str | None = None) -> None:
    """Drop backups older than ``days`` from the table, and stored contents that no kept backup names."""
    rows = house.table("session_backups")
    if rows is None:
        return
    kept = pruned(rows, days, None if now is None else F.to_timestamp(F.lit(now)))
    if kept.count() == rows.count():
        return
    at, spark = f"{house.path}/session_backups", house.spark
    staged = f"{house.path}/_staged/{run_name()}"
    kept.write.parquet(f"{staged}/kept")
    swept(spark.read.parquet(f"{staged}/kept"), spark.read.parquet(backups)).write.parquet(f"{staged}/contents")
    remove(spark, at)
    house.append(run_name(), "session_backups", spark.read.parquet(f"{staged}/kept"))
    spark.read.parquet(f"{staged}/contents").write.mode("overwrite").parquet(backups)
    remove(spark, staged)


def run_all(spark: SparkSession, sources: list, path: str, **how) -> list[dict]:
    """One run for each ``config.Source``, in order, into the same tables; a row that two sources hold comes from the first,
    but for tables whose later rows replace earlier ones. Returns the ledger rows."""
    return [run(spark, s.path, path, source=(s.name, s.kind), **how) for s in sources]


def backup(files: DataFrame, path: str, now: str) -> DataFrame:
    """Copy files (path, content) to ``path``, named by the hash of their content; returns what is backed up.

    Equal contents are stored once, also over many runs. The session is the file's stem, of which rollout and chat files use the last 36 characters.
    """
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    ident = F.when(stem.rlike("^(session|rollout)-") & (F.length(stem) >= 36), F.right(stem, F.lit(36))).otherwise(stem)
    rows = files.select(ident.alias("session_id"), F.col("path").alias("original_path"), F.sha2("content", 256).alias("content_hash"), F.lit(now).alias("backed_up_at"), F.length("content").cast("long").alias("file_size"), "content")
    new = rows.select("content_hash", "content", "original_path")
    if exists(files.sparkSession, path):
        new = new.join(files.sparkSession.read.schema("content_hash STRING, content BINARY").parquet(path).select("content_hash"), "content_hash", "left_anti")
    first_wins(new, ["content_hash"], ["original_path"]).select("content_hash", "content").write.mode("append").parquet(path)
    return rows.drop("content")


def swept(backups: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored contents that a backup still names: what retention leaves of them."""
    return stored.join(backups.select("content_hash").distinct(), "content_hash", "left_semi")


def pruned(backups: DataFrame, days: int, now=None) -> DataFrame:
    """What retention leaves; contents that no kept backup names can then be dropped by an anti-join."""
    return backups.join(expired(backups, days, now).select("session_id", "original_path"), ["session_id", "original_path"], "left_anti")


def content_of(backups: DataFrame, stored: DataFrame, session_id: str) -> DataFrame:
    """The stored contents of a session's backup."""
    return stored.join(backups.filter(F.col("session_id") == session_id).select("content_hash", "original_path"), "content_hash")


def verify(stored: DataFrame) -> DataFrame:
    """Stored contents whose hash is not their name."""
    return stored.filter(content_hash("content") != F.col("content_hash"))
