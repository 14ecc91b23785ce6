"""Logs into tables as they grow: micro-batches of new lines, each moved into all message tables at once.

A batch is a run of the warehouse, named by the query's checkpoint and the batch's number. Delivered again, it is the same run:
a completed one is left out, one that was cut off is written anew. Its rows count when the ledger calls it completed, so a reader sees all
tables of a batch or none.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.warehouse import COUNTERS, LEDGER, Warehouse, _Run, run_name
from ..sources import ingest, sessions


def found_in(lines: DataFrame, this: _Run, source: tuple[str, str] | None = None, **how) -> dict[str, DataFrame]:
    """The tables of new lines (file, line_offset, value) of session logs, as an ``ingest`` of these lines alone."""
    rows = lines.select("file", F.struct(F.col("line_offset").alias("block"), F.lit(0).cast("long").alias("n")).alias("ord"), "value")
    rows = this.keep("lines_session_log", rows)
    messages, blocks = (this.keep(name, df) for name, df in zip(("parsed_messages", "parsed_blocks"), sessions.session_logs(rows)))
    pending = this.pending(blocks.filter("block_type = 'tool_result'").select("file", "tool_use_id").distinct())
    found = ingest.tables_of(messages, blocks, pending=pending, **how)
    name, tag = source or (None, None)
    found["messages"] = ingest.tagged(found["messages"], name, tag)
    found["found_sessions"] = ingest.tagged(ingest.with_columns_of(ingest.minimal_sessions(found["messages"]), ingest.SESSION), name, tag)
    found["parse_errors"] = sessions.parse_errors(rows)
    return found


def write_batch(lines: DataFrame, number: int, path: str, checkpoint: str, then: list[Callable[[Warehouse], None]] = (), **how) -> None:
    """Move one micro-batch into the tables of the warehouse at ``path``, then call each of ``then`` with it."""
    spark = lines.sparkSession
    suffix = f"-{uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex}-{number}"
    runs = Warehouse(spark, path).table("index_runs")
    before = [] if runs is None else runs.filter(F.col("run_id").endswith(suffix)).select("run_id", "status").collect()
    if not any(r["status"] == "completed" for r in before):
        run_id = before[0]["run_id"] if before else run_name() + suffix
        house = Warehouse(spark, path, run_id)
        clock = lambda: f"{dt.datetime.now(dt.UTC):%Y-%m-%d %H:%M:%S}"
        row = dict.fromkeys((c.split()[0] for c in LEDGER.split(", ")), None) | {"run_id": run_id, "started_at": clock(), "status": "running", "full": False}
        house.record(row, 0)
        this = _Run(house, run_id, None, None)
        this.store(found_in(lines, this, **how))
        house.record(row | {c: this.counts.get(c, 0) for c in COUNTERS} | {"status": "completed", "finished_at": clock()}, 1)
    for step in then:
        step(Warehouse(spark, path))


def keep_up(lines: DataFrame, path: str, checkpoint: str, every: str | None = None, then: list[Callable[[Warehouse], None]] = (), **how):
    """A query that moves the lines of a tail into tables: all that are there and then no more, or with ``every`` ('60 seconds') again and again.

    ``then`` are steps that follow each batch, such as indexing for search, enrichment or classification.
    """
    writer = lines.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, path, checkpoint, then, **how)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def index_for_search(path: str, stem: bool = True) -> Callable[[Warehouse], None]:
    """A step that adds the searchable blobs that the index at ``path`` lacks."""
    from ..operators import fulltext

    def step(house: Warehouse) -> None:
        blobs = house.table("search")
        if blobs is not None:
            fulltext.add(blobs, path, stem)

    return step


def enrich_new(backend: Callable[[str], str] | None, model: str, publish: Callable[[dict], None] = lambda counts: None, **how) -> Callable[[Warehouse], None]:
    """A step that enriches the sessions that have no enrichment, and publishes its counts."""
    from ..operators import enrich

    return lambda house: publish(enrich.enrich_sessions(house, backend, model, f"{dt.datetime.now(dt.UTC):%Y-%m-%d %H:%M:%S}", **how))


def classify_new(backend: Callable[[str], str] | None = None, model: str = "learned", publish: Callable[[dict], None] = lambda counts: None, **how) -> Callable[[Warehouse], None]:
    """A step that classifies the sessions that have no outcome, and publishes its counts."""
    from ..operators import outcomes

    return lambda house: publish(outcomes.classify(house, backend, model, again=False, **how))


class Progress(StreamingQueryListener):
    """Publishes what queries do as small dicts: started, progress (batch, rows, seconds), failed, ended."""

    def __init__(self, publish: Callable[[dict], None]):
        self.publish = publish

    def onQueryStarted(self, event) -> None:
        self.publish({"event": "started", "query": str(event.id), "name": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.publish({"event": "progress", "query": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "seconds": p.batchDuration / 1000})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.publish({"event": "failed" if event.exception else "ended", "query": str(event.id), "error": event.exception})


def watched(spark: SparkSession, publish: Callable[[dict], None]) -> Progress:
    """Have all queries of the session publish what they do."""
    listener = Progress(publish)
    spark.streams.addListener(listener)
    return listener
