"""Results that consume tool uses, over a stream: each use is matched by the first later result, once.

State is one pending use for each (file, tool use id). A later use of the same id replaces it, the first later
result takes it, and a timer drops it when the watermark has passed it by ``within``, so that uses that never get a
result do not stay.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What state is kept in: keyed state with timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOUND = "file STRING, tool_use_id STRING, use_ord BIGINT, result_ord BIGINT, tool_name STRING, path STRING, content_hash STRING"


class Consume(StatefulProcessor):
    """One pending use for each key."""

    def __init__(self, within_ms: int):
        self.within_ms = within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "ord BIGINT, tool_name STRING, path STRING, until BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        use = self.pending.get() if self.pending.exists() else None
        before = use
        for row in sorted(rows, key=lambda r: r.ord):
            if row.is_use:
                use = (row.ord, row.tool_name, row.path, int(row.ts.timestamp() * 1000) + self.within_ms)
            elif use is not None and row.ord > use[0]:
                yield Row(file=key[0], tool_use_id=key[1], use_ord=use[0], result_ord=row.ord, tool_name=use[1], path=use[2], content_hash=row.content_hash)
                use = None
        if use is before:
            return
        if before is not None:
            self.handle.deleteTimer(before[3])
        if use is None:
            self.pending.clear()
        else:
            self.pending.update(tuple(use))
            self.handle.registerTimer(use[3])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.pending.clear()
        yield from ()

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Keep the state of this session's streams in the store that ``consumed_stream`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def consumed_stream(log: DataFrame, within: str = "1 day") -> DataFrame:
    """Matches in a stream of uses and results (file, tool_use_id, ord, ts, is_use, tool_name, path, content_hash).

    ``ord`` orders the lines of a file. Rows older than the watermark (the latest ``ts`` less ``within``) are dropped.
    """
    count, unit = within.split()
    ms = int(count) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")] * 1000
    rows = log.withWatermark("ts", within).groupBy("file", "tool_use_id")
    return rows.transformWithState(statefulProcessor=Consume(ms), outputStructType=FOUND, outputMode="append", timeMode="EventTime")
