"""Streams: tailing growing JSONL files by byte offset, and event-time windows.

Spark's file stream takes a file for immutable; session logs grow. ``register`` adds the format
``jsonl_tail``, whose offsets are the bytes read of each file. Only complete lines are read: a
last line without its end is left for a later batch. A file that shrank is read anew.
"""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

STEP = 1 << 16


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class TailSource(DataSource):
    """Options: path, a glob of files that every worker sees; bytes, the most one batch takes of a file."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "file string, line_offset long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TailReader(self.options["path"], int(self.options.get("bytes", 64 << 20)))


class _TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str, most: int):
        self.pattern, self.most, self.current = pattern, most, None

    def initialOffset(self) -> dict:
        return {}

    def _end_of_lines(self, path: str, start: int) -> int:
        """Behind the last line end among the next bytes, looked for from their end; a longer line extends the range to its end."""
        size = os.path.getsize(path)
        start = start if start <= size else 0
        limit = stop = min(size, start + self.most)
        with open(path, "rb") as f:
            while stop > start:
                low = max(start, stop - STEP)
                f.seek(low)
                if (cut := f.read(stop - low).rfind(b"\n")) >= 0:
                    return low + cut + 1
                stop = low
            f.seek(at := limit)
            while data := f.read(STEP):
                if (cut := data.find(b"\n")) >= 0:
                    return at + cut + 1
                at += len(data)
        return start

    def latestOffset(self) -> dict:
        before = self.current or {}
        self.current = {p: self._end_of_lines(p, before.get(p, 0)) for p in sorted(glob.glob(self.pattern, recursive=True))}
        return self.current

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.current = self.current or end
        return [_Range(p, start.get(p, 0) if start.get(p, 0) <= stop else 0, stop) for p, stop in end.items() if stop != start.get(p, 0)]

    def read(self, partition: _Range):
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.stop:
                line = f.readline()
                if text := line.decode("utf-8", "replace").strip():
                    yield partition.path, at, text
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)


def tail(spark: SparkSession, pattern: str, **options) -> DataFrame:
    """(file, line_offset, value) of all complete lines, also those that are appended later."""
    register(spark)
    return spark.readStream.format("jsonl_tail").options(path=pattern, **options).load()


def store_new(lines: DataFrame, path: str, checkpoint: str):
    """Append all lines that are there to a table, each (file, line_offset) once even if a batch is delivered again.

    Returns when no bytes of complete lines are left. Spark asks a Python source once for the end of a run that takes
    what is available, so runs of at most ``bytes`` of each file follow each other until one finds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    while True:
        query = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        moved = [s for p in query.recentProgress for s in p["sources"] if s["startOffset"] != s["endOffset"]]
        if not moved:
            return query


def tumbling(events: DataFrame, ts: str, width: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Counts by window (sliding if ``slide``) and keys; for streams set a watermark before."""
    return events.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def session_windows(events: DataFrame, ts: str, gap: str, *keys: str) -> DataFrame:
    """Counts by session: events of the keys that follow each other by less than ``gap``."""
    return events.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
