"""Reading byte ranges of files in tasks: what a log has grown by, and huge logs by many tasks.

The list of files stays a DataFrame: no path passes the driver. A file's range is cut into chunks, each read by
the task that its row is dealt to; a line belongs to the chunk that it begins in. No byte behind the size
that the list states is read, so what is appended meanwhile is left to the next run.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk, of one read, and rows and bytes of a batch that goes back.
CHUNK, STEP, ROWS, BYTES = 64 << 20, 1 << 20, 4096, 8 << 20
#: Bytes before an offset that tell whether a file is still the one that was read up to there.
PROBE = 4096


def opened(path: str):
    """A file of any file system that the path names, for random access."""
    plain = re.sub(r"^file:/+", "/", path)
    where, at = (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    return where.open_input_file(at)


def whole_lines(f, first: int, begin: int, end: int, size: int):
    """(offset, offset behind, bytes) of the lines that begin in [begin, end), of a range that begins at ``first`` and ends at ``size``.

    A last line without its end counts if it is JSON; else it may still be written.
    """
    at, skip = (begin, False) if begin == first else (begin - 1, True)
    rest, read = b"", at
    while at < end or skip:
        cut = rest.find(b"\n")
        while cut < 0 and read < size:
            data = f.read_at(min(STEP, size - read), read)
            if not data:
                break
            cut = data.find(b"\n")
            cut = cut if cut < 0 else len(rest) + cut
            rest += data
            read += len(data)
        if cut < 0:
            if not skip and rest.strip():
                try:
                    json.loads(rest)
                except ValueError:
                    return
                yield at, at + len(rest), rest
            return
        line, rest = rest[: cut + 1], rest[cut + 1 :]
        if not skip and line.strip():
            yield at, at + len(line), line
        skip = False
        at += len(line)


def _batches(rows, names, kinds):
    """Rows as record batches, bounded by rows and bytes."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(out) >= ROWS or held >= BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def dealt(files: DataFrame, chunk: int, total: int) -> DataFrame:
    """Rows (path, first, begin, end, size): the chunks of each file's range, dealt by hash, about a chunk's bytes to a task where ``total`` bytes are read."""
    sc = files.sparkSession.sparkContext
    start = F.coalesce("start", F.lit(0).cast("long")) if "start" in files.columns else F.lit(0).cast("long")
    some = files.select("path", start.alias("first"), F.col("size").cast("long").alias("size")).filter("size > first")
    begins = some.select("*", F.explode(F.sequence("first", F.col("size") - 1, F.lit(chunk).cast("long"))).alias("begin"))
    rows = begins.select("path", "first", "begin", F.least(F.col("begin") + chunk, F.col("size")).alias("end"), "size")
    return rows.repartition(max(sc.defaultParallelism, -(-total // CHUNK)), "path", "begin")


def lines(files: DataFrame, total: int = 0, chunk: int = CHUNK) -> DataFrame:
    """(file, ord, next, value) of the non-blank lines of files (path, size; start if not 0).

    ``ord`` holds the line's true offset and orders the lines of a file; ``next`` is the offset behind it. ``total`` are the bytes to read, by which tasks are numbered.
    """

    def run(batches):
        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    with opened(r["path"]) as f:
                        for at, after, line in whole_lines(f, r["first"], r["begin"], r["end"], r["size"]):
                            yield r["path"], at, after, line.decode("utf-8", "replace").strip()

        yield from _batches(rows(), ["file", "offset", "next", "value"], [pa.string(), pa.int64(), pa.int64(), pa.string()])

    found = dealt(files, chunk, total).mapInArrow(run, "file string, offset long, next long, value string")
    return found.select("file", F.struct(F.col("offset").alias("block"), F.lit(0).cast("long").alias("n")).alias("ord"), "next", "value")


def whole(files: DataFrame, total: int = 0) -> DataFrame:
    """(file, value) of whole small files (path, size)."""

    def run(batches):
        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    with opened(r["path"]) as f:
                        yield r["path"], f.read_at(r["size"], 0).decode("utf-8", "replace")

        yield from _batches(rows(), ["file", "value"], [pa.string(), pa.string()])

    return dealt(files.drop("start"), 1 << 40, total).mapInArrow(run, "file string, value string")


def probes(files: DataFrame, at: str) -> DataFrame:
    """(path, probe): a hash of the bytes before offset ``at`` of each file (path, ``at``); null where the file is shorter."""

    def run(batches):
        def rows():
            for batch in batches:
                for path, offset in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                    with opened(path) as f:
                        n = min(PROBE, offset)
                        yield path, hashlib.sha256(f.read_at(n, offset - n)).hexdigest() if f.size() >= offset else None

        yield from _batches(rows(), ["path", "probe"], [pa.string(), pa.string()])

    return files.select("path", F.col(at).cast("long").alias("at")).mapInArrow(run, "path string, probe string")
