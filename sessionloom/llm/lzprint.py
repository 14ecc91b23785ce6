"""Document fingerprints from Lempel-Ziv phrases.

A text's bytes are parsed into phrases: each is the shortest one not in the dictionary yet, and
enters it. Texts that share content share phrases, as they would help to compress each other. The
set of phrases is hashed and reduced to a minimum-hash signature: the smallest hash of each of 256
bins, of which 16 bits are kept. The likeness of two signatures estimates the Jaccard similarity of
the phrase sets, and is exact but for collisions where phrases are few.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table
from .words import _POWERS, mixed

#: Bins of a signature, of which the high byte of a hash chooses one; an empty bin is marked.
BINS, EMPTY = 256, 0xFFFF
#: Rows of one output batch.
ROWS = 512
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def parse(data: bytes, tree: dict[int, int], ends: list[int]) -> None:
    """Parse ``data`` on from the last of ``ends``; the dictionary is a tree of (node, byte) steps.

    One look-up a byte whatever the text is like. A rest that is a known phrase adds none.
    """
    at, size, node = ends[-1] if ends else 0, len(tree), 0
    for end, byte in enumerate(data[at:], at + 1):
        step = node << 8 | byte
        node = tree.get(step, 0)
        if not node:
            size += 1
            tree[step] = size
            ends.append(end)


def signature(data: bytes, ends: list[int]) -> np.ndarray:
    """The smallest hash of each bin over the phrases that end at ``ends``."""
    out = np.full(BINS, EMPTY, ">u2")
    if not ends:
        return out
    stop = np.array(ends, np.int64)
    start = np.concatenate([[0], stop[:-1]])
    values = np.frombuffer(data, np.uint8)[: stop[-1]].astype(np.uint64) + np.uint64(1)
    _POWERS.to(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _POWERS.up[: len(values)], out=total[1:])
    hashes = np.sort(mixed((total[stop] - total[start]) * _POWERS.down[start] + (stop - start).astype(np.uint64)))
    bins = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out[bins[first]] = np.minimum((hashes[first] >> np.uint64(40)) & np.uint64(0xFFFF), EMPTY - 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of bins with equal minima among those that either text fills; two empty texts are alike."""
    filled = (a != EMPTY) | (b != EMPTY)
    n = int(filled.sum())
    return float(((a == b) & filled).sum() / n) if n else 1.0


class Printed:
    """A text parsed up to the cut that its edited text shares with it, and on to its end."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.n = doc_id, len(text)
        self.head = text[: self.n - self.n // 2].encode("utf-8")
        self.tree, self.ends = {}, []
        parse(self.head, self.tree, self.ends)
        data, ends = text.encode("utf-8"), list(self.ends)
        parse(data, dict(self.tree), ends)
        self.signature = signature(data, ends)

    def beside(self, text: str, other: np.ndarray) -> tuple:
        """The row of this document, whose next one has ``text`` and the signature ``other``. Uses up the parse."""
        data = self.head + text[: self.n // 2].encode("utf-8")
        parse(data, self.tree, self.ends)
        edited = signature(data, self.ends)
        return (
            self.doc_id, self.n, hashlib.sha256(data).hexdigest(), self.signature.tobytes().hex(), edited.tobytes().hex(),
            likeness(self.signature, edited), likeness(self.signature, other),
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of all rows of ``docs`` (doc_id, text): 1,024 hex digits. Null texts are empty."""

    def run(batches):
        for batch in batches:
            found = [Printed(None, text).signature.tobytes().hex() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_arrow(rows, run, "doc_id long, fingerprint string")


def _beside_next(batches):
    """Rows sorted by run, guests last: each gets the one after it, and the run's guest ends it."""
    run, last, closed, out = None, None, False, []

    def batch():
        columns = [pa.array(c) for c in zip(*out)]
        out.clear()
        return pa.RecordBatch.from_arrays([columns[0].cast(pa.int64()), *columns[1:]], [x.split()[0] for x in SCHEMA.split(", ")])

    for b in batches:
        for at, guest, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            if at != run:
                run, last, closed = at, None, False
            if closed:
                continue
            found = Printed(doc_id, text)
            if last is not None:
                out.append(last.beside(text, found.signature))
            last, closed = (None, True) if guest else (found, False)
            if len(out) >= ROWS:
                yield batch()
    if out:
        yield batch()


def edited_prints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all rows of ``docs`` (doc_id, text) and of their edited texts, and their likeness.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the
    next row's text. Rows are ordered by descending doc_id, null last, rows that repeat an id by a
    hash of their text; the next of the last is the first, and of a single row itself. A null text is
    empty, and empty texts are alike with likeness 1. An empty table gives no rows.

    The order is cut into runs at keys that are known exactly before any text moves: the first key of
    each range of a range partitioning of the keys alone. Then each text is shuffled once, to its run,
    and the first of a run also to the run before, where it is the last one's next.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = [F.col("doc_id").isNull().cast("int").alias("last"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("down"), F.xxhash64("text").alias("tie")]
    ranged = rows.select(*key).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "last", "down", "tie")
    firsts = ranged.groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("last", "down", "tie")).alias("first")).select("first.*").collect()
    firsts = sorted(tuple(r) for r in firsts)
    if not firsts:
        return spark.createDataFrame([], SCHEMA)

    @F.arrow_udf("array<int>")
    def runs(last: pa.Array, down: pa.Array, tie: pa.Array) -> pa.Array:
        out = []
        for k in zip(last.to_pylist(), down.to_pylist(), tie.to_pylist()):
            run = bisect_right(firsts, k) - 1
            out.append([run, (run - 1) % len(firsts)] if k == firsts[run] else [run])
        return pa.array(out, pa.list_(pa.int32()))

    dealt = rows.select("*", *key).select("*", F.posexplode(runs("last", "down", "tie")).alias("guest", "run"))
    dealt = dealt.repartitionById(len(firsts), F.col("run")).sortWithinPartitions("run", "guest", "last", "down", "tie")
    return map_arrow(dealt.select("run", "guest", "doc_id", "text"), _beside_next, SCHEMA)


def op12_lzprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_prints(table(spark, sf_dir, "documents").select("doc_id", "text"))
