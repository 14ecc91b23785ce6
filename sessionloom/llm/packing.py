"""Harmonic packing of token sequences.

What a document leaves over whole capacities belongs to the class k of the lengths in
(capacity/(k + 1), capacity/k]; a bin of the class k takes exactly k of them, so every worker
fills the bins of its own partition with no shuffle at all. The gap that a full bin leaves is
closed with the beginning of the next document, the one cut that padding demands. What is in
open bins when a worker ends is laid out in the order of the classes into full sequences, and
the one rest is cut at powers of two, which need no padding either.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table
from .tokens import load, vocabulary

CAPACITY = 2048
END = 1
#: Sequence ids are worker * WORKER + the number within the worker.
WORKER = 1 << 36
#: Distinct words that a worker remembers, the longest word worth remembering, and words that are learned at once.
REMEMBERED, LONGEST, LEARNED = 800_000, 48, 20_000
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
#: Words, each with the space before it. They are cut at a space between two characters that are no white space under any
#: rule, and where letters end before ASCII punctuation (the fixed ranges): a token of a byte-level vocabulary may begin
#: there, but none crosses.
_PLAIN, _LETTER, _MARK = "!-~À-ɏ", "A-Za-zÀ-ÖØ-öø-ɏ", "!-/:-@\\[-`{-~"
_WORDS = re.compile(f" ?[{_LETTER}]+(?=[{_MARK}]| [{_PLAIN}]|\\Z)| ?[{_PLAIN}]+(?= [{_PLAIN}]|\\Z)| ?(?:(?! [{_PLAIN}]).|(?<![{_PLAIN}]).)+", re.S)


class Encoder:
    """Ids of whole texts by a byte-level BPE vocabulary: each distinct word goes through its library once."""

    _of: dict[str, Encoder] = {}

    def __init__(self, path: str):
        self.library = load(path)
        self.known: dict[str, bytes] = {}  # the ids of a word as little-endian 32-bit integers
        tokens = json.loads(self.library.to_str())["added_tokens"]
        self.special = [t["content"] for t in tokens]
        #: A token that ends words before and behind it, so that many can be encoded as one text.
        self.between = next(((t["content"], t["id"]) for t in tokens if not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])), None)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this worker process, which later tasks use again."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _learn(self, words: list[str]) -> None:
        alone = [w for w in words if self.between is None or any(s in w for s in self.special)]
        for word in alone:
            self.known[word] = np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        many = words if not alone else [w for w in words if w not in self.known]
        if many:
            text, number = self.between
            found = np.array(self.library.encode_batch_fast([text.join(many)], add_special_tokens=False)[0].ids, "<u4")
            at, data = np.flatnonzero(found == number), found.tobytes()
            starts, stops = 4 * np.append(0, at + 1), 4 * np.append(at, len(found))
            self.known.update(zip(many, map(data.__getitem__, map(slice, starts.tolist(), stops.tolist())), strict=True))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        split, known = [_WORDS.findall(t) for t in texts], self.known
        new = list(set().union(*split).difference(known))
        for at in range(0, len(new), LEARNED):
            self._learn(new[at : at + LEARNED])
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4") for words in split]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        return out


class Bins:
    """The open bins of one worker; a piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, worker: int, capacity: int = CAPACITY):
        self.capacity, self.next = capacity, worker * WORKER
        self.open: dict[int, list] = {}  # by class: fewer pieces than the class's count
        self.gaps: deque[list] = deque()  # bins with their count of pieces, but room left: [room, pieces]

    def _close(self, pieces: list) -> list:
        at, self.next, out = 0, self.next + 1, []
        for doc_id, start, tokens, ids in pieces:
            out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), tokens, self.next - 1, at))
            at += len(ids)
        return out

    def add(self, doc_id, ids: np.ndarray) -> list:
        """Place a document; the pieces of all bins that this closes come back as rows."""
        out, at, total = [], 0, len(ids)
        while at < total:
            left = total - at
            if left >= self.capacity:
                out += self._close([(doc_id, at, total, ids[at : at + self.capacity])])
                at += self.capacity
            elif self.gaps:
                room, pieces = self.gaps[0]
                n = min(room, left)
                pieces.append((doc_id, at, total, ids[at : at + n]))
                self.gaps[0][0] -= n
                at += n
                if n == room:
                    out += self._close(self.gaps.popleft()[1])
            else:
                k = self.capacity // left
                bin_ = self.open.setdefault(k, [])
                bin_.append((doc_id, at, total, ids[at:]))
                at = total
                if len(bin_) == k:
                    del self.open[k]
                    room = self.capacity - sum(len(p[3]) for p in bin_)
                    if room:
                        self.gaps.append([room, bin_])
                    else:
                        out += self._close(bin_)
        return out

    def rest(self) -> list:
        """Close all bins: their pieces fill sequences in the order of the classes, the last ids go to sequences of powers of two."""
        left = deque(p for pieces in [*(g[1] for g in self.gaps), *(self.open[k] for k in sorted(self.open))] for p in pieces)
        self.gaps, self.open, out = deque(), {}, []
        total = sum(len(p[3]) for p in left)
        sizes = [self.capacity] * (total // self.capacity) + [1 << b for b in reversed(range(self.capacity.bit_length() - 1)) if total % self.capacity >> b & 1]
        for size in sizes:
            some = []
            while size:
                doc_id, start, tokens, ids = left.popleft()
                some.append((doc_id, start, tokens, ids[:size]))
                if len(ids) > size:
                    left.appendleft((doc_id, start + size, tokens, ids[size:]))
                size -= min(size, len(ids))
            out += self._close(some)
        return out


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``capacity`` is a power of two. A document is its ids and the id ``end``, so a null or empty
    text is one piece of one id. Every id lies in exactly one piece; pieces are gapless in their
    sequence; every sequence is full, or as long as a smaller power of two (these are at most
    log2(capacity) for each worker). A worker holds at most ``capacity`` ids for each class with an open bin.
    Repeated rows are packed each, a null doc_id stays null; other columns are ignored.
    ``path`` is a vocabulary file that exists on every worker. Workers are Spark partitions:
    a retried task gives the same ids, since a partition of a file scan has the same rows.
    """

    def place(batches):
        encoder, bins = Encoder.of(path), Bins(TaskContext.get().partitionId(), capacity)

        def rows(pieces):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pieces, strict=True)], _COLUMNS)

        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.ids([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                out += bins.add(doc_id, np.append(ids, np.uint32(end)))
            if out:
                yield rows(out)
        if out := bins.rest():
            yield rows(out)

    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), place, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
