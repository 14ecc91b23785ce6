"""Benchmark decontamination by an FM-index of each training shard.

A shard is what a task holds of its partition at once, up to SHARD words. All its words become symbols: 1
for any word that no benchmark item holds, 2, 3, ... for the others. The shard's suffix order gives the Burrows-Wheeler
transform in a wavelet matrix, and every SAMPLE-th suffix position is kept. All phrases are searched backwards at once by
wavelet ranks, their occurrences located by walking to sampled positions, and their spans
merged for each document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, written
from .words import ALNUM, word_hashes

WINDOW = 10
SAMPLE = 16
#: Words and text bytes of one shard (a document of more is one by itself), and words of one chunk: a document of more is
#: cut into chunks that overlap by the longest phrase less one, so that no two suffixes agree in more symbols.
SHARD, SHARD_BYTES = 1 << 19, 8 << 20
CHUNK = 1024
#: Bytes of benchmark text that are broadcast at once; a larger benchmark is taken in blocks.
BLOCK_BYTES = 16 << 20


class Wavelet:
    """Wavelet matrix over symbols: access and rank for many positions at once."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.levels = len(symbols), max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bits = (symbols >> level) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bits, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` symbols equal ``symbol``."""
        at, low = at.copy(), np.zeros_like(at)
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.levels - 1 - i)) & 1 == 1
            a, b = ones[at], ones[low]
            at = np.where(bit, zeros + a, at - a)
            low = np.where(bit, zeros + b, low - b)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        at, out = at.copy(), np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a = ones[at]
            bit = ones[at + 1] - a
            out = 2 * out + bit
            at = np.where(bit == 1, zeros + a, at - a)
        return out


class FMIndex:
    """Index of symbol chunks, each closed by the separator 0; separators are ordered by position."""

    def __init__(self, symbols: np.ndarray, chunk_starts: np.ndarray, sigma: int):
        n = len(symbols)
        # rank by the first 1, 2, 4, ... symbols; a separator ends the comparison and differs from all others
        separators = np.flatnonzero(symbols == 0)
        key = symbols.astype(np.int64) + len(separators)
        key[separators] = np.arange(len(separators))
        order = np.argsort(key, kind="stable")
        first = np.diff(key[order], prepend=-1) != 0
        rank = np.empty(n, np.int64)
        group = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # a group's rank is its first row
        rank[order] = group
        width = 1
        tied = np.flatnonzero(~(first & np.append(first[1:], True)))  # rows of groups of more than one
        while len(tied):
            at = order[tied]
            after = rank[np.minimum(at + width, n - 1)]  # a tied suffix goes on for at least ``width`` symbols
            new = np.lexsort((after, rank[at]))
            at, after = at[new], after[new]
            order[tied] = at
            old = rank[at]
            begins = np.append(True, (old[1:] != old[:-1]) | (after[1:] != after[:-1]))
            rank[at] = np.maximum.accumulate(np.where(begins, tied, 0))
            tied = tied[~(begins & np.append(begins[1:], True))]
            width *= 2
        self.suffixes = order
        before = symbols[self.suffixes - 1]  # position 0 gets the last symbol, which is a separator
        self.wavelet = Wavelet(before.astype(np.int64), sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        # a chunk's first position is sampled as well: nothing walks over a separator
        sampled = np.zeros(n, bool)
        sampled[::SAMPLE] = True
        sampled[chunk_starts] = True
        self.marked = sampled[self.suffixes]
        self.position = self.suffixes[self.marked]
        self.marked_before = np.cumsum(self.marked) - 1
        del self.suffixes

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, last row + 1) of the phrases, all of one length, that occur."""
        live = np.arange(len(phrases))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.wavelet.n, np.int64)
        for column in reversed(range(phrases.shape[1])):
            symbol = phrases[live, column]
            low = self.first[symbol] + self.wavelet.rank(symbol, low)
            high = self.first[symbol] + self.wavelet.rank(symbol, high)
            keep = low < high
            live, low, high = live[keep], low[keep], high[keep]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, by stepping back to a sampled one."""
        out, live, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(live):
            done = self.marked[rows]
            out[live[done]] = self.position[self.marked_before[rows[done]]] + steps
            live, rows = live[~done], rows[~done]
            symbol = self.wavelet.access(rows)
            rows = self.first[symbol] + self.wavelet.rank(symbol, rows)
            steps += 1
        return out


class Phrases:
    """Windows of a block of benchmark items, as symbols of its vocabulary: 2, 3, ...; 1 is any other word."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        hashes, counts = word_hashes([t for _, t in items], ALNUM)
        self.vocabulary = np.unique(hashes)
        symbols = np.searchsorted(self.vocabulary, hashes) + 2
        owners: dict[tuple, set[str]] = {}
        at = 0
        for (item, _), n in zip(items, counts, strict=True):
            for i in range(at, at + max(1, n - window + 1) if n else at):
                owners.setdefault(tuple(symbols[i : min(i + window, at + n)].tolist()), set()).add(item)
            at += n
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for size in sorted({len(p) for p in owners}):
            some = sorted(p for p in owners if len(p) == size)
            self.by_length[size] = np.array(some, np.int64), [sorted(owners[p]) for p in some]
        self.shortest, self.longest = min(self.by_length, default=0), max(self.by_length, default=0)
        # most words of a text are not in the vocabulary: a table of hash prefixes tells so at once
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), np.int64)
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 2, 1)
        return out


def _chunks(counts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of chunks of documents of ``counts`` words; each place where a phrase can lie is in one of them."""
    step = max(CHUNK, 2 * longest) - longest + 1
    start = np.cumsum(counts) - counts
    pieces = np.where(counts > 0, np.maximum(1, -(-(counts - longest + 1) // step)), 0)
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(start, pieces) + step * number
    return first, np.minimum(np.repeat(start + counts, pieces), first + step + longest - 1) - first


def _occurrences(symbols: np.ndarray, counts: np.ndarray, phrases: Phrases):
    """(first word, phrase length, phrase, owners) of all occurrences in a shard."""
    if not phrases.by_length or not len(symbols):
        return
    first, size = _chunks(counts, phrases.longest)
    begin = np.cumsum(size + 1) - (size + 1)
    chunk = np.repeat(np.arange(len(size)), size + 1)
    inside = np.arange(len(chunk)) - begin[chunk]
    word = np.minimum(first[chunk] + inside, len(symbols) - 1)
    index = FMIndex(np.where(inside < size[chunk], symbols[word], 0), begin, len(phrases.vocabulary) + 2)
    for length, (patterns, owners) in phrases.by_length.items():
        found, low, high = index.search(patterns)
        if not len(found):
            continue
        many = high - low
        rows = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        yield word[index.locate(rows)], length, np.repeat(found, many), owners


def _marked(hashes: np.ndarray, counts: np.ndarray, phrases: Phrases) -> tuple:
    """For each document of a shard: hit words, items with an occurrence, and merged hit spans."""
    bounds = np.cumsum(counts)
    marks, items = np.zeros(len(hashes) + 1, np.int32), [set() for _ in counts]
    for words, length, which, owners in _occurrences(phrases.symbols(hashes), counts, phrases):
        np.add.at(marks, words, 1)
        np.add.at(marks, words + length, -1)
        pairs = np.unique(np.searchsorted(bounds, words, side="right") * len(owners) + which)
        for pair in pairs.tolist():
            items[pair // len(owners)].update(owners[pair % len(owners)])
    hit = np.cumsum(marks[:-1]) > 0
    upto = np.concatenate([[0], np.cumsum(hit)])
    n_hit = upto[bounds] - upto[bounds - counts]
    spans = [[]] * len(counts)
    for i in np.flatnonzero(n_hit):
        edge = np.diff(hit[bounds[i] - counts[i] : bounds[i]].astype(np.int8), prepend=0, append=0)
        spans[i] = np.ravel([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], order="F").tolist()
    return n_hit, [sorted(x) for x in items], spans


def _scan(batches, phrases: Phrases, text: int = 1):
    """(batch, words, hit words, items, spans) of batches whose column ``text`` has the texts, shard by shard."""
    held, words, size = [], 0, 0  # batches of the open shard

    def closed():
        n_hit, items, spans = _marked(np.concatenate([h for _, h, _ in held]), np.concatenate([c for _, _, c in held]), phrases)
        at = 0
        for batch, _, counts in held:
            stop = at + len(counts)
            yield batch, counts, n_hit[at:stop], items[at:stop], spans[at:stop]
            at = stop

    for batch in batches:
        hashes, counts = word_hashes([t or "" for t in batch.column(text).to_pylist()], ALNUM)
        held.append((batch, hashes, counts))
        words, size = words + len(hashes), size + batch.nbytes
        if words >= SHARD or size >= SHARD_BYTES:
            yield from closed()
            held, words, size = [], 0, 0
    if held:
        yield from closed()


def _row_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


_OUT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<long>"


def _blocks(benchmark: DataFrame, most: int) -> list[DataFrame]:
    rows = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-size // most)
    if n <= 1:
        return [rows]
    rows = written(rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")), "benchmark")
    return [rows.filter(F.col("block") == b).drop("block") for b in range(n)]


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``documents``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    Null and empty texts have no words; null items have no phrase; an item with fewer words than
    ``window`` is one phrase, one without words none. Repeated item ids count once. ``spans`` are
    the merged hits as [start, stop, ...] word numbers, in order and apart. Repeated rows each get a row, a null doc_id stays
    null; extra columns are ignored. A benchmark of more than ``block_bytes`` is searched in blocks, one broadcast
    after the other, and each document's spans and items of all blocks are merged.
    """
    spark = documents.sparkSession
    blocks = _blocks(benchmark, block_bytes)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def searched(sent, rows: DataFrame, extra: list[str]) -> DataFrame:
        def run(batches):
            for batch, n, n_hit, items, spans in _scan(batches, sent.value):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(batch.column(2 + i) for i in range(len(extra))), pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array(map(_row_of, items), pa.string()), pa.array(n_hit > 0), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))],
                    ["doc_id", *extra, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
                )

        return map_arrow(rows, run, "doc_id long, " + "".join(f"{x} long, " for x in extra) + _OUT)

    if len(blocks) == 1:
        return searched(_sent(blocks[0], window), rows, [])
    rows, parts = written(rows.withColumn("_row", F.monotonically_increasing_id()), "rows"), []
    for block in blocks:
        sent = _sent(block, window)
        parts.append(written(searched(sent, rows, ["_row"]).filter("contaminated"), "hits"))
        sent.destroy()
    hits = spark.read.schema(parts[0].schema).parquet(*[p._written_at for p in parts])
    hits = hits.groupBy("_row").agg(F.flatten(F.collect_list("items")).alias("items"), F.collect_list("spans").alias("all"))
    count = map_arrow(rows, _counted, "_row long, doc_id long, n_words long")
    items = F.coalesce(F.array_sort(F.array_distinct("items")), F.array().cast("array<string>"))
    merged = map_arrow(hits.select("_row", "items", F.flatten("all").alias("all")), _merged, "_row long, items array<string>, spans array<long>, n_hit long")
    return count.join(merged, "_row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        items.alias("items"),
        F.coalesce("spans", F.array().cast("array<long>")).alias("spans"),
    )


def _sent(block: DataFrame, window: int):
    return block.sparkSession.sparkContext.broadcast(Phrases([tuple(r) for r in block.collect()], window))


def _counted(batches):
    for batch in batches:
        _, counts = word_hashes([t or "" for t in batch.column(1).to_pylist()], ALNUM)
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(counts, pa.int64())], ["_row", "doc_id", "n_words"])


def _merged(batches):
    """Overlapping and touching spans of one document put together, and their words."""
    for batch in batches:
        spans = []
        for found in batch.column(2).to_pylist():
            out: list[int] = []
            for start, stop in sorted(zip(found[::2], found[1::2], strict=True)):
                if out and start <= out[-1]:
                    out[-1] = max(out[-1], stop)
                else:
                    out += (start, stop)
            spans.append(out)
        n = [sum(x[1::2]) - sum(x[::2]) for x in spans]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int64())), pa.array(n, pa.int64())], ["_row", "items", "spans", "n_hit"])


def keep_clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows, with all columns, that hold no phrase of the benchmark.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark lets all rows stay.
    """
    at, blocks = documents.columns.index("text"), _blocks(benchmark, block_bytes)
    for block in blocks:
        sent = _sent(block, window)

        def run(batches, sent=sent):
            for batch, _, n_hit, _, _ in _scan(batches, sent.value, at):
                yield batch.filter(pa.array(n_hit == 0))

        documents = map_arrow(documents, run, documents.schema)
        if len(blocks) > 1:
            documents = written(documents, "clean")
            sent.destroy()
    return documents


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")


OP8_SQL = r"""
WITH low AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark WHERE text IS NOT NULL
),
w AS (SELECT kind, r, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low),
iw AS (
  SELECT DISTINCT id AS item_id, least(len(ws), 10) AS size,
         array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS win
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 10 + 1, 1) + 1)) AS i) AS s
  WHERE kind = 'b' AND len(ws) > 0
),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT r, i, size, array_to_string(ws[i : i + size - 1], ' ') AS win
  FROM w, sizes, LATERAL (SELECT unnest(range(1, len(ws) - size + 2)) AS i) AS s
  WHERE kind = 'd'
),
hit AS (SELECT dw.r, dw.i, dw.size, iw.item_id FROM dw JOIN iw ON dw.size = iw.size AND dw.win = iw.win),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
its AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r
)
SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (r) LEFT JOIN its USING (r) WHERE kind = 'd'
"""
