"""WARC archives: writing with identical-payload revisits, reading by boundary-chain verification.

Archives are written by Spark's text sink, each record ended by CRLF CRLF, and read by its
text source, split at the magic ``WARC/1.``. So both ways work on any store that Spark reaches
and large files are split among tasks.

Every magic behind a CRLF CRLF is only a candidate record: a payload may hold it too. Each task links its
candidates to their successors (start + header + Content-Length + end) and follows those links
inside its own split, which leaves one exit for each candidate. Pointer jumping over these
exits, from the start of each file, finds where the true chain enters each split; walking the
split from there keeps the reachable records and rejects all other candidates.

Beside its links a task holds one record: it parses the records of the chain that it guesses, from its
first candidate on. Reachable records that were not on it, or go on in a later split, are read again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from bisect import bisect_left

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import dropped, map_arrow, new_path, table, written

MAGIC = b"WARC/1."
END = "\r\n\r\n"
URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are always written whole.
LEAST_REVISIT = 0
_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
_BREAK = re.compile(rb"[\r\n]")


def base32_sha1(column: Column) -> Column:
    """Bare upper-case base32 SHA-1: each ten hex digits are eight digits of base 32."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(column), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, least: int = LEAST_REVISIT, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One text column ``value``: the WARC record of each (page_id, url, html) without its final CRLF CRLF.

    Null html is an empty payload. Of equal payloads of at least ``least`` bytes, rows with the
    smallest page_id are responses and the others revisit it; null ids count as larger than all.
    Line ends in a url are percent-encoded, a null url is ``about:blank``.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("about:blank")).alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    ).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    firsts = written(
        rows.filter(F.octet_length("html") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 AND first IS NOT NULL")
        .select("digest", "first"),
        "firsts",
    )
    rows = rows.join(firsts, "digest", "left")  # Spark splits a digest's rows if they are many
    revisit = F.coalesce(~F.col("first").eqNullSafe(F.col("page_id")) & F.col("first").isNotNull(), F.lit(False))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("html").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    ident = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    refers = F.concat(F.lit("WARC-Refers-To: "), ident(F.col("first")), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        ident(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\n"),
        F.when(revisit, refers).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str, **how) -> None:
    """Write ``pages`` as WARC files of one folder."""
    records(pages, **how).write.option("lineSep", END).text(path)


# -- reading -------------------------------------------------------------------------------


_LENGTH = re.compile("[0-9]{1,18}")


class _Header:
    """Fields of a header that comes in pieces, none of which ends between CR and LF; begins behind the version line."""

    def __init__(self, parts: list[bytes] | None = None):
        self.parts, self.fields, self.end = parts or [], {}, 0

    def feed(self, data: bytes) -> bool | None:
        """True if the header ends in ``data`` (before its byte ``end``), False if it is none, None if it goes on."""
        if not _BREAK.search(data):
            self.parts.append(data)
            return None
        before = sum(map(len, self.parts))
        text, at = b"".join([*self.parts, data]), 0
        while not text.startswith(b"\r\n", at):
            m = _FIELD.match(text, at)
            if m is None:
                self.parts = [text[at:]]
                return False if _BREAK.search(text, at) else None
            self.fields[m[1].decode("utf-8", "replace").strip().lower()] = m[2].decode("utf-8", "replace").strip()
            at = m.end()
        self.end = at + 2 - before
        return True


def _begun(data: bytes) -> tuple[_Header, bool | None, int] | None:
    """The header behind a magic, what feeding it with the rest of ``data`` gave, and where that rest began; None if it is no header."""
    line = data.find(b"\r\n")
    if line < 1 or not data[:line].isdigit():
        return None
    header = _Header()
    state = header.feed(data[line + 2 :])
    return None if state is False else (header, state, line + 2)


def _length(fields: dict[str, str]) -> int | None:
    """The Content-Length of a header, None without one of at most 18 digits."""
    found = fields.get("content-length", "")
    return int(found) if _LENGTH.fullmatch(found) else None


def _parsed(data: bytes) -> tuple | None:
    """Record type, id, URI, refers-to, stated digest, payload length and payload digest (stated for revisits) of a whole record behind its magic."""
    begun = _begun(data)
    if begun is None or not begun[1]:
        return None
    header, _, start = begun
    fields, begin, length = header.fields, start + header.end, _length(header.fields)
    if length is None or "warc-type" not in fields or data[begin + length : begin + length + len(END)] != END.encode():
        return None
    http, _, payload = data[begin : begin + length].partition(b"\r\n\r\n")
    kind, stated = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if kind == "revisit":  # its block holds only the HTTP header, which states the payload's length
        m = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", http)
        size, digest = int(m[1]) if m else None, stated
    return kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), stated, size, digest


_FIELDS = ["record_type", "record_id", "uri", "refers_to", "stated_digest", "payload_bytes", "payload_digest"]
_FIELD_TYPES = "record_type string, record_id string, uri string, refers_to string, stated_digest string, payload_bytes long, payload_digest string"
_LINKS = f"file string, split long, size long, clean boolean, rel long, next long, exit long, edge boolean, length long, typed boolean, tail binary, {_FIELD_TYPES}"
_LINK_SCHEMA = pa.schema(
    [("file", pa.string()), ("split", pa.int64()), ("size", pa.int64()), ("clean", pa.bool_()), ("rel", pa.int64()), ("next", pa.int64()), ("exit", pa.int64())]
    + [("edge", pa.bool_()), ("length", pa.int64()), ("typed", pa.bool_()), ("tail", pa.binary())]
    + [(f, pa.int64() if f == "payload_bytes" else pa.string()) for f in _FIELDS]
)
#: Rows of one batch of links.
_ROWS = 1 << 14


class _Split:
    """Candidates of one split; positions are relative to the split's first line, -1 is none."""

    def __init__(self, file: str, split: int):
        self.file, self.split, self.at, self.clean = file, split, 0, False
        self.rel, self.next = array("q"), array("q")
        self.parsed: dict[int, tuple] = {}
        # candidates whose header has not ended: (number, Content-Length, has a type, line). What all of them
        # wait for is the same, so it is held once; the line that last gave a length or a type counts for those of earlier lines
        self.heads: list[tuple[int, int | None, bool, int]] = []
        self.shared: _Header | None = None
        self.lines, self.length_at, self.type_at = 0, 0, 0
        self.guess, self.parts = -1, []  # the record that is put together

    def _linked(self, i: int, end: int, length: int | None, typed: bool) -> None:
        if length is not None and typed:
            self.next[i] = end + length + len(END)

    def _so_far(self, head: tuple) -> tuple[int | None, bool]:
        _, length, typed, line = head
        return (_length(self.shared.fields) if self.length_at > line else length), typed or self.type_at > line

    def _continue(self, data: bytes) -> None:
        """Open headers go on with a line."""
        known = dict(self.shared.fields)
        self.shared.fields.clear()
        state = self.shared.feed(data)
        new = self.shared.fields
        self.length_at = self.lines if "content-length" in new else self.length_at
        self.type_at = self.lines if "warc-type" in new else self.type_at
        self.shared.fields = {k: v for k, v in (known | new).items() if k == "content-length"}
        if state is None:
            return
        if state:
            for head in self.heads:
                self._linked(head[0], self.at - len(MAGIC) + self.shared.end, *self._so_far(head))
        self.heads, self.shared = [], None

    def line(self, data: bytes) -> None:
        self.lines += 1
        if self.heads:
            self._continue(MAGIC + data)
        first = not self.at
        if self.guess >= 0:
            self.parts += (MAGIC, data)
        if (self.clean or first) and (self.split or not first) and (begun := _begun(data)):
            header, state, start = begun
            i, length, typed = len(self.rel), _length(header.fields), "warc-type" in header.fields
            self.rel.append(self.at - len(MAGIC))
            self.next.append(-1)
            if state:
                self._linked(i, self.at + start + header.end, length, typed)
            else:
                if self.shared is None:
                    self.shared = _Header(header.parts)
                self.heads.append((i, length, typed, self.lines))
            if self.guess < 0 and (self.next[i] >= 0 or not state):
                self.guess, self.parts = i, [data]
        self.at += len(data) + len(MAGIC)
        self.clean = data.endswith(END.encode()) or (first and not self.split and not data)  # or a file begins
        if self.guess >= 0:
            waits = self.next[self.guess] < 0
            if waits and not self.heads:
                self.guess, self.parts = -1, []  # its header was none
            elif not waits and self.at - len(MAGIC) >= self.next[self.guess]:
                if (found := _parsed(b"".join(self.parts))) is not None:
                    self.parsed[self.guess] = found
                self.guess, self.parts = -1, []

    def batches(self):
        n, end = len(self.rel), self.at - len(MAGIC)
        pending = {h[0]: self._so_far(h) for h in self.heads}
        leaves = array("q", [-1]) * n
        for i in range(n - 1, -1, -1):
            if i in pending:  # until it is known, its exit is itself
                leaves[i] = self.rel[i]
            elif self.next[i] >= end:
                leaves[i] = self.next[i]
            elif self.next[i] >= 0:
                j = bisect_left(self.rel, self.next[i])
                leaves[i] = leaves[j] if j < n and self.rel[j] == self.next[i] else -1
        some = lambda x: None if x < 0 else x
        tail = b"".join(self.shared.parts) if self.heads else None
        for at in range(0, max(n, 1), _ROWS):
            rows = []
            for i in range(at, min(n, at + _ROWS)):
                length, typed = pending.get(i, (None, None))
                mine = tail if self.heads and i == self.heads[0][0] else None
                rel = self.rel[i]
                # positions before the split's first line are those of the magic in front of it
                rows.append((rel, None if i in pending else some(self.next[i]), rel if i in pending else some(leaves[i]), bool(self.split) and rel < 0, length, typed, mine, *self.parsed.get(i, [None] * len(_FIELDS))))
            rows = [(self.file, self.split, self.at, self.clean, *r) for r in rows] or [(self.file, self.split, self.at, self.clean, *[None] * (len(_LINK_SCHEMA) - 4))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _LINK_SCHEMA, strict=True)], schema=_LINK_SCHEMA)


def _candidates(batches):
    current = None
    for batch in batches:
        for data, file, split in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if current is None or (current.file, current.split) != (file, split):
                if current is not None:
                    yield from current.batches()
                current = _Split(file, split)
            current.line(data)
    if current is not None:
        yield from current.batches()


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("lineSep", MAGIC.decode())
        .text(path)
        .select(F.col("value").cast("binary").alias("line"), "_metadata.file_path", "_metadata.file_block_start")
    )


def _continuations(batches):
    """What each split adds to a header that has begun before it; open if it does not end it either."""
    schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("part", pa.binary()), ("open", pa.bool_())])
    key, parts, state, header = None, [], None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((*key, b"".join(parts), state is None), schema, strict=True)], schema=schema)

    for batch in batches:
        for data, file, split in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (file, split):
                if key is not None:
                    yield row()
                key, parts, state, header = (file, split), [], None, _Header([b"x:"])
            if state is None:
                state = header.feed(MAGIC + data)
                parts.append((MAGIC + data)[: header.end] if state else MAGIC + data)  # what is no header here is none when put together
    if key is not None:
        yield row()


def _continued(spark: SparkSession, path: str, links: DataFrame, splits: DataFrame) -> DataFrame:
    """``links`` with the successors of candidates whose header goes on in later splits.

    All such candidates of a split wait for the same bytes, so these are put together once for each split.
    """
    pending = links.filter("tail IS NOT NULL").select("file", "split", "size", "tail")
    if pending.isEmpty():
        return links
    files = pending.select(F.col("file").alias("file_path")).distinct()
    parts = map_arrow(_lines(spark, path).join(files, "file_path", "left_semi").select("line", "file_path", "file_block_start"), _continuations, "file string, split long, part binary, open boolean")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum(F.when(F.col("open"), 0).otherwise(1)).over(before), F.lit(0))  # open splits and the one that ends them
    parts = written(splits.select("file", "split").join(parts, ["file", "split"]).withColumn("run", run), "continuations")
    after = parts.select("file", "split", (F.col("run") + F.when(F.col("open"), 0).otherwise(1)).alias("run"))
    later = parts.select("file", "run", F.col("split").alias("later"), "part")
    mine = pending.join(after, ["file", "split"]).join(later, ["file", "run"]).filter("later > split")

    def ended(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("later")
        first, header = pdf.iloc[0], _Header([pdf["tail"].iloc[0]])
        columns = ["file", "split", "end", "new_length", "again", "new_type"]
        if not header.feed(b"".join(pdf["part"])):
            return pd.DataFrame(columns=columns)
        row = [first["file"], first["split"], first["size"] - len(MAGIC) + header.end, _length(header.fields), "content-length" in header.fields, "warc-type" in header.fields]
        return pd.DataFrame([row], columns=columns).astype({"new_length": "Int64"})

    known = mine.groupBy("file", "split").applyInPandas(ended, "file string, split long, end long, new_length long, again boolean, new_type boolean")
    out = links.join(known, ["file", "split"], "left")
    length = F.when(F.col("again"), F.col("new_length")).otherwise(F.col("length"))
    found = F.when(F.col("typed") | F.col("new_type"), F.col("end") + length + len(END))
    waits = F.col("typed").isNotNull()
    out = out.withColumn("next", F.when(waits, found).otherwise(F.col("next"))).withColumn("exit", F.when(waits, found).otherwise(F.col("exit")))
    return written(out.drop("end", "new_length", "again", "new_type"), "links")


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """The records of one split that are reachable from where the chain enters it."""
    after = dict(zip(pdf["rel"], pdf["next"], strict=True))
    at, kept = pdf["entry"].iloc[0], set()
    while at in after and at not in kept:
        kept.add(at)
        at = after[at]
    return pdf[pdf["rel"].isin(kept)]


def _entries(links: DataFrame, splits: DataFrame) -> DataFrame:
    """(file, split, entry): where the chain from the start of each file enters each split, by pointer jumping."""
    placed = links.join(splits.select("file", "split", "base"), ["file", "split"])
    jumps = placed.select("file", (F.col("base") + F.col("rel")).alias("at"), (F.col("base") + F.col("exit")).alias("to"))
    targets = jumps.filter("`to` IS NOT NULL").select("file", F.col("to").alias("at")).distinct()
    starts = splits.filter("split = 0").select("file", F.lit(0).cast("long").alias("at"))
    jumps = written(jumps.filter("`to` IS NOT NULL").join(targets.unionByName(starts).distinct(), ["file", "at"], "left_semi"), "jumps")
    reached, n, most = written(starts, "reached"), -1, splits.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range((2 * most).bit_length()):  # a split may hold two steps: to a header that it does not end, and on
        further = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        old, reached = reached, written(reached.unionByName(further).distinct(), "reached")
        dropped(old)
        if (now := reached.count()) == n:
            break
        n = now
        second = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("end"))
        old, jumps = jumps, written(jumps.join(second, ["file", "to"]).select("file", "at", F.col("end").alias("to")), "jumps")
        dropped(old)
    # a position lies in the last split that begins at or before it: one sort for each file, no range join
    marks = reached.select("file", "at", F.lit(None).cast("long").alias("split"), F.lit(None).cast("long").alias("base"))
    begins = splits.select("file", (F.col("base") - len(MAGIC)).alias("at"), "split", "base")
    spans = begins.unionByName(marks).select("file", "at", F.when(F.col("split").isNotNull(), F.struct("split", "base")).alias("own"), F.col("split").isNull().alias("mark"))
    order = Window.partitionBy("file").orderBy("at", "mark").rowsBetween(Window.unboundedPreceding, 0)
    inside = spans.withColumn("in", F.last("own", ignorenulls=True).over(order)).filter("mark AND in IS NOT NULL")
    return inside.groupBy("file", F.col("in.split").alias("split")).agg(F.min(F.col("at") - F.col("in.base")).alias("entry"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``: file, offset and what ``_parsed`` takes from each.

    Only records that the chain from the start of their file reaches are returned: a magic inside
    a payload is no record. A file that does not begin with a record has none; behind a broken
    or cut record the chain, and so the file's result, ends. Empty files give no rows. A header whose Content-Length is
    not 1 to 18 digits is none.
    """
    links = written(map_arrow(_lines(spark, path), _candidates, _LINKS), "links")
    sizes = links.groupBy("file", "split").agg(F.max("size").alias("size"), F.max("clean").alias("clean"))
    order = Window.partitionBy("file").orderBy("split")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    splits = written(sizes.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("opens", F.coalesce(F.lag("clean").over(order), F.lit(True))), "splits")
    links = _continued(spark, path, links, splits).drop("size", "clean", "tail", "length", "typed")
    # a split's first line is a candidate only if the one before it ends with the end of a record
    links = links.filter("rel IS NOT NULL").join(splits.select("file", "split", "opens"), ["file", "split"]).filter("opens OR NOT edge").drop("opens", "edge")
    entered = links.join(_entries(links, splits), ["file", "split"])
    kept = written(entered.groupBy("file", "split").applyInPandas(_walk, entered.schema), "kept")
    placed = kept.join(splits.select("file", "split", "base"), ["file", "split"]).withColumn("offset", F.col("base") + F.col("rel"))
    out = placed.filter("record_type IS NOT NULL").select("file", "offset", *_FIELDS)
    left = placed.filter("record_type IS NULL AND next IS NOT NULL").select("file", "offset", (F.col("base") + F.col("next")).alias("stop"))
    if left.isEmpty():
        return out
    return out.unionByName(_again(spark, path, splits, written(left, "left")))


def _again(spark: SparkSession, path: str, splits: DataFrame, left: DataFrame) -> DataFrame:
    """Records that no task has put together: their lines, from the splits that they cover only.

    Records of the chain do not overlap, so each line belongs to the last record that begins at or before it.
    """
    width = 64 << 20
    grid = lambda low, high: F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))
    ends = splits.groupBy("file").agg(F.max(F.col("base") + F.col("size")).alias("size"))
    rows = left.join(ends, "file").withColumn("stop", F.least("stop", "size")).drop("size")
    cells = rows.withColumn("cell", grid(F.col("offset"), F.col("stop")))
    spans = splits.select("file", "split", "base", F.col("size").alias("bytes")).withColumn("cell", grid(F.greatest(F.col("base") - len(MAGIC), F.lit(0)), F.col("base") + F.col("bytes")))
    covered = cells.join(spans, ["file", "cell"]).filter("offset < base + bytes AND stop >= base").select("file", "split", "base", "offset", "stop").distinct()
    covered = written(covered, "covered")

    def placed(batches):
        key, at = None, 0
        for batch in batches:
            rel = []
            for size, f, s in zip(batch.column(3).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (f, s) != key:
                    key, at = (f, s), 0
                rel.append(at)
                at += size + len(MAGIC)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rel, pa.int64())], ["line", "file", "split", "rel"])

    lines = map_arrow(_lines(spark, path).withColumn("n", F.octet_length("line")), placed, "line binary, file string, split long, rel long")
    lines = lines.join(covered.select("file", "split", "base").distinct(), ["file", "split"])
    lines = lines.select("file", "split", (F.col("base") + F.col("rel") - len(MAGIC)).alias("at"), "line", F.lit(None).cast("struct<offset:bigint,stop:bigint>").alias("own"))
    begins = covered.select("file", "split", F.greatest(F.col("offset"), F.col("base") - len(MAGIC)).alias("at"), F.lit(None).cast("binary").alias("line"), F.struct("offset", "stop").alias("own"))
    order = Window.partitionBy("file", "split").orderBy("at", F.col("line").isNotNull(), "own").rowsBetween(Window.unboundedPreceding, 0)
    mine = lines.unionByName(begins).withColumn("own", F.last("own", ignorenulls=True).over(order)).filter("line IS NOT NULL AND own IS NOT NULL AND at < own.stop")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        row = _parsed(MAGIC.join(pdf.sort_values("at")["line"]))
        return pd.DataFrame([] if row is None else [[pdf["file"].iloc[0], pdf["offset"].iloc[0], *row]], columns=["file", "offset", *_FIELDS])

    shape = f"file string, offset long, {_FIELD_TYPES}"
    return mine.select("file", "at", "line", "own.offset").groupBy("file", "offset").applyInPandas(join, shape)


def page_rows(read_back: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records that ``write`` made."""
    page = lambda c: F.regexp_extract(c, f"^<{URN}(-?[0-9]+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    return read_back.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return page_rows(read(spark, path))


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
),
b AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first,
         bit_string_digest.d AS payload_digest
  FROM p, LATERAL (
    SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             CAST(1 + ((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) AS INTEGER), 1), ''
             ORDER BY i) AS d
    FROM range(32) t(i)
  ) AS bit_string_digest
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
