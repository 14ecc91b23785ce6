"""Full-text search by query strings over a stored index that grows by segments.

A query is what a user types: words and "quoted phrases" that all have to be there, AND, OR, NOT and
parentheses, ``word*`` for words that begin so, ``kind:`` or ``{kind content}:`` before what is looked
for in these columns only (``-kind:`` in all others), ``^`` before what begins a column, ``+`` between
parts of one phrase. AND, OR and NOT are operators in capitals only; NOT binds closest, then AND, then
OR, and words side by side bind closer than any. NEAR is not offered. What is no query raises ``QueryError``.

All phrases of a query are found in one pass over the postings of its terms, which lie together on
disk. A blob's phrases become one row of counts, so that the query is one expression over columns:
no joins, however deeply it is nested.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import exists, remove
from ..functions.text import plain_tokens, stemmed, tokens
from .search import B, K1, PART_BYTES, dealt, lengths, postings
from .store import first_wins

COLUMNS = ("kind", "content")
#: Parts of a query string: a quoted string, a bare word, an operator's character.
PART = re.compile(r'[ \t\r\n]*(?:"((?:[^"]|"")*)"|([A-Za-z0-9_\x1a\x80-\U0010ffff]+)|([(){}:,+*^-])|$)')
INDEX = {
    "postings": "hash STRING, column STRING, position INT, term STRING, segment STRING",
    "lengths": "hash STRING, length BIGINT, segment STRING",
    "totals": "segment STRING, replaces ARRAY<STRING>, stem BOOLEAN, blobs BIGINT, tokens BIGINT",
}
#: What a file of postings is sorted by.
ORDER = ("term", "hash", "column", "position")


class QueryError(ValueError):
    """The query string is no query."""


@dataclass(frozen=True)
class Phrase:
    """Strings that follow each other (each with whether it is a prefix), the columns they are looked for in, whether they begin one."""

    strings: tuple[tuple[str, bool], ...]
    columns: frozenset[str] | None = None
    begins: bool = False


@dataclass(frozen=True)
class Both:
    """``kind`` is AND, OR, NOT, or SIDE for what stands side by side."""

    kind: str
    left: object
    right: object


class _Parser:
    def __init__(self, query: str):
        self.parts, at = [], 0
        while at < len(query):
            found = PART.match(query, at)
            if found is None or found.end() == at:
                raise QueryError(f"not understood at {query[at:at + 20]!r}")
            quoted, word, sign = found.groups()
            if quoted is not None:
                self.parts.append(("string", quoted.replace('""', '"')))
            elif word is not None:
                self.parts.append((word, word) if word in ("AND", "OR", "NOT") else ("string", word))
            elif sign is not None:
                self.parts.append((sign, sign))
            at = found.end()
        self.at = 0

    def next(self, ahead: int = 0) -> str | None:
        return self.parts[self.at + ahead][0] if self.at + ahead < len(self.parts) else None

    def take(self, kind: str) -> str:
        if self.next() != kind:
            raise QueryError(f"expected {kind}, found {self.next() or 'the end'}")
        self.at += 1
        return self.parts[self.at - 1][1]

    def level(self, kinds: tuple[str, ...] = ("OR", "AND", "NOT")) -> object:
        """Operators of the first kind between operands of the others, from the left."""
        if not kinds:
            return self.unit()
        node = self.level(kinds[1:])
        while self.next() == kinds[0]:
            self.at += 1
            node = Both(kinds[0], node, self.level(kinds[1:]))
        return node

    def columns(self) -> frozenset[str] | None:
        """Columns before a colon, None where there are none."""
        start, other = self.at, self.next() == "-"
        self.at += other
        names = []
        if self.next() == "{":
            self.at += 1
            while self.next() == "string":
                names.append(self.take("string"))
            self.take("}")
        elif self.next() == "string" and self.next(1) == ":":
            names.append(self.take("string"))
        elif other:
            raise QueryError("a column is missing after -")
        else:
            self.at = start
            return None
        self.take(":")
        for name in names:
            if name.lower() not in (*COLUMNS, "hash"):
                raise QueryError(f"no such column: {name}")
        found = frozenset(n.lower() for n in names)
        return frozenset(COLUMNS) - found if other else found

    def unit(self) -> object:
        node, sides = None, 0
        while True:
            columns = self.columns()
            if self.next() == "(":
                if sides:
                    raise QueryError("an operator is missing before (")
                self.at += 1
                node = self.level()
                self.take(")")
                return node if columns is None else _within(node, columns)
            phrase = self.phrase()
            phrase = phrase if columns is None else replace(phrase, columns=columns)
            node, sides = (phrase if node is None else Both("SIDE", node, phrase)), sides + 1
            if self.next() not in ("string", "^", "{", "-"):
                return node

    def phrase(self) -> Phrase:
        begins = self.next() == "^"
        self.at += begins
        strings = []
        while True:
            if self.next() == "string" and self.parts[self.at][1] == "NEAR" and self.next(1) == "(":
                raise QueryError("NEAR is not offered")
            text = self.take("string")
            star = self.next() == "*"
            self.at += star
            strings.append((text, star))
            if self.next() != "+":
                return Phrase(tuple(strings), None, begins)
            self.at += 1


def _within(node, columns: frozenset[str]):
    """The node with all its phrases looked for in ``columns`` only."""
    if isinstance(node, Phrase):
        return replace(node, columns=columns if node.columns is None else columns & node.columns)
    return Both(node.kind, _within(node.left, columns), _within(node.right, columns))


def parse(query: str):
    """The tree of a query string; None for an empty one, ``QueryError`` for what is no query."""
    parser = _Parser(query)
    if not parser.parts:
        return None
    node = parser.level()
    if parser.next() is not None:
        raise QueryError(f"not understood from {parser.parts[parser.at][1]!r}")
    return node


def phrases_of(node) -> list[Phrase]:
    """The phrases of a tree from left to right, repeated ones each."""
    if node is None:
        return []
    return [node] if isinstance(node, Phrase) else phrases_of(node.left) + phrases_of(node.right)


# -- the stored index ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """Postings (hash, column, position, term), lengths (hash, length), one row of totals (blobs, tokens), and whether terms are stems."""

    postings: DataFrame
    lengths: DataFrame
    totals: DataFrame
    stem: bool


def _segments(spark: SparkSession, path: str) -> tuple[list[str], bool | None]:
    """Finished segments that no finished merge replaces: names of runs, not of data."""
    if not exists(spark, f"{path}/totals"):
        return [], None
    rows = spark.read.schema(INDEX["totals"]).parquet(f"{path}/totals").select("segment", "replaces", "stem").collect()
    gone = {s for r in rows for s in r["replaces"]}
    return sorted(r["segment"] for r in rows if r["segment"] not in gone), next((r["stem"] for r in rows), None)


def _store(rows: DataFrame, hashes: DataFrame, path: str, stem: bool, replaces: list[str]) -> None:
    """Write a segment: postings as they are dealt and sorted, lengths of all ``hashes``, and last the totals, without which it does not count.

    A blob's postings lie in one file, so a file names few hashes, once each. A search reads of each file the pages of its terms, hence short ones.
    """
    spark, segment = rows.sparkSession, uuid.uuid4().hex
    rows.select("hash", "column", "position", "term").write.option("parquet.page.row.count.limit", 4096).parquet(f"{path}/postings/segment={segment}")
    counted = lengths(spark.read.schema("hash STRING").parquet(f"{path}/postings/segment={segment}"))
    # a blob without any word still is one of the blobs that scores count
    size = hashes.join(counted, "hash", "left").select("hash", F.coalesce("length", F.lit(0)).cast("long").alias("length"))
    size.write.parquet(f"{path}/lengths/segment={segment}")
    done = spark.read.schema("hash STRING, length BIGINT").parquet(f"{path}/lengths/segment={segment}")
    totals = done.agg(F.count("*").alias("blobs"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
    named = totals.select(F.lit(segment).alias("segment"), F.lit(replaces).cast("array<string>").alias("replaces"), F.lit(stem).alias("stem"), "blobs", "tokens")
    named.write.mode("append").parquet(f"{path}/totals")


def _parts(blobs: DataFrame) -> int:
    """Into how many parts to deal the blobs, judged by the bytes of a sixteenth of the hashes, so that not all texts are moved for it."""
    some = blobs.filter(F.pmod(F.xxhash64("hash"), F.lit(16)) == 0).agg(F.sum(F.octet_length("content").cast("long")).alias("bytes")).first()
    return 1 + 16 * (some["bytes"] or 0) // PART_BYTES


def add(blobs: DataFrame, path: str, stem: bool = True) -> None:
    """Index the blobs (hash, kind, content) whose hash the index does not hold yet, as a new segment; of a repeated hash the first by content.

    What is stored is not touched, so the cost is that of the new blobs and of one anti-join on hashes. Texts are dealt by hash;
    words, many times their size as rows, stay in the task that split them, which sorts them by term (stemmed ones by word).
    A run that is cut off leaves a segment without totals, which no search reads.
    """
    spark = blobs.sparkSession
    segments, stored = _segments(spark, path)
    if stored is not None and stored != stem:
        raise ValueError("the index was built with other terms")
    new = blobs.select("hash", "kind", "content")
    if segments:
        new = new.join(read(spark, path).lengths.select("hash"), "hash", "left_anti")
    rows = postings(first_wins(dealt(new, _parts(new)), ["bucket", "hash"], ["kind", "content"]), stem)
    _store(rows if stem else rows.sortWithinPartitions(*ORDER), new.select("hash").distinct(), path, stem, [])


def read(spark: SparkSession, path: str) -> Index:
    """The index of all finished segments."""
    segments, stem = _segments(spark, path)
    if not segments:
        raise FileNotFoundError(f"no finished segment in {path}")
    part = lambda what: spark.read.schema(INDEX[what]).option("basePath", f"{path}/{what}").parquet(*[f"{path}/{what}/segment={s}" for s in segments]).drop("segment")
    totals = spark.read.schema(INDEX["totals"]).parquet(f"{path}/totals").filter(F.col("segment").isin(segments))
    return Index(part("postings"), part("lengths"), totals.agg(F.sum("blobs").alias("blobs"), F.sum("tokens").alias("tokens")), bool(stem))


def merge(spark: SparkSession, path: str) -> None:
    """Make one segment of all, in as few files as its size asks for; the old ones go once the new one is finished."""
    segments, stem = _segments(spark, path)
    if len(segments) < 2:
        return
    index = read(spark, path)
    rows = dealt(index.postings, 1 + index.totals.first()["tokens"] // (PART_BYTES // 6))
    _store(rows.sortWithinPartitions(*ORDER), index.lengths.select("hash"), path, bool(stem), segments)
    for s in segments:
        remove(spark, f"{path}/postings/segment={s}")
        remove(spark, f"{path}/lengths/segment={s}")


def of_blobs(blobs: DataFrame, stem: bool = True) -> Index:
    """An index that is not stored, for small collections."""
    rows = postings(blobs, stem)
    size = blobs.select("hash").distinct().join(lengths(rows), "hash", "left").select("hash", F.coalesce("length", F.lit(0)).cast("long").alias("length"))
    return Index(rows, size, size.agg(F.count("*").alias("blobs"), F.sum("length").alias("tokens")), stem)


def vocabulary(index: Index) -> DataFrame:
    """One row: the number of different terms.

    Each task shuffles every term that it meets once, so few tasks read many files each: a task for each would shuffle the common words of all
    of them, more than the input grows by. Twelve at least, as there may be so many to read.
    """
    files = index.totals.first()["tokens"] // (PART_BYTES // 6)
    return index.postings.select("term").coalesce(max(12, 1 + files // 16)).agg(F.countDistinct("term").alias("terms"))


# -- search --------------------------------------------------------------------------------------


#: Terms of strings that queries held before, so that the stemmer runs once for each.
_KNOWN: dict[tuple[str, bool], list[str]] = {}


def _terms(spark: SparkSession, found: list[Phrase], stem: bool) -> list[list[tuple[str, bool]]]:
    """The terms of each phrase, split and stemmed as the index is, the last of a starred string a prefix."""
    new = sorted({text for p in found for text, _ in p.strings if (text, stem) not in _KNOWN})
    if new:
        if len(_KNOWN) > 10_000:
            _KNOWN.clear()
        words = spark.createDataFrame([(x,) for x in new], "text string").select("text", F.posexplode((tokens if stem else plain_tokens)(F.col("text"))).alias("at", "word"))
        words = stemmed(words, "word", "term") if stem else words.withColumnRenamed("word", "term")
        _KNOWN.update({(x, stem): [] for x in new})
        for r in words.orderBy("text", "at").collect():  # the words of one query
            _KNOWN[r["text"], stem].append(r["term"])
    return [[(t, star and at == len(_KNOWN[text, stem]) - 1) for text, star in p.strings for at, t in enumerate(_KNOWN[text, stem])] for p in found]


def instances(index: Index, found: list[Phrase], terms: list[list[tuple[str, bool]]]) -> DataFrame:
    """(hash, column, phrase, start): where each phrase stands, in one pass over the postings of all their terms."""
    every = [(t, star) for phrase in terms for t, star in phrase]
    if not every:
        return index.postings.limit(0).select("hash", "column", F.lit(0).alias("phrase"), F.col("position").alias("start"))
    exact, prefixes = sorted({t for t, star in every if not star}), sorted({t for t, star in every if star})
    wanted = reduce(Column.__or__, [F.col("term").startswith(p) for p in prefixes], F.col("term").isin(exact))
    places = [
        {"phrase": i, "place": at, "term": t, "star": star, "columns": sorted(COLUMNS if p.columns is None else p.columns), "begins": p.begins, "n": len(terms[i])}
        for i, p in enumerate(found)
        for at, (t, star) in enumerate(terms[i])
    ]
    literal = F.from_json(F.lit(json.dumps(places)), "array<struct<phrase INT, place INT, term STRING, star BOOLEAN, columns ARRAY<STRING>, begins BOOLEAN, n INT>>")
    fits = lambda p: (
        ((p["term"] == F.col("term")) | (p["star"] & F.startswith(F.col("term"), p["term"]))) & F.array_contains(p["columns"], F.col("column")) & (~p["begins"] | (F.col("position") == p["place"]))
    )
    # hashes are keys; a join by them asks for what is not null, and without it here too the places would be read and dealt again for what joins nothing
    rows = index.postings.filter(wanted & F.col("hash").isNotNull()).select("hash", "column", "position", F.explode(F.filter(literal, fits)).alias("p"))
    # dealt by hash, once for all that is counted of a blob; in a set number of parts, as merged ones would be large once they are counted
    parts = int(index.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt_out = rows.select("hash", "column", (F.col("position") - F.col("p.place")).alias("start"), F.col("p.phrase").alias("phrase"), F.col("p.n").alias("n")).repartition(parts, "hash")
    whole = dealt_out.groupBy("hash", "column", "phrase", "start", "n").agg(F.count("*").alias("held"))
    return whole.filter("held = n").select("hash", "column", "phrase", "start")


def _conditions(node, numbers, known: list[list]) -> tuple[Column | None, dict[int, Column]]:
    """Whether a blob is found, None where the node has no word at all, and when each phrase of it counts for its score."""
    if isinstance(node, Phrase):
        i = next(numbers)
        if not known[i]:
            return None, {}
        held = F.col(f"f{i}") > 0
        return held, {i: held}
    (left, a), (right, b) = _conditions(node.left, numbers, known), _conditions(node.right, numbers, known)
    if left is None or right is None:
        if node.kind == "AND":
            return F.lit(False), {}
        if node.kind == "NOT":
            return (None, {}) if left is None else (left, a)
        return (left, a) if right is None else (right, b)
    if node.kind == "OR":
        return left | right, a | b
    found = left & ~right if node.kind == "NOT" else left & right
    return found, {i: c & found for i, c in (a if node.kind == "NOT" else a | b).items()}


def find(index: Index, query: str) -> DataFrame:
    """(hash, rank, instances) of the blobs that a query string finds; lower ranks are better.

    ``instances`` (start, phrase, size) are the places of the content where phrases that count stand, in order.
    A phrase counts where all that it is part of is found. The rank is BM25 over these.
    """
    spark, tree = index.postings.sparkSession, parse(query)
    found = phrases_of(tree)
    terms = _terms(spark, found, index.stem) if found else []
    condition, counts = _conditions(tree, iter(range(len(found))), terms) if tree is not None else (None, {})
    places = instances(index, found, terms)
    place = F.struct("start", "phrase")
    numbers = range(len(found))
    held = places.groupBy("hash").agg(*[F.sum(F.when(F.col("phrase") == i, 1).otherwise(0)).alias(f"f{i}") for i in numbers], F.array_sort(F.collect_list(F.when(F.col("column") == "content", place))).alias("at"))
    if condition is None or not counts:
        return held.filter(F.lit(False)).select("hash", F.lit(0.0).alias("rank"), F.lit(None).cast("array<struct<start:int,phrase:int,size:int>>").alias("instances"))
    many = F.broadcast(held.agg(*[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"n{i}") for i in numbers]))  # one row
    totals = F.broadcast(index.totals.select("blobs", (F.col("tokens") / F.col("blobs")).alias("mean")))  # one row
    rows = held.filter(condition).join(index.lengths, "hash").crossJoin(many).crossJoin(totals)
    score = F.lit(0.0)
    for i, counted in counts.items():
        f, n = F.when(counted, F.col(f"f{i}")).otherwise(0), F.col(f"n{i}")
        idf = F.log((F.col("blobs") - n + 0.5) / (n + 0.5))
        score = score + F.when(idf <= 0, 1e-6).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    sizes = F.array(*[F.lit(len(t)) for t in terms])
    counted = F.array(*[counts.get(i, F.lit(False)) for i in numbers])
    at = F.filter("at", lambda x: F.get(counted, x["phrase"]))
    at = F.transform(at, lambda x: F.struct(x["start"].alias("start"), x["phrase"].alias("phrase"), F.get(sizes, x["phrase"]).alias("size")))
    return rows.select("hash", (-score).alias("rank"), at.alias("instances"))


def page(found: DataFrame, blobs: DataFrame, limit: int = 10, offset: int = 0, words: int = 64) -> DataFrame:
    """A page of what ``find`` found, best first: hash, kind, snippet, rank. Only the page's texts are read."""
    chosen = found.orderBy("rank", "hash").offset(offset).limit(limit)
    shown = blobs.join(F.broadcast(chosen.select("hash")), "hash", "left_semi").select("hash", "kind", "content")  # one page
    return with_snippets(chosen.join(shown, "hash"), words).select("hash", "kind", "snippet", "rank")


def with_snippets(rows: DataFrame, words: int = 64, before: str = "<mark>", after: str = "</mark>", left_out: str = "...") -> DataFrame:
    """Adds ``snippet``: the window of ``words`` words of ``content`` that shows most of ``instances`` (start, phrase, size; in order), each marked.

    A window that begins at a place scores 1,000 for each phrase in it and 1 for each repetition, and is then centred;
    one that begins with the sentence of a place, where the text is longer, scores 100 more, the text's first 120.
    The first of the best is shown, '...' where text is left out; overlapping places are one mark.
    """
    pattern = r"[\p{L}\p{N}\p{M}]*[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"
    word = lambda p: F.regexp_extract(p, f"^({pattern})", 1)
    places, n, begin, stop = F.col("instances"), F.col("_n"), F.col("_begin"), F.col("_stop")
    kept = rows.columns
    # words with what follows them, and the words that begin a sentence
    rows = rows.withColumn("_pieces", F.regexp_extract_all("content", F.lit(f"({pattern})([^\\p{{L}}\\p{{N}}]*)"), 0)).withColumn("_n", F.size("_pieces"))
    begins = F.transform("_pieces", lambda p, i: F.when((i == 0) | F.get("_pieces", i - 1).rlike(r"[.:][ \t\r\n]+$"), i))
    rows = rows.withColumn("_firsts", F.filter(begins, lambda i: i.isNotNull()))
    # (place, begin of its window, what is added to the score) of both windows of each place
    sentence = lambda x: F.coalesce(F.array_max(F.filter("_firsts", lambda s: s <= x["start"])), F.lit(0))
    window = lambda begin, centred: F.struct(begin.cast("int").alias("begin"), F.lit(centred).alias("centred"))
    windows = F.flatten(F.transform(places, lambda x: F.array(window(x["start"], True), window(sentence(x), False))))
    rows = rows.withColumn("_windows", windows)
    inside = lambda w: F.filter(places, lambda x: (x["start"] >= w["begin"]) & (x["start"] < w["begin"] + words))
    rows = rows.withColumn("_windows", F.transform("_windows", lambda w: F.struct(w["begin"].alias("begin"), w["centred"].alias("centred"), inside(w).alias("inside"))))

    def scored(w):
        different = F.size(F.array_distinct(F.transform(w["inside"], lambda x: x["phrase"])))
        score = different * 1000 + F.size(w["inside"]) - different
        first, last = F.get(w["inside"], F.lit(0)), F.get(w["inside"], F.size(w["inside"]) - 1)
        spare = words - (last["start"] + last["size"] - first["start"])
        middle = F.greatest(F.lit(0), F.least(first["start"] - F.when(spare < 0, -F.floor(-spare / 2)).otherwise(F.floor(spare / 2)).cast("int"), n - words))
        return F.struct(
            F.when(w["centred"], score).otherwise(score + F.when(w["begin"] == 0, 120).otherwise(100)).alias("score"), F.when(w["centred"], middle).otherwise(w["begin"]).alias("at")
        )

    # a sentence's window counts only where it begins before the place, of a text longer than a window
    sound = F.filter(F.transform("_windows", lambda w, i: F.when(w["centred"] | ((n > words) & (w["begin"] < F.get(places, (i / 2).cast("int"))["start"])), scored(w))), lambda w: w.isNotNull())
    rows = rows.withColumn("_tries", sound)
    best = F.aggregate("_tries", F.struct(F.lit(0).alias("score"), F.lit(0).alias("at")), lambda a, t: F.when(t["score"] > a["score"], t).otherwise(a))
    rows = rows.withColumn("_begin", best["at"]).withColumn("_stop", F.least(begin + words, n))
    # overlapping places as one, the last one in front
    span = lambda a, b: F.array(F.struct(a.alias("a"), b.alias("b")))
    top = lambda out: F.get(out, F.lit(0))
    end = lambda x: x["start"] + x["size"] - 1
    merged = lambda out, x: F.concat(span(top(out)["a"], F.greatest(top(out)["b"], end(x))), F.slice(out, F.lit(2), F.size(out)))
    spans = F.aggregate(places, F.array().cast("array<struct<a:int,b:int>>"), lambda out, x: F.when((F.size(out) > 0) & (x["start"] <= top(out)["b"]), merged(out, x)).otherwise(F.concat(span(x["start"], end(x)), out)))
    rows = rows.withColumn("_spans", F.filter(spans, lambda s: (s["a"] >= begin) & (s["a"] < stop)))

    def shown(p, j):
        i = begin + j
        opened = F.exists("_spans", lambda s: s["a"] == i)
        closed = F.exists("_spans", lambda s: (s["b"] == i) | ((i == stop - 1) & (s["a"] <= i) & (s["b"] > i)))
        rest = F.when((i == stop - 1) & (stop < n), F.lit("")).otherwise(F.substr(p, F.length(word(p)) + 1))
        return F.concat(F.when(opened, before).otherwise(""), word(p), F.when(closed, after).otherwise(""), rest)

    body = F.array_join(F.transform(F.slice("_pieces", begin + 1, F.lit(words)), shown), "")
    lead = F.regexp_extract("content", r"^([^\p{L}\p{N}\p{M}]*)", 1)
    return rows.select(*kept, F.concat(F.when(begin > 0, left_out).otherwise(lead), body, F.when(stop < n, left_out).otherwise("")).alias("snippet"))
