"""Ranked full-text search over blobs: postings with positions, BM25, phrases, boolean sets, snippets.

The index is two tables: postings (hash, column, position, term) and lengths (hash, length).
Build it once and store it, sorted by term; a search reads the rows of its terms only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import folded, plain_tokens, stemmed, tokens

K1, B = 1.2, 0.75


#: Bytes of text whose words one task sorts, about: some hundred MB of rows.
PART_BYTES = 16 << 20


def dealt(blobs: DataFrame, parts: int) -> DataFrame:
    """The rows dealt by hash, each ``bucket`` of hashes to a task of its own."""
    return blobs.withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(parts)).cast("int")).repartitionById(parts, F.col("bucket"))


def postings(blobs: DataFrame, stem: bool = True) -> DataFrame:
    """(hash, column, position, term) of the kind and content of each blob.

    Stems are computed once for each distinct word of a ``bucket`` (see ``dealt``): its rows lie sorted by word in one
    task, so the stemmer runs over vocabularies, not over the text, and no word is moved.
    """
    if stem and "bucket" not in blobs.columns:
        blobs = dealt(blobs, int(blobs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    split = tokens if stem else plain_tokens
    columns = F.explode(F.array(F.struct(F.lit("kind").alias("column"), F.col("kind").alias("text")), F.struct(F.lit("content").alias("column"), F.col("content").alias("text"))))
    kept = ["bucket", "hash"] if stem else ["hash"]
    rows = blobs.select(*kept, columns.alias("c")).select(*kept, F.col("c.column").alias("column"), F.posexplode(split(F.col("c.text"))).alias("position", "word"))
    if not stem:
        return rows.withColumnRenamed("word", "term")
    same = Window.partitionBy("bucket", "word").orderBy("hash", "column", "position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = stemmed(rows.withColumn("first", F.when(F.row_number().over(same) == 1, F.col("word"))), "first", "stem")
    return rows.select("hash", "column", "position", F.first("stem").over(same).alias("term"))


def write_index(blobs: DataFrame, path: str, stem: bool = True) -> None:
    """Store the postings sorted by term, so that a search reads only the row groups of its terms."""
    index = postings(blobs, stem)
    index.repartitionByRange("term", "hash").sortWithinPartitions("term", "hash", "column", "position").write.mode("overwrite").parquet(f"{path}/postings")
    lengths(index).write.mode("overwrite").parquet(f"{path}/lengths")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of a stored index."""
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")


def lengths(index: DataFrame) -> DataFrame:
    """Tokens of kind and content of each blob."""
    return index.groupBy("hash").agg(F.count("*").alias("length"))


def phrase_counts(index: DataFrame, terms: list[str], column: str | None = None) -> DataFrame:
    """(hash, f): how often the terms follow each other, within one column, in each blob."""
    if not terms:  # nothing holds a phrase without words
        return index.filter(F.lit(False)).select("hash", F.lit(0).cast("long").alias("f"))
    rows = index.filter(F.col("term").isin(terms))
    if column is not None:
        rows = rows.filter(F.col("column") == column)
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(terms)]))
    rows = rows.withColumn("p", places).filter(F.col("p.t") == F.col("term")).withColumn("start", F.col("position") - F.col("p.i"))
    whole = rows.groupBy("hash", "column", "start").agg(F.countDistinct("p.i").alias("n")).filter(F.col("n") == len(terms))
    return whole.groupBy("hash").agg(F.count("*").alias("f"))


def bm25(index: DataFrame, phrases: list[list[str]], every: bool = True, columns: list[str | None] | None = None, size: DataFrame | None = None) -> DataFrame:
    """(hash, rank): lower is better. Blobs hold all phrases (``every``) or one of them.

    ``columns`` names for each phrase the column that it is looked for in (None: both); ``size`` are stored lengths.

    idf is the natural logarithm of (N - n + 0.5) / (n + 0.5), at least 1e-6; lengths count kind
    and content together.
    """
    size = lengths(index) if size is None else size
    stats = F.broadcast(size.agg(F.count("*").alias("blobs"), F.avg("length").alias("mean")))  # one row
    columns = columns or [None] * len(phrases)
    parts = [phrase_counts(index, p, c).withColumn("phrase", F.lit(i)) for i, (p, c) in enumerate(zip(phrases, columns, strict=True))]
    found = reduce(DataFrame.unionByName, parts)
    many = F.broadcast(found.groupBy("phrase").agg(F.count("*").alias("n")))  # a row for each phrase
    idf = F.log((F.col("blobs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weight = F.when(idf <= 0, 1e-6).otherwise(idf)
    part = weight * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = found.join(many, "phrase").join(size, "hash").crossJoin(stats).groupBy("hash").agg((-F.sum(part)).alias("rank"), F.count("*").alias("held"))
    return scored.filter(F.col("held") == len(phrases)).drop("held") if every else scored.drop("held")


def boolean(index: DataFrame, must: list[list[str]] = (), should: list[list[str]] = (), must_not: list[list[str]] = ()) -> DataFrame:
    """Hashes that hold all of ``must``, one of ``should`` (if any) and none of ``must_not``; each entry is a phrase."""
    sets = [phrase_counts(index, p).select("hash") for p in must]
    if should:
        sets.append(reduce(DataFrame.unionByName, [phrase_counts(index, p).select("hash") for p in should]).distinct())
    out = reduce(lambda a, b: a.join(b, "hash", "left_semi"), sets)
    return reduce(lambda a, p: a.join(phrase_counts(index, p).select("hash"), "hash", "left_anti"), must_not, out)


def hits(ranked: DataFrame, references: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """A page of hits, one for each reference of a blob (with null context where it has none), best first."""
    return ranked.join(references, "hash", "left").orderBy("rank", "hash", "doc_id").offset(offset).limit(limit)


def query_terms(spark: SparkSession, text: str, stem: bool = True) -> list[str]:
    """The terms of what a user typed, all of it one phrase, split (and stemmed) as the index is; no character is an operator."""
    split = tokens if stem else plain_tokens
    words = spark.range(1).select(F.posexplode(split(F.lit(text))).alias("i", "word"))
    words = stemmed(words, "word", "term") if stem else words.withColumnRenamed("word", "term")
    return [r["term"] for r in words.orderBy("i").collect()]  # the words of one query


def with_context(ranked: DataFrame, references: DataFrame, messages: DataFrame, sessions: DataFrame, project: str | None = None) -> DataFrame:
    """Hits with each message that refers to the blob (hash, message_id), its type and its session's slug and summary.

    A blob without a reference stays, with nulls; with ``project`` only hits of that project's sessions do.
    """
    seen = messages.select(F.col("id").alias("message_id"), "type", "session_id")
    known = sessions.select(F.col("id").alias("session_id"), "project_slug", "summary")
    rows = ranked.join(references.select("hash", "message_id"), "hash", "left").join(seen, "message_id", "left").join(known, "session_id", "left")
    return rows if project is None else rows.filter(F.col("project_slug") == project)


def search(index: DataFrame, phrase: list[str], references: DataFrame, messages: DataFrame, sessions: DataFrame, kind: list[str] | None = None, project: str | None = None, size: DataFrame | None = None) -> DataFrame:
    """All hits of a phrase with their context: in kind or content, or with ``kind`` (its terms) in the contents of that kind.

    ``page`` of it is what is shown, its count the total.
    """
    if kind:
        return with_context(bm25(index, [kind, phrase], columns=["kind", "content"], size=size), references, messages, sessions, project)
    return with_context(bm25(index, [phrase], size=size), references, messages, sessions, project)


def page_of_hits(found: DataFrame, blobs: DataFrame, words: list[str], limit: int = 10, offset: int = 0) -> DataFrame:
    """A page of hits, best first, with kind and snippet; texts are read for the page only."""
    chosen = found.orderBy("rank", "hash", "message_id").offset(offset).limit(limit)
    shown = blobs.join(F.broadcast(chosen.select("hash").distinct()), "hash", "left_semi")  # one page
    marks = F.array(*map(F.lit, words)).cast("array<string>")
    return chosen.join(shown.select("hash", "kind", snippet(F.col("content"), marks).alias("snippet")), "hash", "left")


def snippet(text: Column, matches: Column, words: int = 64, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Up to ``words`` words around the first match, matches marked, '...' where text is left out.

    ``matches`` is an array of folded words; a word of the text matches if it equals one of them.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+[^\p{L}\p{N}]*)"), F.lit(1))
    word = lambda p: F.regexp_extract(p, r"^([\p{L}\p{N}]+)", 1)
    hit = lambda p: F.array_contains(matches, folded(word(p)))
    first = F.coalesce(F.array_min(F.filter(F.transform(pieces, lambda p, i: F.when(hit(p), i)), lambda i: i.isNotNull())), F.lit(0))
    start = F.greatest(F.lit(0), F.least(first - words // 2, F.size(pieces) - words))
    shown = F.slice(pieces, start + 1, F.lit(words))
    mark = lambda p: F.when(hit(p), F.concat(F.lit(before), word(p), F.lit(after), F.substr(p, F.length(word(p)) + 1))).otherwise(p)
    head = F.when(start > 0, "...").otherwise("")
    tail = F.when(start + words < F.size(pieces), "...").otherwise("")
    return F.concat(head, F.trim(F.array_join(F.transform(shown, mark), "")), tail)
