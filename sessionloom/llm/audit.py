"""Filter interaction audit: what each filter does to a corpus in every order of application.

A document's failures are one bit mask. Documents are counted by part and mask, so that all that
follows works on at most 32 cells a part, however large a part is. The cells are unpivoted against
the steps of every order; a running bit-or over the steps before tells which failures came earlier,
conditional sums turn cells into the metrics of a step, and a window total over all orders is the
Shapley count of a filter (times the number of orders).
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Few words, few different words, many capitals, symbols, and copies of another document.
FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = r"[#$%&*|]"
#: Rows without an id are dealt over so many keys where rows meet by id.
UNNUMBERED = 1024


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, content): the failures that a text shows by itself, and its SHA-256.

    Null texts are empty; so are null sources. One pass over the texts, nothing of them goes further.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", "text", F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length("text") - F.length(F.translate("text", UPPER, ""))
    failed = {
        "A": n < 200,
        "B": 100 * distinct < 50 * n,
        "C": 100 * capitals > 2 * F.length("text"),
        "D": F.col("text").rlike(SYMBOLS),
    }
    mask = sum((F.when(condition, bit(letter)).otherwise(0) for letter, condition in failed.items()), F.lit(0))
    return rows.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("content"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of (doc_id, source, text) by part and all five failures.

    ``good`` and ``toxic`` count those that ``labels`` (doc_id, quality, toxic) marks with 1; of
    repeated labels one mark is enough, a null label marks nothing. A document fails E if a row with
    a smaller doc_id has the same text anywhere in the table. A null doc_id is neither smaller nor
    larger than another, so it never fails E and lets none fail; it has no labels. Rows that repeat
    an id each count, and are no copies of each other.

    Copies are never brought together: a text's rows are reduced to one row for each part and label
    before they are shuffled by text, and the first of them is found by joining on text and id.
    """
    # both sides of the join below are made of these rows: the texts are read once
    rows = written(text_failures(docs).groupBy("doc_id", "content", "part", "mask").agg(F.count("*").alias("n")), "failures")
    deal = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("content"), F.lit(UNNUMBERED))).otherwise(0)
    marked = labels.filter((F.col("quality") == 1) | (F.col("toxic") == 1)).groupBy(F.col("doc_id").alias("labelled"))
    marked = marked.agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"),
        F.lit(0).cast("long").alias("to"),
    )
    rows = rows.withColumn("deal", deal.cast("long"))
    rows = rows.join(marked, (rows["doc_id"] == marked["labelled"]) & (rows["deal"] == marked["to"]), "left")
    kind = ["content", "part", "mask", "is_good", "is_toxic"]
    groups = rows.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnumbered"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    groups = groups.select(*kind, "n", "unnumbered", F.col("first.doc_id").alias("first_id"), F.col("first.n").alias("first_n"))
    least = groups.groupBy(F.col("content").alias("same")).agg(F.min("first_id").alias("least"))
    groups = groups.join(least, (groups["content"] == least["same"]) & (groups["first_id"] == least["least"]), "left")
    passed = F.col("unnumbered") + F.when(F.col("least").isNotNull(), F.col("first_n")).otherwise(0)
    counts = F.array(
        F.struct(F.col("mask").alias("mask"), passed.alias("n")),
        F.struct((F.col("mask") + bit("E")).alias("mask"), (F.col("n") - passed).alias("n")),
    )
    groups = groups.select("part", "is_good", "is_toxic", F.inline(counts)).filter("n > 0")
    return groups.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("is_good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("is_toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Metrics of every step of all orders of ``filters`` for cells (part, mask, n, good, toxic).

    Bit i of ``mask`` is the failure of the i-th letter. Every part gets all steps of all orders,
    zeros included; a table without cells gets none. ``shapley`` sums the documents that a filter
    removes over all orders.
    """
    orders = ["".join(p) for p in permutations(filters)]
    steps = counted.select("*", F.explode(F.lit(orders)).alias("filter_order"))
    steps = steps.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter")).filter(F.col("letter") != "")
    own = F.lit(1)
    for i, letter in enumerate(filters):
        own = F.when(F.col("letter") == letter, F.lit(1 << i)).otherwise(own)
    steps = steps.withColumn("bit", own.cast("int")).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.bit_or("fails").over(before), F.lit(0)) != 0
    steps = steps.withColumn("earlier", earlier)
    fails, gone = F.col("fails") != 0, F.col("earlier")
    count = lambda condition, of="n": F.sum(F.when(condition, F.col(of)).otherwise(0)).cast("long")
    metrics = steps.groupBy("part", "filter_order", "at", "letter").agg(
        count(~fails & ~gone).alias("kept"),
        count(fails & ~gone).alias("removed"),
        count(fails & gone).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(fails & ~gone, "good").alias("good_lost"),
        count(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    total = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return metrics.select(
        "part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        total.cast("long").alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return audit(cells(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
f AS (
  SELECT part, text, words, t.doc_id,
         len(words) < 200 AS a,
         100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND l.quality = 1) AS good,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND l.toxic = 1) AS toxic
  FROM t
),
m AS (
  SELECT part, good, toxic, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
         CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed
  FROM f
),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order
  FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
p AS (
  SELECT part, good, toxic, filter_order, step, filter_order[step] AS letter, contains(failed, filter_order[step]) AS fails,
         len(list_filter(string_split(filter_order[1:step - 1], ''), lambda q: q <> '' AND contains(failed, q))) > 0 AS earlier,
         failed = filter_order[step] AS only_it
  FROM m CROSS JOIN s
),
g AS (
  SELECT part, filter_order, step, letter,
         count(*) FILTER (WHERE NOT fails AND NOT earlier) AS kept,
         count(*) FILTER (WHERE fails AND NOT earlier) AS removed,
         count(*) FILTER (WHERE fails AND earlier) AS redundant,
         count(*) FILTER (WHERE only_it) AS unique_fails,
         count(*) FILTER (WHERE fails AND NOT earlier AND good) AS good_lost,
         count(*) FILTER (WHERE fails AND NOT earlier AND toxic) AS toxic_lost
  FROM p GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM g
"""
