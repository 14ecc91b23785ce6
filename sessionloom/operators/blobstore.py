"""The content store as a table laid out for look-ups: bucketed and sorted by hash, with Bloom filters.

A look-up reads the one bucket that its hash falls into, and of it the row groups whose filter may hold the hash. Joins with
the store on the hash shuffle the other side only, into the store's buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import place_of


def store(blobs: DataFrame, name: str, path: str | None = None, buckets: int = 64) -> DataFrame:
    """Write blobs (hash, ...), each hash once, as the table ``name``, below ``path`` if given. ``buckets`` should grow with the store: some 256 MB each."""
    writer = blobs.repartition(buckets, "hash").write.mode("overwrite").format("parquet").bucketBy(buckets, "hash").sortBy("hash")
    writer = writer.option("parquet.bloom.filter.enabled#hash", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return blobs.sparkSession.table(name)


def stored(spark: SparkSession, source: str, blobs, buckets: int = 8) -> DataFrame:
    """The table of what ``blobs()`` gives for ``source``, written by the first query of an application that asks for it."""
    path = place_of(spark, "blobs", source)
    name = "blobs_" + path.rsplit("-", 1)[1]
    return spark.table(name) if spark.catalog.tableExists(name) else store(blobs(), name, path, buckets)


def lookup(blobs: DataFrame, digest: str) -> DataFrame:
    """The blob of one hash, of one bucket's rows."""
    return blobs.filter(F.col("hash") == F.lit(digest))


def with_texts(rows: DataFrame, blobs: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows with a blob's text for each of ``keys`` (hash column: name of the text), null where there is none.

    The store is read once, whatever the number of keys: the different hashes of all of them, without the rows' other columns, are
    shuffled into the store's buckets, and only the texts that are found go on to the rows.
    """
    every = reduce(DataFrame.unionByName, [rows.select(F.col(k).alias("hash")) for k in keys])
    texts = every.filter("hash IS NOT NULL").distinct().join(blobs.select("hash", "content"), "hash")
    for key, name in keys.items():
        rows = rows.join(texts.select(F.col("hash").alias(key), F.col("content").alias(name)), key, "left")
    return rows
