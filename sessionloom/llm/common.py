"""What the training-data operators share: table access, fold rule, batches, shared folder."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a task works on at once; a single row of more bytes is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(batches, rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and ``most`` bytes, but one row at least."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).get_total_buffer_size() > most and batch.slice(at, n).nbytes > most:
                n = (n + 1) // 2
            yield batch.slice(at, n)
            at += n


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with batches bounded by rows and bytes, whatever the session's own batch size is."""
    return df.mapInArrow(lambda batches: fn(bounded(batches)), schema)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out of all learning.

    A null id is put in fold 0: it is never learned from.
    """
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)), F.lit(0)).cast("int")


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(doc_id) == 0


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, ``spark.checkpoint.dir``.

    Where it is unset and all runs in this process, a folder of our own; a cluster without it is an error.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, removed when this driver process ends."""
    path = f"{shared_folder(spark)}/sessionloom/{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have been stopped already; the folder is the cluster's scratch space
        pass


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df._written_at)


def release(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of finished steps now, not when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def blocks(df: DataFrame, order: str, rows: int) -> list[DataFrame]:
    """Split a query set into blocks of at most ``rows`` rows by a hash of the unique ``order``.

    The rows are written once, a folder for each block, so that reading a block reads no other.
    The number of blocks is doubled until the largest of them is proven to fit; only the
    block sizes reach the driver.
    """
    n = df.count()
    if n <= rows:
        return [df] if n else []
    parts = -(-n // rows)
    while True:
        parts *= 2
        numbered = df.withColumn("_block", F.pmod(F.xxhash64(order), F.lit(parts)).cast("int"))
        if numbered.groupBy("_block").count().agg(F.max("count")).first()[0] <= rows:
            break
    path = new_path(df.sparkSession, "blocks")
    numbered.write.partitionBy("_block").parquet(path)
    stored = df.sparkSession.read.schema(numbered.schema).parquet(path)
    return [stored.filter(F.col("_block") == b).drop("_block") for b in range(parts)]
