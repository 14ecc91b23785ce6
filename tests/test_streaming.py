"""Stateful matching over micro-batches, and the next result of a busy key."""

import json
import time

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import store
from sessionloom.streaming import consume

LOG = "file STRING, tool_use_id STRING, ord BIGINT, ts TIMESTAMP, is_use BOOLEAN, tool_name STRING, path STRING, content_hash STRING"


def event(ord, day, use, ident="t", path=None, file="a"):
    return {"file": file, "tool_use_id": ident, "ord": ord, "ts": f"2026-01-{day:02}T00:00:00Z", "is_use": use, "tool_name": "Read" if use else None, "path": path or f"p{ord}", "content_hash": f"h{ord}"}


@pytest.fixture
def state_store(spark):
    consume.use_state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_first_later_result_consumes_a_use(spark, state_store, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    batches = [
        # a use that is replaced, one that waits, a result before its use, a use and result in one batch in the wrong order
        [event(1, 1, True), event(2, 1, True), event(3, 1, True, "wait"), event(4, 1, False, "early"), event(5, 1, True, "early"), event(8, 1, False, "one"), event(7, 1, True, "one"), event(1, 1, True, "t", "other", "b")],
        # the first result takes the use, the second finds nothing; another file's use of the same id stays
        [event(10, 2, False), event(11, 2, False), event(12, 2, True), event(13, 2, False), event(14, 2, False, "early"), event(15, 2, False, "unknown")],
        # far later: the watermark passes what waits
        [event(20, 20, True, "new")],
        [event(21, 21, False, "wait"), event(22, 21, False, "new"), event(23, 21, False, "t", None, "b")],
    ]

    def run():
        log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(str(source))
        query = consume.consumed_stream(log, "2 days").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", out).trigger(availableNow=True).start()
        query.awaitTermination(100)
        return sorted((r["file"], r["tool_use_id"], r["use_ord"], r["result_ord"], r["path"]) for r in spark.read.schema(consume.FOUND).parquet(out).collect())

    want = []
    for i, (rows, found) in enumerate(zip(batches, ([("a", "one", 7, 8, "p7")], [("a", "t", 2, 10, "p2"), ("a", "t", 12, 13, "p12"), ("a", "early", 5, 14, "p5")], [], [("a", "new", 20, 22, "p20")]))):
        (source / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        want += found
        assert run() == sorted(want), i
    log = spark.createDataFrame([(r["file"], r["tool_use_id"], r["ord"], r["ord"], r["is_use"]) for rows in batches for r in rows], "file string, tool_use_id string, id long, ord long, is_use boolean")
    batch = {tuple(r) for r in store.consumed_uses(log, ["file", "tool_use_id"], ["ord"], F.col("is_use")).collect()}
    assert batch == {r[:4] for r in want} | {("a", "wait", 3, 21), ("b", "t", 1, 23)}  # without a watermark nothing is dropped


def test_next_result_of_one_busy_key(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.lit(1).alias("key"), "id", F.col("id").alias("sec"), F.pmod(F.xxhash64("id"), F.lit(3)).alias("kind"))
    begin = time.time()
    found = store.match_first_result(rows.filter("kind = 0").drop("kind"), rows.filter("kind = 1").drop("kind"), ["key"])
    wrong = found.filter("result_id <= id OR result_sec <= id").count()
    total, last = found.count(), rows.filter("kind = 1").agg(F.max("id")).first()[0]
    assert wrong == 0 and total == rows.filter((F.col("kind") == 0) & (F.col("id") < last)).count()
    assert time.time() - begin < 60


def test_next_result_over_empty_buckets(spark):
    uses = [("k", 1, 10), ("k", 2, 10), ("k", 3, 5000), ("k", 4, 90_000), ("m", 5, 1), ("n", 6, 50)]
    results = [("k", 11, 10), ("k", 12, 9000), ("k", 13, 9000), ("k", 14, 89_999), ("n", 15, 50), ("n", 16, 51)]
    shape = "key string, id long, sec long"
    got = {tuple(r) for r in store.match_first_result(spark.createDataFrame(uses, shape), spark.createDataFrame(results, shape), ["key"]).collect()}
    assert got == {("k", 1, 12, 9000), ("k", 2, 12, 9000), ("k", 3, 12, 9000), ("n", 6, 16, 51)}
