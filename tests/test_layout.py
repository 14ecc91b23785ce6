"""The laid-out content store, quantile sketches, and calls of a backend."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import backends, blobstore, burden, enrich


def rows_read(df):
    """Rows that the scans of a query that has run gave."""

    def walk(node):
        n = node.metrics().apply("numOutputRows").value() if "Scan parquet" in node.nodeName() else 0
        if "AdaptiveSparkPlan" in node.nodeName():
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        children = node.children()
        return n + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_lookup_reads_one_bucket_and_joins_leave_the_store_in_place(spark, tmp_path):
    blobs = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.concat(F.lit("text "), "id").alias("content"), F.lit("text").alias("kind"))
    table = blobstore.store(blobs, "laid_out", str(tmp_path / "laid_out"), 8)
    one = blobs.filter("content = 'text 77'").first()["hash"]
    found = blobstore.lookup(table, one)
    assert [r["content"] for r in found.collect()] == ["text 77"]
    assert "EqualTo(hash," in plan_of(found) and 1 <= rows_read(found) < 5000 / 8 * 2  # of one bucket
    parts = [pq.ParquetFile(f) for f in (tmp_path / "laid_out").glob("*.parquet")]
    assert len(parts) == 8 and sum(p.metadata.num_rows for p in parts) == 5000
    first = parts[0].read(["hash"]).column(0).to_pylist()
    assert first == sorted(first)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(300).select("id", F.sha2((F.col("id") * 20).cast("string"), 256).alias("a"), F.when(F.col("id") % 3 == 0, F.sha2(F.lit("1"), 256)).when(F.col("id") % 3 == 1, "nowhere").alias("b"))
        both = blobstore.with_texts(rows, table, {"a": "first", "b": "second"})
        got = {r["id"]: (r["first"], r["second"]) for r in both.collect()}
        texts = both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: (f"text {i * 20}" if i * 20 < 5000 else None, "text 1" if i % 3 == 0 else None) for i in range(300)}
    scan = [x for x in texts.split("\n") if "laid_out" in x]
    above = texts.split("\n")[texts.split("\n").index(scan[0]) - 4 : texts.split("\n").index(scan[0])]
    assert scan and not any("Exchange" in x for x in above), "\n".join(above)


def test_sketches_merge_to_near_quantiles(spark):
    rows = spark.range(60_000).select(F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("session_id"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100_000)).alias("burden"), (F.col("id") % 9).alias("day"))
    per = sorted(r["b"] for r in rows.groupBy("session_id", "day").agg(F.sum("burden").alias("b")).collect())
    q = burden.merged_quantiles(burden.burden_sketches(rows, "day")).first()
    assert q["n"] == len(per)
    for at in (0.5, 0.95, 0.99):
        below = sum(x < q[f"p{round(at * 100)}"] for x in per) / len(per)
        assert abs(below - at) <= burden.RANK_ERROR


def stub():
    """A local stand-in for a model server: slow, with texts that fail once or always, and a count of calls under way.

    It is made in a function, so that it goes to workers by value.
    """

    class Stub:
        def __init__(self):
            self.tried, self.now, self.lock = {}, 0, None

        def __call__(self, text):
            import json
            import threading
            import time

            self.lock = self.lock or threading.Lock()
            with self.lock:
                self.tried[text] = tries = self.tried.get(text, 0) + 1
                self.now = most = self.now + 1
            try:
                time.sleep(0.3 if "slow" in text else 0.02)
                if "never" in text or ("once" in text and tries == 1):
                    raise RuntimeError("no reply")
                return f"{most} of {text}" if "json" not in text else "Sure: " + json.dumps({"title": text, "tags": [{"tag": "x", "confidence": 0.9}], "outcome": "success"})
            finally:
                with self.lock:
                    self.now -= 1

    return Stub()


def test_calls_are_bounded_isolated_and_unordered(spark):
    texts = ["slow first", *[f"t{i}" for i in range(40)], "once", "never", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "session_id int, digest string").coalesce(1)
    got = backends.call_all(rows, stub(), "stub", concurrency=4, attempts=2, pause=0.01).collect()
    by = {r["session_id"]: r for r in got}
    assert len(got) == len(texts) and max(int(r["reply"].split()[0]) for r in got if r["reply"]) <= 4
    assert max(int(r["reply"].split()[0]) for r in got if r["reply"]) > 1
    assert got[0]["session_id"] != "0" and by["0"]["reply"].endswith("slow first")  # others did not wait for it
    assert (by["41"]["error"], by["41"]["attempts"]) == (None, 2)
    assert (by["42"]["reply"], by["42"]["error"], by["42"]["attempts"]) == (None, "RuntimeError: no reply", 2)
    assert (by["43"]["error"], by["43"]["attempts"], by["43"]["model"]) == ("no digest", 0, "stub")
    assert backends.call_all(rows.limit(0), stub(), "stub").count() == 0


def test_replies_become_enrichments(spark):
    rows = spark.createDataFrame([(1, "json a"), (2, "plain"), (3, "never")], "session_id int, digest string")
    done = enrich.enriched_replies(backends.call_all(rows, stub(), "stub", attempts=1)).collect()
    assert [(r["session_id"], r["title"], r["approval_status"]) for r in done] == [("1", "json a", "approved")]


def test_backend_precedence():
    known = {"local": len, "server": None, "command": str}
    assert backends.chosen(known, ["server", "local", "command"])[0] == "local"
    assert backends.chosen(known, ["server", "local", "command"], "command")[0] == "command"
    assert backends.chosen(known, ["command"], "server")[0] == "command"
    with pytest.raises(LookupError):
        backends.chosen(known, ["server"])
