"""A warehouse of earlier runs is brought up to date, in steps that can be stopped and repeated."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import migration, warehouse
from tests.test_runs import line


@pytest.fixture
def old(spark, tmp_path):
    """A warehouse without backups, in which two fingerprints are old and two missing."""
    top = tmp_path / "in"
    for folder in ("projects/p", "tmp/x.codex/sessions", "../.gemini/tmp/h/chats"):
        os.makedirs(top / folder)
    for i in range(6):
        (top / f"projects/p/s{i}.jsonl").write_text("".join(line(n, f"s{i}") for n in range(i + 1)))
    for i in range(3):
        rows = [{"timestamp": "1", "type": "session_meta", "payload": {"id": f"c{i}", "timestamp": "1", "cwd": "/w"}}, {"timestamp": "2", "type": "request_item", "payload": {"content": "ask"}}]
        (top / f"tmp/x.codex/sessions/rollout-{i}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / ".gemini/tmp/h/chats/session-g.json").write_text(json.dumps({"sessionId": "g", "projectHash": "0123456789", "messages": [{"id": "m", "timestamp": "t", "type": "user", "content": "hello"}]}))
    path = str(tmp_path / "house")
    warehouse.run(spark, str(top), path)
    warehouse.run(spark, str(tmp_path / ".gemini"), path, source=("home", "Gemini"))
    house = warehouse.Warehouse(spark, path)
    prints = house.table("fingerprints")
    want = {r["session_id"]: r["fingerprint"] for r in prints.collect()}
    aged = prints.filter("session_id NOT IN ('s0', 'c0')").withColumn("fingerprint", F.when(F.col("session_id").isin("s1", "s2"), "old").otherwise(F.col("fingerprint")))
    kept = aged.collect()
    warehouse.remove(spark, f"{path}/fingerprints")
    house.commit({"fingerprints": spark.createDataFrame(kept, prints.schema)})
    return house, want, top, str(tmp_path / "backups")


def prints(house):
    return {r["session_id"]: r["fingerprint"] for r in house.table("fingerprints").collect()}


def test_what_is_old_or_missing_is_made(spark, old):
    house, want, top, backups = old
    assert len(want) == 10 and tuple(migration.pending(house).first()) == (4, 4)
    os.remove(top / "tmp/x.codex/sessions/rollout-2.jsonl")
    seen = []
    out = migration.migrate(house, backups, "2026-01-01 00:00:00", chunk=1, publish=seen.append)
    assert (out["status"], out["total_sessions"], out["fingerprints_updated"], out["backed_up"], out["steps"]) == ("completed", 8, 4, 3, 4)
    assert [p["step"] for p in seen] == [1, 2, 3, 4] and prints(house) == want
    saved = house.table("session_backups").collect()
    assert sorted(r["original_path"].rsplit("/", 1)[1] for r in saved) == ["rollout-0.jsonl", "rollout-1.jsonl", "session-g.json"]
    stored = spark.read.parquet(backups)
    assert warehouse.verify(stored.select("content_hash", "content")).count() == 0 and stored.count() == 3
    # the file that is gone stays pending, and nothing else is done again
    assert tuple(migration.pending(house).first()) == (0, 1)
    again = migration.migrate(house, backups, "2026-01-02 00:00:00")
    assert (again["fingerprints_updated"], again["backed_up"]) == (0, 0) and house.table("session_backups").count() == 3
    assert not os.listdir(f"{house.path}/_staged")


def test_a_stopped_migration_goes_on(spark, old):
    house, want, _, backups = old
    asked = iter([False, True])
    first = migration.migrate(house, backups, "2026-01-01 00:00:00", chunk=2, stop=lambda: next(asked))
    assert (first["status"], first["step"], first["steps"]) == ("cancelled", 1, 2)
    left = migration.pending(house).first()
    assert left["fingerprints"] == 4 - first["fingerprints_updated"] and left["backups"] == 4 - first["backed_up"]
    second = migration.migrate(house, backups, "2026-01-01 00:00:00")
    assert first["fingerprints_updated"] + second["fingerprints_updated"] == 4 and first["backed_up"] + second["backed_up"] == 4
    assert prints(house) == want and tuple(migration.pending(house).first()) == (0, 0)
    nothing = migration.migrate(house, backups, "2026-01-01 00:00:00")
    assert nothing["total_sessions"] == 0 and nothing["status"] == "completed"


def test_empty_warehouse(spark, tmp_path):
    house = warehouse.Warehouse(spark, str(tmp_path / "none"))
    assert tuple(migration.pending(house).first()) == (0, 0)
    assert migration.migrate(house, str(tmp_path / "b"), "2026-01-01 00:00:00")["total_sessions"] == 0
