"""Incremental runs that read what is new and lose nothing, and logs that flow into the tables."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import fulltext, warehouse
from sessionloom.sources import ingest, ranges
from sessionloom.streaming import live, tail

TABLES = {
    "messages": ["id", "session_id", "type", "content", "fingerprint", "size"],
    "content_blocks": ["message_id", "block_index", "block_type", "content_hash", "tool_use_id"],
    "tool_calls": ["id", "message_id", "input_hash", "output_hash"],
    "content_store": ["hash", "content", "size", "kind"],
    "blob_references": ["hash", "message_id", "context"],
    "file_references": ["file_path", "content_hash", "session_id", "message_id", "operation"],
    "fingerprints": ["session_id", "fingerprint"],
}


def line(i, session="s", **message):
    return json.dumps({"type": "user", "uuid": f"{session}-{i}", "sessionId": session, "timestamp": f"2026-01-01T00:{i // 60:02}:{i % 60:02}Z", "cwd": "/w/p", "message": {"role": "user", "content": f"text {i}"} | message}) + "\n"


def use(i, ident):
    return line(i, content=[{"type": "tool_use", "id": ident, "name": "Read", "input": {"file_path": f"/f/{ident}"}}]).replace('"type": "user"', '"type": "assistant"', 1)


def result(i, ident):
    return line(i, content=[{"type": "tool_result", "tool_use_id": ident, "content": f"result {i}"}])


def state(spark, path):
    house = warehouse.Warehouse(spark, path)
    return {name: sorted(map(str, house.table(name).select(*columns).collect())) for name, columns in TABLES.items()}


@pytest.fixture
def root(tmp_path):
    os.makedirs(tmp_path / "in/projects/p")
    return tmp_path / "in"


@pytest.mark.parametrize("chunk", [1, 7, 64, 10_000])
def test_lines_of_chunks(spark, tmp_path, chunk):
    rng, want, rows = random.Random(chunk), [], []
    for n in range(6):
        parts = [rng.choice(["", "  ", "{}", '{"a": "é"}', "x" * rng.randint(1, 200), "1\r"]) for _ in range(rng.randint(0, 12))]
        text = "".join(p + "\n" for p in parts) + ["", '{"whole": 1}', '{"cut', "", "\n", "5"][n]
        (tmp_path / f"{n}.jsonl").write_bytes(text.encode())
        at = 0
        for piece in text.encode().splitlines(keepends=True) if "\r" not in text else [x + b"\n" for x in text.encode().split(b"\n")[:-1]] + ([text.encode().split(b"\n")[-1]] if text and not text.endswith("\n") else []):
            if piece.strip() and (piece.endswith(b"\n") or piece != b'{"cut'):
                want.append((f"{n}.jsonl", at, at + len(piece), piece.decode().strip()))
            at += len(piece)
        rows.append((f"file:{tmp_path}/{n}.jsonl", len(text.encode())))
    files = spark.createDataFrame(rows, "path string, size long")
    got = ranges.lines(files, chunk=chunk).select(F.regexp_extract("file", "([^/]*)$", 1), "ord.block", "next", "value").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_grown_log_is_read_from_where_it_was_left(spark, root, tmp_path, monkeypatch):
    path, log = str(tmp_path / "house"), root / "projects/p/s.jsonl"
    log.write_text("".join(line(i) for i in range(200)) + use(200, "a") + use(201, "b") + result(202, "b") + json.dumps({"type": "progress"}).replace(" ", "") + "\nnot json\n")
    read, keep = {}, warehouse._Run.keep

    def kept(self, name, df, **counted):
        out = keep(self, name, df, **counted)
        if name == "lines_session_log":
            read[self.run_id] = out.count()
        return out

    monkeypatch.setattr(warehouse._Run, "keep", kept)
    first = warehouse.run(spark, str(root), path)
    assert (first["messages_added"], first["tool_calls_added"], first["messages_skipped"], first["parse_errors"], first["files"], first["sessions_added"]) == (203, 2, 1, 1, 1, 1)
    assert first["blobs_added"] == warehouse.Warehouse(spark, path).table("content_store").count()
    with log.open("a") as f:
        f.write(result(203, "a") + result(204, "b") + line(205))
    second = warehouse.run(spark, str(root), path)
    assert read[second["run_id"]] == 3 and second["messages_added"] == 3
    warehouse.run(spark, str(root), str(tmp_path / "whole"), full=True)
    assert state(spark, path) == state(spark, str(tmp_path / "whole"))
    assert len(state(spark, path)["file_references"]) == 2
    # written anew, and longer than before: read from its start
    log.write_text("".join(line(i, text="other") for i in range(300, 600)))
    third = warehouse.run(spark, str(root), path)
    assert read[third["run_id"]] == 300 and third["messages_added"] == 300


def test_lines_written_during_a_run_are_read_by_the_next(spark, root, tmp_path, monkeypatch):
    path, log = str(tmp_path / "house"), root / "projects/p/s.jsonl"
    log.write_text(line(1) + line(2))
    whole = ingest.ingest

    def grows(*args, **how):
        with log.open("a") as f:
            f.write(line(3))
        return whole(*args, **how)

    monkeypatch.setattr(ingest, "ingest", grows)
    assert warehouse.run(spark, str(root), path)["messages_added"] == 2
    monkeypatch.setattr(ingest, "ingest", whole)
    assert warehouse.run(spark, str(root), path)["messages_added"] == 1
    assert sorted(r["id"] for r in warehouse.Warehouse(spark, path).table("messages").collect()) == ["s-1", "s-2", "s-3"]


def test_a_cancelled_run_leaves_the_tables(spark, root, tmp_path):
    path = str(tmp_path / "house")
    (root / "projects/p/s.jsonl").write_text(line(1) + use(2, "a"))
    asked = []

    def stop():
        asked.append(1)
        return len(asked) > 9  # by then some tables are written

    row = warehouse.run(spark, str(root), path, stop=stop)
    house = warehouse.Warehouse(spark, path)
    assert row["status"] == "cancelled" and row["messages_added"] == 0
    assert os.listdir(tmp_path / "house/content_blocks") and all((df := house.table(t)) is None or df.count() == 0 for t in TABLES)
    assert [r["status"] for r in house.table("index_runs").collect()] == ["cancelled"] and not os.listdir(tmp_path / "house/_staged")
    waits = iter([True, True, False])
    begin = time.time()
    assert warehouse.run(spark, str(root), path, pause=lambda: next(waits, False))["status"] == "completed" and time.time() - begin > 0.2
    assert house.table("messages").count() == 2


def test_backups_expire_in_a_run(spark, root, tmp_path):
    path, stored = str(tmp_path / "house"), str(tmp_path / "backups")
    (root / "projects/p/s.jsonl").write_text(line(1))
    warehouse.run(spark, str(root), path, now="2026-01-01 00:00:00", backups=stored)
    (root / "projects/p/t.jsonl").write_text(line(2, "t"))
    warehouse.run(spark, str(root), path, now="2026-02-01 00:00:00", backups=stored, keep_days=10)
    house = warehouse.Warehouse(spark, path)
    assert [r["session_id"] for r in house.table("session_backups").collect()] == ["t"]
    assert [bytes(r["content"]) for r in spark.read.parquet(stored).collect()] == [line(2, "t").encode()]


def test_a_stream_ends_in_the_tables_of_one_run(spark, root, tmp_path):
    logs = root / "projects/p"
    path, checkpoint, index = (str(tmp_path / x) for x in ("live", "state", "index"))
    published, tables = [], []
    listener = live.watched(spark, published.append)
    lines = tail.tail(spark, f"{logs}/*.jsonl")
    try:
        (logs / "s.jsonl").write_text(line(1) + use(2, "a") + line(3)[:20])
        live.keep_up(lines, path, checkpoint, then=[live.index_for_search(index)]).awaitTermination(100)
        with (logs / "s.jsonl").open("a") as f:
            f.write(line(3)[20:] + result(4, "a"))
        (logs / "t.jsonl").write_text(line(5, "t"))
        live.keep_up(lines, path, checkpoint, then=[live.index_for_search(index)]).awaitTermination(100)
        live.keep_up(lines, path, checkpoint).awaitTermination(100)
        tables = state(spark, path)
        # the first batch is delivered again, as it was and cut off
        again = spark.createDataFrame([(f"{logs}/s.jsonl", 0, line(1).strip())], "file string, line_offset long, value string")
        live.write_batch(again, 0, path, checkpoint)
        assert state(spark, path) == tables
        for _ in range(100):
            if sum(p["event"] == "ended" for p in published) >= 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    warehouse.run(spark, str(root), str(tmp_path / "whole"))
    assert tables == state(spark, str(tmp_path / "whole")) and len(tables["messages"]) == 5 and len(tables["file_references"]) == 1
    assert {r["hash"] for r in fulltext.find(fulltext.read(spark, index), "text").collect()} == {r["hash"] for r in warehouse.Warehouse(spark, path).table("search").filter("content LIKE 'text%'").collect()}
    assert [p["event"] for p in published if p["event"] != "progress"].count("started") >= 3 and sum(p.get("rows", 0) for p in published) >= 5


def test_a_trigger_keeps_up_with_a_growing_folder(spark, root, tmp_path):
    logs, path, stepped = root / "projects/p", str(tmp_path / "live"), []
    (logs / "s.jsonl").write_text(line(1))
    query = live.keep_up(tail.tail(spark, f"{logs}/*.jsonl"), path, str(tmp_path / "state"), "1 second", [lambda house: stepped.append(house.table("messages").count())])

    def wait(n):
        end = time.time() + 100
        while len(stepped) < n and time.time() < end and query.isActive:
            time.sleep(0.2)

    try:
        wait(1)
        (logs / "t.jsonl").write_text(line(2, "t") + line(3, "t"))
        wait(2)
    finally:
        query.stop()
    assert stepped[:2] == [1, 3] and query.exception() is None
