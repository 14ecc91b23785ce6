"""Ingestion of a small tree of artifacts, twice, and tailing of a growing file."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import store
from sessionloom.sources import config, ingest, scan, sessions
from sessionloom.streaming import tail

A, B = "aaaaaaaa-0000-0000-0000-000000000001", "aaaaaaaa-0000-0000-0000-000000000002"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def user(uuid, sid, content, ts="2026-02-01T10:00:00Z"):
    return {"type": "user", "uuid": uuid, "sessionId": sid, "timestamp": ts, "cwd": "/home/x/proj", "gitBranch": "main", "message": {"role": "user", "content": content}, "odd": 1}


def assistant(uuid, sid, content, ts="2026-02-01T10:00:01Z"):
    return {"type": "assistant", "uuid": uuid, "parentUuid": "u1", "sessionId": sid, "timestamp": ts, "message": {"role": "assistant", "model": "m-1", "stop_reason": "end_turn", "content": content}}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("artifacts")

    def put(path, data):
        at = top / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(data if isinstance(data, str) else json.dumps(data))

    log = [
        {"type": "summary", "summary": "What was done", "leafUuid": "leaf"},
        user("u1", A, "Please read the file, key sk-" + "a" * 48),
        assistant("a1", A, [{"type": "thinking", "thinking": "secret plan"}, {"type": "text", "text": "Reading"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "/x/main.py", "b": 1}}]),
        user("u2", A, [{"type": "tool_result", "tool_use_id": "t1", "content": "print(1)"}]),
        {"type": "progress", "toolUseID": "t1"},
        {"type": "queue-operation"},
        {"type": "file-history-snapshot", "x": 1},
        {"type": "system", "uuid": "s1", "sessionId": A, "timestamp": "2026-02-01T10:00:05Z", "durationMs": 12, "content": "note"},
    ]
    put(f"projects/p/{A}.jsonl", "\n".join([*map(json.dumps, log), "not json", '{"type":"strange"}', ""]) + "\n")
    put(f"projects/p/{B}.jsonl", json.dumps(user("v1", B, "Please read the file, key sk-" + "a" * 48)) + "\n")
    put("projects/p/sessions-index.json", {"originalPath": "/home/x/proj", "entries": [{"sessionId": A, "firstPrompt": "Please", "messageCount": 5, "created": "2026-02-01"}]})
    put(f"projects/p/{A}/tool-results/toolu_1.txt", "raw")
    put(f"tasks/{A}/1.json", {"id": "1", "subject": "s", "description": "d", "status": "open", "blocks": [], "blockedBy": ["2", "3"]})
    put("usage-data/facets/f1.json", {"outcome": "success", "goal_categories": {"fix": 2}})
    put("stats-cache.json", {"version": 1, "dailyActivity": [{"date": "2026-02-01", "messageCount": 3}], "modelUsage": {"m-1": {"input_tokens": 3697899746}}})
    put("history.jsonl", '{"display":"first prompt","timestamp":1}\n{"display":"  "}\nbad\n')
    put("plans/a.md", "# Plan\nstep")
    put("plans/blank.md", "  \n")
    put("debug/x.jsonl", "{}")
    put("settings.json", "{}")
    put("tmp/h/chats/session-1.json", {"sessionId": "g1", "projectHash": "0123456789", "startTime": "t0", "lastUpdated": "t1", "messages": [
        {"id": "g-m1", "timestamp": "t0", "type": "user", "content": "hello"},
        {"id": "g-m2", "timestamp": "t1", "type": "model", "content": [{"text": "par"}, {"text": "ts"}], "thoughts": [{"subject": "s", "description": "d", "timestamp": "t"}], "toolCalls": [{"id": "gt", "name": "ls", "args": {"b": 1, "a": 2}, "result": [1]}]},
    ]})
    roll = [
        {"timestamp": "0", "type": "request_item", "payload": {"content": "too early"}},
        {"timestamp": "1", "type": "session_meta", "payload": {"id": "c1", "timestamp": "1", "cwd": "/w/repo", "cli_version": "9"}},
        {"timestamp": "2", "type": "tool_call", "payload": {"id": "x0", "name": "sh", "input": {}}},
        {"timestamp": "3", "type": "request_item", "payload": {"content": "ask"}},
        {"timestamp": "4", "type": "response_item", "payload": {"content": [{"text": "ans"}, {"text": "wer"}]}},
        {"timestamp": "5", "type": "tool_call", "payload": {"id": "x1", "name": "sh", "input": {"c": "ls"}}},
        {"timestamp": "6", "type": "tool_response", "payload": {"toolUseId": "x1", "content": "out"}},
        {"timestamp": "7", "type": "plan_update", "payload": {"plan": "do it"}},
        {"timestamp": "7", "type": "plan_update", "payload": {"plan": {"b": ["é", {}, 1.5], "a": []}}},
        {"timestamp": "8", "type": "task_update", "payload": {"id": "k", "subject": "a", "description": "b", "status": "open", "blockedBy": ["j"]}},
        {"timestamp": "9", "type": "task_update", "payload": {"id": "k", "subject": "a", "description": "b", "status": "done"}},
    ]
    put("sessions/2026/rollout-1.jsonl", "\n".join(map(json.dumps, roll)) + "\n")
    return str(top)


@pytest.fixture(scope="module")
def tables(spark, root):
    return ingest.ingest(spark, root)


def test_manifest_classifies_and_skips(spark, root):
    kinds = {r["kind"]: r["n"] for r in scan.manifest(spark, root).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"session_log": 2, "session_index": 1, "tool_result": 1, "task": 1, "facet": 1, "stats_cache": 1, "history": 1, "plan": 2, "chat_session": 1, "rollout": 1}
    assert scan.manifest(spark, root, ["plans/*"]).filter("kind = 'plan'").count() == 0


def test_messages(tables):
    rows = {r["id"]: r for r in tables["messages"].collect()}
    assert set(rows) == {"summary-leaf", "u1", "a1", "u2", "s1", "v1", "g-m1", "g-m2", "c1-0", "c1-1"}
    assert rows["summary-leaf"]["session_id"] == A and rows["summary-leaf"]["timestamp"] == ""
    assert rows["a1"]["model"] == "m-1" and rows["s1"]["duration_ms"] == 12
    assert (rows["c1-0"]["type"], rows["c1-1"]["type"]) == ("user", "assistant")
    assert rows["s1"]["fingerprint"] == sha("system2026-02-01T10:00:05Z" + sha("note"))
    assert rows["summary-leaf"]["fingerprint"] == sha("summaryWhat was done")
    tool = sha("Read" + sha('{"b":1,"file_path":"/x/main.py"}'))
    assert rows["a1"]["fingerprint"] == sha("assistant2026-02-01T10:00:01Z" + sha("secret plan") + sha("Reading") + tool)


def test_store_redacts_and_deduplicates(tables):
    blobs = {r["hash"]: r for r in tables["content_store"].collect()}
    prompt = "Please read the file, key sk-" + "a" * 48
    assert blobs[sha(prompt)]["content"] == "Please read the file, key [REDACTED]"
    assert tables["blob_references"].filter(F.col("hash") == sha(prompt)).count() == 2
    kinds = {r["kind"] for r in blobs.values()}
    assert {"user_text", "text", "thinking", "tool_input", "tool_output", "system", "summary", "plan"} <= kinds
    assert blobs[sha('{"a":2,"b":1}')]["kind"] == "tool_input"
    plans = {r["content"] for r in blobs.values() if r["kind"] == "plan"}
    assert plans == {"do it", '{\n  "a": [],\n  "b": [\n    "é",\n    {},\n    1.5\n  ]\n}'}
    searchable = {r["kind"] for r in tables["search"].collect()}
    assert "thinking" not in searchable and "tool_input" not in searchable


def test_tools_and_files(tables):
    calls = {r["id"]: r for r in tables["tool_calls"].collect()}
    assert calls["t1"]["output_hash"] == sha('"print(1)"') and calls["gt"]["output_hash"] == sha("[1]")
    assert calls["x0"]["message_id"] == "c1-init" and calls["x0"]["output_hash"] is None
    assert calls["x1"]["message_id"] == "c1-1" and calls["x1"]["output_hash"] == sha('"out"')
    files = tables["file_references"].collect()
    assert [(f["file_path"], f["operation"], f["message_id"]) for f in files] == [("/x/main.py", "read", "u2")]
    blocks = {(b["message_id"], b["block_index"]) for b in tables["content_blocks"].collect()}
    assert {("a1", 0), ("a1", 1), ("a1", 2), ("g-m2", 0), ("g-m2", 1), ("g-m2", 1000), ("c1-1", 1000 + ord("x")), ("c1-0", 2000 + ord("x"))} <= blocks


def test_structured(spark, root, tables):
    found = {r["id"]: r for r in tables["sessions"].collect()}
    assert set(found) == {A, B, "g1", "c1"}
    assert found[A]["project_slug"] == "proj" and found[A]["message_count"] == 5 and found[B]["project_slug"] == "proj"
    assert tables["task_dependencies"].count() == 2 and tables["tasks"].first()["session_id"] == A
    assert tables["session_outcomes"].first()["session_id"] == "f1"
    assert tables["model_usage"].first()["input_tokens"] == 3697899746 and tables["daily_stats"].first()["session_count"] == 0
    assert sorted(r["kind"] for r in tables["notes"].collect()) == ["history_prompt", "plan"]
    assert {r["file"].rsplit("/")[-1]: r["parse_errors"] for r in tables["parse_errors"].collect()} == {f"{A}.jsonl": 2, f"{B}.jsonl": 0}
    paths = [r["path"] for r in tables["manifest"].filter("kind = 'rollout'").collect()]
    assert sessions.rollout_sessions(sessions.lines(spark, paths)).first()["app_version"] == "9"
    task = sessions.rollout_tasks(sessions.lines(spark, paths)).first()
    assert (task["id"], task["status"], task["blocked_by"]) == ("k", "done", [])


def test_sessions_of_all_formats(spark, root):
    found = {r["id"]: r for r in ingest.ingest(spark, root, source=("Home", "Mixed"))["sessions"].collect()}
    assert (found["c1"]["project_path"], found["c1"]["project_slug"], found["c1"]["app_version"]) == ("/w/repo", "repo", "9")
    assert (found["g1"]["project_path"], found["g1"]["project_slug"], found["g1"]["created_at"], found["g1"]["modified_at"]) == ("0123456789", "01234567", "t0", "t1")
    assert {(r["source_name"], r["source_kind"]) for r in found.values()} == {("Home", "mixed")}


def test_analytics_over_ingested_tables(spark, root):
    """What an ingest writes is what the analyses read."""
    from sessionloom.operators import analytics, browsing, burden

    t = ingest.ingest(spark, root, source=("home", "mixed"))
    sessions, messages, calls, blobs = (t[n].persist() for n in ("sessions", "messages", "tool_calls", "content_store"))
    row = analytics.overview(sessions, messages, blobs).first()
    assert (row["total_sessions"], row["total_messages"]) == (4, 10) and row["total_blob_bytes"] == sum(len(r["content"].encode()) for r in blobs.collect())
    assert [(r["source_kind"], r["session_count"], r["message_count"], r["tool_call_count"]) for r in analytics.by_source_kind(sessions, messages, calls).collect()] == [("mixed", 4, 10, 4)]
    assert {r["project_slug"]: r["message_count"] for r in analytics.by_project(sessions, messages, calls).collect()} == {"proj": 6, "01234567": 2, "repo": 2}
    assert {r["tool_name"]: r["n"] for r in analytics.tool_frequency(calls).collect()} == {"Read": 1, "sh": 2, "ls": 1}
    assert analytics.projects_page(sessions, messages, calls, t["file_references"]).filter("project_slug = 'proj'").first()["files_touched"] == 1
    assert analytics.storage_overview(blobs, t["blob_references"]).first()["blobs"] == blobs.count()
    assert [tuple(r) for r in analytics.model_sessions(messages).collect()] == [("m-1", 1, 1)]
    assert analytics.daily_projects(sessions).count() > 0 and analytics.file_provenance(t["file_references"]).first()["operations"] == "read"
    order = ("timestamp", "turn_index", "id")
    first = {r["session_id"]: r["first_text"] for r in browsing.first_user_text(messages, order=order).collect()}
    assert first[A] == "Please read the file, key [REDACTED]" and first["g1"] == "hello" and first["c1"] == "ask"
    none = spark.createDataFrame([], "session_id string, outcome string, reason_code string")
    page = {r["session_id"]: (r["message_count"], r["first_text"]) for r in browsing.session_list(messages, none, order=order).collect()}
    assert page["c1"] == (2, "ask") and len(page) == 4
    placed = burden.positions(messages, list(order))
    rows = burden.burden(placed, F.col("size"))
    assert {r["session_id"] for r in burden.by_group(rows, "session_id").collect()} == {A, B, "g1", "c1"} and rows.filter("id = 'u1'").first()["size"] == len("Please read the file, key sk-" + "a" * 48)
    cost = {r["tool_name"]: (r["calls"], r["bytes"], r["burden"]) for r in burden.by_output(calls, placed, blobs).collect()}
    assert cost["Read"] == (1, 10, 2 * 10)  # by time the call is the fourth of five messages


def test_ingesting_twice_changes_nothing(spark, root, tables):
    again = ingest.ingest(spark, root, tables["manifest"].unionByName(tables["manifest"]))
    for name in ("messages", "content_blocks", "tool_calls", "content_store", "file_references"):
        assert again[name].count() == tables[name].count(), name


def test_change_detection(spark):
    known = spark.createDataFrame([("a", 1, 10, 10), ("b", 1, 10, 7), ("d", 1, 1, 1)], "path string, mtime long, size long, offset long")
    now = spark.createDataFrame([("a", 1, 10), ("b", 2, 12), ("c", 1, 5)], "path string, mtime long, size long")
    assert {r["path"]: (r["status"], r["start"]) for r in store.changes(now, known).collect()} == {"a": ("unchanged", 0), "b": ("modified", 7), "c": ("new", 0)}
    assert [r["path"] for r in store.deleted(now, known).collect()] == ["d"]


def test_tail_reads_complete_lines_once(spark, tmp_path):
    log = tmp_path / "in" / "a.jsonl"
    os.makedirs(log.parent)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        tail.store_new(tail.tail(spark, f"{log.parent}/*.jsonl"), out, state).awaitTermination(120)
        return sorted(r["value"] for r in spark.read.schema("file string, line_offset long, value string").parquet(out).collect())

    log.write_text("one\n\ntwo\nthr")
    assert run() == ["one", "two"]
    with log.open("a") as f:
        f.write("ee\nfour\n")
    assert run() == ["four", "one", "three", "two"]
    assert run() == ["four", "one", "three", "two"]


def test_a_run_leaves_no_backlog(spark, tmp_path):
    log = tmp_path / "in" / "a.jsonl"
    os.makedirs(log.parent)
    want = [f"line {i}" for i in range(8)] + ["x" * 200_000, "end"]
    log.write_text("\n".join(want) + "\nopen")
    out = str(tmp_path / "out")
    tail.store_new(tail.tail(spark, f"{log.parent}/*.jsonl", bytes="40"), out, str(tmp_path / "state"))
    rows = spark.read.schema("file string, line_offset long, value string").parquet(out).orderBy("line_offset").collect()
    assert [r["value"] for r in rows] == want


def test_discovery_and_several_roots(spark, tmp_path):
    home = tmp_path / "home"
    agents = home / "Library/Application Support/Claude/local-agent-mode-sessions"
    for folder in ("a/.claude/projects/p/.claude", "1/2/3/4/5/6/.claude/projects/q", "1/2/3/4/5/6/7/.claude"):
        os.makedirs(agents / folder)
    os.makedirs(home / ".gemini/tmp/0123/chats")
    (agents / "a/.claude/projects/p/s.jsonl").write_text("{}")
    (home / ".gemini/tmp/0123/chats/session-1.json").write_text("{}")
    found = config.discovered(str(home))
    assert [(s.name, s.path[len(str(agents)) + 1:] if s.name != "gemini" else "", s.kind) for s in found] == [("claude-desktop-agent", "1/2/3/4/5/6/.claude", "claude"), ("claude-desktop-agent", "a/.claude", "claude"), ("gemini", "", "gemini")]
    assert config.discovered(str(tmp_path / "none")) == []
    rows = scan.manifests(spark, [found[1], found[2], config.Source("again", found[1].path, "X")]).collect()
    assert sorted((r["name"], r["kind"], r["source_name"], r["source_kind"]) for r in rows) == [("s.jsonl", "session_log", "claude-desktop-agent", "claude"), ("session-1.json", "chat_session", "gemini", "gemini")]


def test_raw_preview(spark):
    lines = [
        '{"type":"user","message":{"role":"user","content":"%s"}}' % ("x" * 120),
        '{"message":{"content":[{"type":"text","text":"hi"}]},"role":"r"}',
        '{"type":"assistant","message":{"content":[{"type":"tool_use"}]}}',
        '{"type":"system","message":{"content":[]}}',
        "not json " + "y" * 60,
    ]
    rows = scan.raw_preview(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, ord int, value string")).orderBy("ord").collect()
    assert [(r["type"], r["role"], r["preview"]) for r in rows] == [("user", "user", "x" * 100), ("unknown", "r", "hi"), ("assistant", "", "[tool_use]"), ("system", "", ""), ("error", "", ("not json " + "y" * 60)[:50])]
