"""Text functions, search against a full-text engine, enrichment rules, and incremental runs."""

import json
import os
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import text as T
from sessionloom.operators import analytics, browsing, enrich, search, store, warehouse
from sessionloom.sources import config

WORDS = (
    "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky "
    "relational conditional rational valenci digitizer conformabli radicalli differentli analogousli vietnamization predication operator feudalism decisiveness hopefulness "
    "formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable "
    "defensible irritant replacement adjustment dependent adoption communism activate angulariti homologous effective bowdlerize probate rate cease controll roll running "
    "runs yes by saying enjoyment toy syzygy university generalizations oscillators ion decision Café naïve über"
).split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_stems_as_the_full_text_engine(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(WORDS))
    want = {WORDS[doc]: term for term, doc in con.execute("SELECT term, doc FROM v")}
    df = spark.createDataFrame([(w,) for w in WORDS], "w string").withColumn("f", T.folded(F.col("w")))
    assert {r["w"]: r["stem"] for r in T.stemmed(df, "f").collect()} == want


@pytest.mark.parametrize("query, kind", [("running", None), ("cafe", None), ("run the", None), ("text", None), ("jump over", "note")])
def test_bm25_as_the_full_text_engine(spark, query, kind):
    rng = random.Random(2)
    pool = ["run", "running", "the", "fox", "Café", "jumps", "over", "lazy", "text"]
    docs = [(str(i), rng.choice(["text", "user_text", "note"]), " ".join(rng.choice(pool) for _ in range(rng.randint(3, 30)))) for i in range(80)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(hash UNINDEXED, kind, content, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", docs)
    match = f'"{query}"' + (f" AND kind:{kind}" if kind else "")
    want = dict(con.execute("SELECT hash, bm25(t) FROM t WHERE t MATCH ?", (match,)))
    index = search.postings(spark.createDataFrame(docs, "hash string, kind string, content string")).persist()
    stems = [r["stem"] for r in T.stemmed(spark.createDataFrame(list(enumerate(query.split())), "i int, w string"), "w").orderBy("i").collect()]
    phrases, columns = ([stems, [kind]], [None, "kind"]) if kind else ([stems], None)
    got = {r["hash"]: r["rank"] for r in search.bm25(index, phrases, columns=columns).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[h] - want[h]) < 1e-9 for h in want)


def test_boolean_and_snippet(spark):
    docs = [("1", "text", "alpha beta gamma"), ("2", "text", "alpha gamma"), ("3", "note", "beta beta"), ("4", "text", "x " * 100 + "Café, end")]
    index = search.postings(spark.createDataFrame(docs, "hash string, kind string, content string"))
    hashes = lambda **k: sorted(r["hash"] for r in search.boolean(index, **k).collect())
    assert hashes(must=[["alpha"]], must_not=[["beta"]]) == ["2"]
    assert hashes(should=[["beta"], ["gamma"]]) == ["1", "2", "3"]
    assert hashes(must=[["alpha", "beta"]]) == ["1"]
    assert one(spark, search.snippet(F.lit(docs[3][2]), F.array(F.lit("cafe")), 4)) == "...x x <mark>Café</mark>, end"


def test_search_with_context(spark, tmp_path):
    blobs = spark.createDataFrame([("1", "text", 'say "alpha" beta'), ("2", "note", "alpha: beta"), ("3", "text", "beta alpha"), ("4", "text", "alpha beta")], "hash string, kind string, content string")
    references = spark.createDataFrame([("1", "m1"), ("1", "m2"), ("2", "m2"), ("4", "gone")], "hash string, message_id string")
    messages = spark.createDataFrame([("m1", "user", "s1"), ("m2", "assistant", "s2")], "id string, type string, session_id string")
    sessions = spark.createDataFrame([("s1", "p", "first"), ("s2", "q", None)], "id string, project_slug string, summary string")
    index = search.postings(blobs).persist()
    phrase = search.query_terms(spark, '"alpha" OR: beta')
    assert phrase == ["alpha", "or", "beta"] and search.query_terms(spark, '"!') == []
    find = lambda **k: {(r["hash"], r["message_id"], r["session_id"]) for r in search.search(index, ["alpha", "beta"], references, messages, sessions, **k).collect()}
    assert find() == {("1", "m1", "s1"), ("1", "m2", "s2"), ("2", "m2", "s2"), ("4", "gone", None)}
    assert find(kind=["note"]) == {("2", "m2", "s2")} and find(project="p") == {("1", "m1", "s1")}
    assert search.search(index, [], references, messages, sessions).count() == 0
    search.write_index(blobs, str(tmp_path))
    stored, size = search.read_index(spark, str(tmp_path))
    found = search.search(stored, ["alpha", "beta"], references, messages, sessions, size=size)
    assert set(found.collect()) == set(search.search(index, ["alpha", "beta"], references, messages, sessions).collect())
    rows = search.page_of_hits(found, blobs, ["alpha"], limit=2, offset=1).collect()
    assert len(rows) == 2 and all("<mark>alpha</mark>" in r["snippet"] for r in rows)


@pytest.mark.parametrize("text, want", [
    ('```json\n{"a": 1}\n```', '{"a": 1}'), ("```\n[1]\n```", "[1]"), ('Sure: {"a": {"b": 2}} bye', '{"a": {"b": 2}}'), (" none ", "none"), ("} {", "} {"), ("", ""), (None, None),
])
def test_json_of_reply(spark, text, want):
    assert one(spark, enrich.json_of_reply(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text, want", [
    ('{"type":"init"}\nnoise\n{"type":"result","result":"yes"}\n{"type":"result","result":"no"}', "yes"),
    ('{"type":"result","result":3}', '{"type":"result","result":3}'), ('{\n"result": "old"\n}', "old"), ("plain", "plain"), (None, None),
])
def test_result_of_output(spark, text, want):
    assert one(spark, enrich.result_of_output(F.lit(text).cast("string"))) == want


def test_stored_enrichments_replace_tags(spark):
    done = spark.createDataFrame([(1, "t", [("a", 0.9), ("a", 0.95)], "approved"), (2, "u", [], "pending_review")], "session_id long, title string, tags array<struct<tag string, confidence double>>, approval_status string")
    rows, tags = store.stored_enrichments(done, "m", "now", 3)
    assert {(r["session_id"], r["version"], r["reviewed_at"]) for r in rows.collect()} == {(1, 3, "now"), (2, 3, None)}
    old = spark.createDataFrame([(1, "z", 0.1), (2, "z", 0.1), (3, "z", 0.1)], "session_id long, tag string, confidence double")
    assert {tuple(r) for r in store.retagged(old, tags, rows).collect()} == {(1, "a", 0.95), (3, "z", 0.1)}
    known = spark.createDataFrame([(1, "success", None, False)], "session_id long, outcome string, reason_code string, is_user_labeled boolean")
    labels = spark.createDataFrame([(1, "failed", "unknown"), (4, "partial", None)], "session_id long, outcome string, reason_code string")
    assert {tuple(r) for r in store.labelled(known, labels, True).collect()} == {(1, "failed", "unknown", True), (4, "partial", None, True)}
    week = enrich.digest_rows(spark.createDataFrame([(2, "text")], "session_count long, content string"), "a", "b", "now").first()
    assert (week["start_date"], week["created_at"], week["content"]) == ("a", "now", "text")


@pytest.mark.parametrize("text, most, want", [("abc", 3, "abc"), ("abcd", 3, "abc..."), ("aé🙂", 2, "a..."), ("aé🙂", 6, "aé..."), ("🙂🙂", 4, "🙂..."), (None, 3, None)])
def test_cut_bytes(spark, text, most, want):
    assert one(spark, T.cut_bytes(F.lit(text).cast("string"), most)) == want


def test_small_functions(spark):
    assert one(spark, T.last_segment(F.lit("/a/b/"))) == "" and one(spark, T.last_segment(F.lit("a"))) == "a"
    assert one(spark, T.epoch_millis_text(F.lit(1500))) == "1970-01-01T00:00:01+00:00"
    assert [one(spark, T.human_bytes(F.lit(n))) for n in (5, 2048, 3 << 20)] == ["5 B", "2.0 KB", "3.0 MB"]
    # halfway between two decimals: the even one, as printf does
    assert [one(spark, T.human_bytes(F.lit(n))) for n in (1280, 1792, 1281, (1 << 20) * 122 + (1 << 18), (5 << 28))] == ["1.2 KB", "1.8 KB", "1.3 KB", "122.2 MB", "1.2 GB"]
    assert one(spark, T.short_tool(F.lit("mcp__git__statusTool"))) == "status"
    assert one(spark, F.lit("plans/a/b.md").rlike(T.glob_regex("plans/**/*.md")))
    assert not one(spark, F.lit("plans/a/b.md").rlike(T.glob_regex("plans/*.md")))


def test_redaction_skips_bad_patterns(spark):
    text = "k sk-" + "a" * 48 + " ghp_" + "b" * 36 + " safe AIza" + "c" * 35
    assert one(spark, store.redacted(F.lit(text), ["(", "safe"])) == "k [REDACTED] [REDACTED] [REDACTED] [REDACTED]"


def test_auto_approval_and_review(spark):
    tags = spark.createDataFrame([(1, 0.9), (1, 0.8), (2, 0.9), (2, 0.1)], "session_id long, confidence double")
    rows = store.auto_approved(tags, 0.8)
    assert {tuple(r) for r in rows.collect()} == {(1, "approved"), (2, "pending_review")}
    assert {tuple(r) for r in store.reviewed(rows, None, "rejected").collect()} == {(1, "approved"), (2, "rejected")}
    rich = browsing.tags_of(spark.createDataFrame([(1,), (3,)], "session_id long"), tags.withColumn("tag", F.lit("t")), "session_id")
    assert {r["session_id"]: len(r["tags"]) for r in rich.collect()} == {1: 2, 3: 0}


def test_digest_limits(spark):
    rows = spark.createDataFrame([(1, i, f"m{i}", "user", "é" * 400 if i else "") for i in range(60)], "session_id long, turn_index int, id string, type string, content string")
    digest = enrich.digests(rows, ["turn_index"]).first()["digest"]
    lines = digest.split("\n")
    assert len(lines) <= 20 and all(line.startswith("user: ") and line.endswith("...") for line in lines)
    assert len("".join(lines[:-1]).encode()) < 7500


def test_empty_tables(spark):
    none = spark.createDataFrame([], "session_id long, tool_name string, timestamp string, id long, size long, hash string, created_at string, modified_at string")
    row = analytics.overview(none, none, none).first()
    assert (row["total_sessions"], row["total_blob_bytes"], row["first_session"]) == (0, 0, None)
    assert analytics.storage_overview(none, none).first()["dedup_ratio"] == 0.0
    assert analytics.tool_frequency(none).count() == 0


def turn(i):
    return json.dumps({"type": "user", "uuid": f"u{i}", "sessionId": "s", "timestamp": f"2026-01-01T00:00:{i:02}Z", "message": {"role": "user", "content": f"text {i}"}}) + "\n"


def test_incremental_runs(spark, tmp_path):
    root, path = tmp_path / "in", str(tmp_path / "house")
    os.makedirs(root / "projects/p")
    log = root / "projects/p/s.jsonl"
    log.write_text(turn(1) + turn(2))
    first = warehouse.run(spark, str(root), path, now="2026-01-01 00:00:00")
    assert (first["files"], first["unchanged"], first["deleted"]) == (1, 0, 0)
    again = warehouse.run(spark, str(root), path, now="2026-01-01 00:00:01")
    assert (again["files"], again["unchanged"]) == (0, 1)
    with log.open("a") as f:
        f.write(turn(3))
    (root / "projects/p/t.jsonl").write_text(turn(4))
    third = warehouse.run(spark, str(root), path, now="2026-01-01 00:00:02")
    assert third["files"] == 2
    house = warehouse.Warehouse(spark, path)
    assert sorted(r["id"] for r in house.table("messages").collect()) == ["u1", "u2", "u3", "u4"]
    full = warehouse.run(spark, str(root), path, full=True, now="2026-01-01 00:00:03")
    assert full["unchanged"] == 0 and house.table("messages").count() == 4 and house.table("content_store").count() == 4
    runs = store.newest(house.table("index_runs"), "started_at", "run_id").collect()
    assert [(r["run_id"], r["status"]) for r in runs] == [(r["run_id"], "completed") for r in (full, third, again, first)]
    assert first["messages_added"] > 0 and again["messages_added"] == full["messages_added"] == 0
    assert sum(r["messages_added"] for r in runs) == house.table("messages").count() and sum(r["blobs_added"] for r in runs) == house.table("content_store").count()


def test_several_sources_in_one_warehouse(spark, tmp_path):
    """Files of one source are not gone because the run over another does not list them."""
    path = str(tmp_path / "house")
    sources = [config.Source(n, str(tmp_path / n), "Claude") for n in ("one", "one-more")]
    for i, s in enumerate(sources):
        os.makedirs(f"{s.path}/projects/p")
        with open(f"{s.path}/projects/p/s{i}.jsonl", "w") as f:
            f.write(turn(i).replace('"s"', f'"s{i}"'))
    rows = warehouse.run_all(spark, sources, path, now="2026-01-01 00:00:00")
    assert [(r["files"], r["deleted"], r["messages_added"]) for r in rows] == [(1, 0, 1), (1, 0, 1)]
    again = warehouse.run_all(spark, sources, path, now="2026-01-01 00:00:01")
    assert [(r["files"], r["unchanged"], r["deleted"]) for r in again] == [(0, 1, 0), (0, 1, 0)]
    house = warehouse.Warehouse(spark, path)
    assert {r["id"]: r["source_name"] for r in house.table("sessions").collect()} == {"s0": "one", "s1": "one-more"}


def test_grown_log_beside_an_index(spark, tmp_path):
    """The index names the session in the first run; only the log grows; the indexed row and its columns stay."""
    root, path = tmp_path / "in", str(tmp_path / "house")
    os.makedirs(root / "projects/p")
    log = root / "projects/p/s.jsonl"
    log.write_text(turn(1) + turn(1).replace("text 1", "a second line of one id") + turn(2))
    (root / "projects/p/sessions-index.json").write_text(json.dumps({"originalPath": "/home/x/proj", "entries": [{"sessionId": "s", "firstPrompt": "Please", "messageCount": 9, "created": "2026-01-01"}]}))
    warehouse.run(spark, str(root), path, now="2026-01-01 00:00:00", source=("home", "Claude"))
    with log.open("a") as f:
        f.write(turn(3) + turn(4).replace('"s"', '"other"'))
    warehouse.run(spark, str(root), path, now="2026-01-01 00:00:01", source=("home", "Claude"))
    house = warehouse.Warehouse(spark, path)
    found = {r["id"]: r for r in house.table("sessions").collect()}
    assert set(found) == {"s", "other"}
    assert (found["s"]["first_prompt"], found["s"]["message_count"], found["s"]["project_slug"], found["s"]["source_kind"]) == ("Please", 9, "proj", "claude")
    texts = {r["id"]: r["content"] for r in house.table("messages").collect()}
    assert texts == {"u1": "text 1", "u2": "text 2", "u3": "text 3", "u4": "text 4"}  # of one id the first line counts
    index = json.loads((root / "projects/p/sessions-index.json").read_text())
    index["entries"][0] |= {"messageCount": 11}
    (root / "projects/p/sessions-index.json").write_text(json.dumps(index) + " ")
    warehouse.run(spark, str(root), path, now="2026-01-01 00:00:02", source=("home", "Claude"))
    assert {r["id"]: r["message_count"] for r in house.table("sessions").collect()} == {"s": 11, "other": None}


def test_last_row_counts_on_the_first_run(spark, tmp_path):
    house = warehouse.Warehouse(spark, str(tmp_path / "house"))
    rows = spark.createDataFrame([("s", "1", "b.json", "done"), ("s", "1", "a.json", "open")], "session_id string, id string, file string, status string")
    assert [r["status"] for r in house.merged("tasks", rows).collect()] == ["done"]
    house.commit({"tasks": house.merged("tasks", rows)})
    newer = rows.filter("file = 'a.json'")
    assert [r["status"] for r in house.merged("tasks", newer).collect()] == ["open"]
    assert [r["status"] for r in house.merged("tasks", newer, absent=True).collect()] == ["done"]


def test_two_backups_store_a_content_once(spark, tmp_path):
    files = spark.createDataFrame([("/x/a.jsonl", b"one"), ("/x/b.jsonl", b"two")], "path string, content binary")
    first = warehouse.backup(files, str(tmp_path / "b"), "2026-01-01 00:00:00")
    second = warehouse.backup(files.unionByName(spark.createDataFrame([("/x/c.jsonl", b"three")], files.schema)), str(tmp_path / "b"), "2026-01-02 00:00:00")
    stored = spark.read.parquet(str(tmp_path / "b"))
    assert stored.count() == 3 and warehouse.content_of(second, stored, "a").count() == 1
    assert warehouse.swept(first, stored).count() == 2


def test_backups(spark, tmp_path):
    files = spark.createDataFrame([("/x/rollout-2026-aaaaaaaa-0000-0000-0000-000000000001.jsonl", b"one"), ("/x/b.jsonl", b"one"), ("/x/c.jsonl", b"two")], "path string, content binary")
    kept = warehouse.backup(files, str(tmp_path / "b"), "2026-01-01 00:00:00")
    assert sorted(r["session_id"] for r in kept.collect()) == ["aaaaaaaa-0000-0000-0000-000000000001", "b", "c"]
    stored = spark.read.parquet(str(tmp_path / "b"))
    assert stored.count() == 2 and warehouse.verify(stored).count() == 0
    assert bytes(warehouse.content_of(kept, stored, "c").first()["content"]) == b"two"
    now = F.to_timestamp(F.lit("2026-02-01 00:00:00"))
    assert warehouse.pruned(kept, 10, now).count() == 0 and warehouse.pruned(kept, 60, now).count() == 3 and warehouse.pruned(kept, 0, now).count() == 3


def test_settings(tmp_path):
    at = tmp_path / "s.toml"
    at.write_text('interval_minutes = 5\nunknown = 1\n[[sources]]\nname = "a"\npath = "~/x"\nkind = "k"\n')
    found = config.load(str(at))
    assert found.interval_minutes == 5 and found.sources[0].path == os.path.expanduser("~/x") and config.load(None).approve_at == 0.8
    a, b = config.Source("a", "/1", "k"), config.Source("b", "/1", "k")
    assert config.all_sources([a], [b, config.Source("c", "/2", "k")])[0].name == "a"


def test_cut_texts_of_all_documents(spark, sf_dir):
    from sessionloom.plans import catalogue

    def cut(text):
        if text is None or len(text.encode()) <= 40:
            return text
        return text.encode()[:40].decode("utf-8", "ignore") + "..."

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in catalogue.QUERIES["cut_texts"](spark, sf_dir).collect())
    assert got == sorted((r["doc_id"], cut(r["text"])) for r in rows)
    assert sum(s is not None and s.endswith("...") for _, s in got) > len(rows) // 2


def test_ages(spark):
    now = F.lit("2026-03-02 12:00:00")
    ages = {
        "2026-03-02 13:00:00": "just now", "2026-03-02 11:00:00.000001": "just now", "2026-03-02 11:00:00": "1h ago", "2026-03-01 12:00:00.5": "23h ago",
        "2026-03-01 12:00:00": "yesterday", "2026-02-28 12:00:01": "yesterday", "2026-02-28 12:00:00": "Feb 28", "2024-11-05 00:00:00": "Nov 5", None: None,
    }
    rows = spark.createDataFrame([(k,) for k in ages], "t string").select("t", analytics.age(F.col("t"), now).alias("age"))
    assert {r["t"]: r["age"] for r in rows.collect()} == ages
