"""Outcomes and enrichments: the learned classifier against a brute-force version, backends, and what a warehouse stores of both."""

import hashlib
import json
import math
import random
import re

import pytest

from sessionloom.functions.text import plain_tokens
from sessionloom.operators import enrich, outcomes, warehouse
from sessionloom.streaming import live, tail
from tests.test_runs import line

DIGEST, LABEL = "session_id string, digest string", "session_id string, outcome string, reason_code string"


def words_of(text):
    return {int(hashlib.md5(w.encode()).hexdigest()[:4], 16) for w in re.findall("[a-z0-9]+", (text or "").lower())}


def brute(digests, labels):
    known = {s: (o, None if o == "success" else r or "unknown") for s, o, r in labels if o}
    texts, out = dict(digests), {}

    def best(text, column, kinds):
        of = {k: [s for s in known if known[s][column] == k and s in texts] for k in kinds}
        n, scores = sum(map(len, of.values())), []
        held = set().union(*(words_of(texts[s]) for ss in of.values() for s in ss))
        for k in kinds:
            sizes = sum(len(words_of(texts[s])) for s in of[k])
            score = round(math.log((len(of[k]) + 1) / (n + len(kinds))) * 1e6)
            for b in words_of(text) & held:
                score += round(math.log((sum(b in words_of(texts[s]) for s in of[k]) + 1) / (sizes + len(held))) * 1e6)
            scores.append(score)
        top = max(scores)
        return kinds[scores.index(top)], round(1 / sum(math.exp((s - top) / 1e6) for s in scores), 4)

    for s, text in digests:
        if s not in known:
            outcome, p = best(text, 0, outcomes.OUTCOMES)
            out[s] = (outcome, None if outcome == "success" else best(text, 1, outcomes.REASONS)[0], p)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_learned_as_brute_force(spark, seed):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "... !", " ".join(rng.choice("alpha beta gamma Delta tool lost é 7 crash done".split()) for _ in range(rng.randint(1, 12)))])
    digests = [(str(i), text()) for i in range(60)]
    labels = [(str(i), rng.choice([None, "strange", *outcomes.OUTCOMES]), rng.choice([None, "strange", *outcomes.REASONS])) for i in range(0, 80, 2)]
    labels = [(s, o, r) for s, o, r in labels if o != "strange" or int(s) < 60]
    got = outcomes.learned(spark.createDataFrame(digests, DIGEST), spark.createDataFrame(labels, LABEL), words=plain_tokens)
    rows = got.collect()
    want = brute(digests, labels)
    assert {r["session_id"]: tuple(r)[1:] for r in rows} == want and len(rows) == len(want)


def test_nothing_learned_and_empty_tables(spark):
    digests, none = spark.createDataFrame([("a", "some words"), ("b", None)], DIGEST), spark.createDataFrame([], LABEL)
    assert sorted(map(tuple, outcomes.learned(digests, none).collect())) == [("a", "success", None, 0.25), ("b", "success", None, 0.25)]
    assert outcomes.learned(digests, none, least=0.5).count() == 0 and outcomes.learned(digests.limit(0), none).count() == 0


def test_accuracy_on_sessions_that_were_held_out(spark):
    rng = random.Random(3)
    marks = {"success": "passes merged thanks works", "failed": "loop broken still wrong", "partial": "half remaining later rest", "abandoned": "never mind stop leave"}
    common = "the file test run code function change error fix please look add".split()
    rows = [(str(i), " ".join(rng.choices(common, k=30) + rng.choices(marks[k].split(), k=2)), k) for i in range(400) for k in [rng.choice(outcomes.OUTCOMES)]]
    digests = spark.createDataFrame([r[:2] for r in rows], DIGEST)
    labels = spark.createDataFrame([(s, k, None) for s, _, k in rows[:200]], LABEL)
    got = {r["session_id"]: r["outcome"] for r in outcomes.learned(digests, labels).collect()}
    assert len(got) == 200 and sum(got[s] == k for s, _, k in rows[200:]) >= 190


def test_replies(spark):
    replies = [
        ("1", '{"outcome": "success", "reason_code": "unknown"}'), ("2", 'Sure: {"outcome": "failed", "reason_code": "tool_misuse"} there'), ("3", '```json\n{"outcome": "partial"}\n```'),
        ("4", '{"outcome": "failed", "reason_code": "bad luck"}'), ("5", '{"outcome": "won"}'), ("6", "no idea"), ("7", None), ("8", ""), ("9", '{"type": "result", "result": "{\\"outcome\\": \\"abandoned\\"}"}'),
    ]
    got = outcomes.told(spark.createDataFrame(replies, "session_id string, reply string"))
    assert sorted(map(tuple, got.collect())) == [("1", "success", None), ("2", "failed", "tool_misuse"), ("3", "partial", "unknown"), ("4", "failed", "unknown"), ("9", "abandoned", "unknown")]


def judge():
    def reply(text):
        assert text.startswith(outcomes.INSTRUCTIONS)
        if "text 3" in text:
            raise RuntimeError("no reply")
        return json.dumps({"outcome": "failed" if "text 2" in text else "success", "reason_code": "context_drift"})

    return reply


def namer(version):
    def reply(text):
        if "text 3" in text:
            return "no"
        return json.dumps({"title": f"{version}: {text.split(': ')[1][:6]}", "tags": [{"tag": f"{version}", "confidence": 0.9}, {"tag": "both", "confidence": 0.95}]})

    return reply


@pytest.fixture(scope="module")
def house(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("judged")
    (at / "in/projects/p").mkdir(parents=True)
    for i in range(6):
        (at / f"in/projects/p/s{i}.jsonl").write_text(line(i, f"s{i}") if i < 5 else line(i, "s5", content=""))
    (at / "in/usage-data/facets").mkdir(parents=True)
    (at / "in/usage-data/facets/s0.json").write_text(json.dumps({"session_id": "s0", "outcome": "partial"}))
    warehouse.run(spark, str(at / "in"), str(at / "house"))
    return warehouse.Warehouse(spark, str(at / "house"))


def kept(house):
    return {r["session_id"]: (r["outcome"], r["reason_code"], r["is_user_labeled"]) for r in outcomes.stored_outcomes(house).collect()}


def test_a_warehouse_is_classified(spark, house):
    assert kept(house) == {"s0": ("partial", None, False)}
    outcomes.set_by_user(house, spark.createDataFrame([("s1", "abandoned", None)], LABEL))
    newest = outcomes.classify(house, judge(), "stub", limit=1, attempts=1)
    assert newest == {"total_candidates": 1, "classified": 0, "skipped": 1, "failed": 0}  # s5 says nothing
    counts = outcomes.classify(house, judge(), "stub", again=False, attempts=1)
    assert counts == {"total_candidates": 4, "classified": 2, "skipped": 1, "failed": 1}
    want = {"s0": ("partial", None, False), "s1": ("abandoned", None, True), "s2": ("failed", "context_drift", False), "s4": ("success", None, False)}
    assert kept(house) == want
    assert outcomes.classify(house, judge(), "stub", attempts=1) == {"total_candidates": 5, "classified": 3, "skipped": 1, "failed": 1}
    assert kept(house) == want | {"s0": ("success", None, False)}
    # the learned classifier: one label of a user says little, so most stay below the bound, and what users set stays
    learned = outcomes.classify(house, least=0.9)
    assert learned == {"total_candidates": 5, "classified": 0, "skipped": 1, "failed": 4}
    assert outcomes.classify(house, least=0.0, again=False) == {"total_candidates": 2, "classified": 1, "skipped": 1, "failed": 0}
    assert kept(house)["s3"][2] is False and kept(house)["s1"] == ("abandoned", None, True)
    assert outcomes.classify(house, judge(), "stub", force=True, attempts=1)["total_candidates"] == 6
    assert kept(house)["s1"] == ("success", None, False)


def test_a_warehouse_is_enriched(house):
    assert enrich.enrich_sessions(house, namer("a"), "stub", "2026-01-01 00:00:00", limit=1) == {"total_candidates": 1, "enriched": 0, "skipped": 1, "failed": 0}
    assert enrich.enrich_sessions(house, namer("a"), "stub", "2026-01-01 00:00:00") == {"total_candidates": 6, "enriched": 4, "skipped": 1, "failed": 1}
    rows = {r["session_id"]: r for r in house.table("session_enrichments").collect()}
    assert sorted(rows) == ["s0", "s1", "s2", "s4"] and rows["s1"]["title"] == "a: text 1" and rows["s1"]["approval_status"] == "approved"
    assert [tuple(t) for t in rows["s1"]["tags"]] == [("a", 0.9), ("both", 0.95)]
    assert enrich.enrich_sessions(house, namer("b"), "stub", "2026-01-02 00:00:00")["total_candidates"] == 2
    assert enrich.enrich_sessions(house, namer("b"), "stub", "2026-01-02 00:00:00", version=2)["enriched"] == 4
    rows = {r["session_id"]: r for r in house.table("session_enrichments").collect()}
    assert [tuple(t) for t in rows["s1"]["tags"]] == [("b", 0.9), ("both", 0.95)] and len(rows) == 4


def test_steps_follow_each_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text(line(1, "a"))
    seen, path = [], str(tmp_path / "house")
    steps = [live.enrich_new(namer("a"), "stub", seen.append), live.classify_new(judge(), "stub", seen.append, attempts=1)]

    def go():
        live.keep_up(tail.tail(spark, str(tmp_path / "in/*.jsonl")), path, str(tmp_path / "state"), then=steps).awaitTermination()

    go()
    (tmp_path / "in/b.jsonl").write_text(line(2, "b"))
    go()
    house = warehouse.Warehouse(spark, path)
    assert kept(house) == {"a": ("success", None, False), "b": ("failed", "context_drift", False)}
    assert [s["total_candidates"] for s in seen] == [1, 1, 1, 1]
    assert house.table("session_enrichments").count() == 2
