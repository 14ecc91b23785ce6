"""Filter audit, phrase fingerprints and the conversation trie against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from sessionloom.llm import audit, lzprint, trie

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture
def many_partitions(spark):
    """Small tables in many tasks, as large ones would be."""
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# op11


def brute_audit(rows, labels):
    """rows: (doc_id, source, text), labels: (doc_id, quality, toxic); one document and one order after the other."""
    least = {}
    for i, _, text in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[at] == 1} for at in (1, 2))
    docs = []
    for i, source, text in rows:
        text = text or ""
        words = WORD.findall(text)
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and least[text] < i,
        }
        docs.append((source or "", {k for k, v in failed.items() if v}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {d[0] for d in docs}:
            for step, letter in enumerate(order, 1):
                m = Counter()
                for _, failed, is_good, is_toxic in (d for d in docs if d[0] == part):
                    earlier, fails = bool(failed & set(order[: step - 1])), letter in failed
                    m["kept"] += not earlier and not fails
                    m["removed"] += fails and not earlier
                    m["redundant"] += fails and earlier
                    m["unique_fails"] += failed == {letter}
                    m["good_lost"] += fails and not earlier and is_good
                    m["toxic_lost"] += fails and not earlier and is_toxic
                shapley[part, letter] += m["removed"]
                out[part, order, step] = m
    return {k: (*(m[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), shapley[k[0], k[1][k[2] - 1]]) for k, m in out.items()}


def odd_documents():
    rng = random.Random(11)
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "  \t\n", long, long + " #", long.upper(), "same " * 300, "é" * 40 + "AB", "\x1cone\x85two　three", long + "\nRe$t", "A", "B" * 500_000]
    rows = [(i, ["a", "b", None, ""][i % 4], texts[i % len(texts)]) for i in range(60)]
    rows += [(None, "a", long), (None, "a", None), (None, "n", "only here"), (7, "a", texts[7]), (7, "b", texts[7]), (7, "b", "another text of the same id")]
    rows += [(1000 + i, "hot", long) for i in range(40)]
    rng.shuffle(rows)
    return rows


def test_audit_as_brute_force(spark, many_partitions):
    rows = odd_documents()
    labels = [(i, i % 2, i % 3) for i in range(0, 60, 2)] + [(None, 1, 1), (4, 1, 1), (4, None, None), (6, None, 1), (1001, 1, None), (99999, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, source string, text string, part int, mask int, labelled int")
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = {(r[0], r[1], r[2]): tuple(r)[3:] for r in audit.audit(audit.cells(docs, marks)).collect()}
    assert got == brute_audit(rows, labels)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(audit.cells(docs, labels)).count() == 0
    one = spark.createDataFrame([(1, None, "x")], "doc_id long, source string, text string")
    rows = audit.audit(audit.cells(one, labels)).collect()
    assert len(rows) == 600 and {r["part"] for r in rows} == {""} and sum(r["removed"] for r in rows) == 120


def test_audit_of_other_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 1, 1), ("p", 3, 2, 0, 2)], "part string, mask int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in audit.audit(cells, "XY").collect()}
    assert got == {("XY", 1): (5, 5, 0, 3, 1, 3, 8), ("XY", 2): (5, 0, 2, 0, 0, 0, 2), ("YX", 1): (8, 2, 0, 0, 0, 2, 2), ("YX", 2): (5, 3, 2, 3, 1, 1, 8)}


# op12


def brute_signature(text):
    """Phrases as a set of byte strings, each hashed by itself."""
    data, mask, base = text.encode(), (1 << 64) - 1, 0x9E3779B97F4A7C15
    seen, at = set(), 0
    for end in range(1, len(data) + 1):
        if data[at:end] not in seen:
            seen.add(data[at:end])
            at = end
    least = {}
    for phrase in seen:
        h = (sum((b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(phrase)) + len(phrase)) & mask
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & mask
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & mask
        h ^= h >> 31
        least[h >> 56] = min(h, least.get(h >> 56, mask))
    return [min((least[b] >> 40) & 0xFFFF, 0xFFFE) if b in least else 0xFFFF for b in range(256)]


def brute_likeness(a, b):
    filled = [(x, y) for x, y in zip(a, b) if x != 0xFFFF or y != 0xFFFF]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def brute_prints(rows):
    """Rows (doc_id, text) in the order of the operator."""
    out = []
    for at, (i, text) in enumerate(rows):
        text, after = text or "", rows[(at + 1) % len(rows)][1] or ""
        h = len(text) // 2
        edited = text[: len(text) - h] + after[:h]
        a, b, c = brute_signature(text), brute_signature(edited), brute_signature(after)
        hexed = lambda s: "".join(f"{x:04x}" for x in s)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), brute_likeness(a, b), brute_likeness(a, c)))
    return out


def test_fingerprints_as_brute_force(spark, many_partitions):
    rng = random.Random(12)
    texts = ["", None, "a", "ab", "é", "aé𝄞b", "a" * 3000, " ".join(f"w{rng.randint(0, 60)}" for _ in range(700)), "ab" * 500, "\x00\x00\x01", "".join(chr(rng.randint(32, 0x3000)) for _ in range(400))]
    ids = rng.sample(range(-50, 400), 120)
    rows = [(i, rng.choice(texts)) for i in ids]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rng.sample(rows, len(rows))], "doc_id long, text string, run int, guest int, tie string").repartition(7)
    want = brute_prints(sorted(rows, key=lambda r: -r[0]))
    assert sorted(map(tuple, lzprint.edited_prints(docs).collect())) == sorted(want)
    alone = {r["doc_id"]: r["fingerprint"] for r in lzprint.fingerprints(docs).collect()}
    assert alone == {r[0]: r[3] for r in want}


@pytest.mark.parametrize("rows", [[], [(5, "only one")], [(5, None)], [(5, "ab"), (6, "cdef")]])
def test_fingerprints_of_few(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, lzprint.edited_prints(docs).collect())) == sorted(brute_prints(sorted(rows, key=lambda r: -r[0])))


def test_fingerprints_of_repeated_and_missing_ids(spark, many_partitions):
    rows = [(1, "one text")] * 50 + [(2, "x y z")] * 3 + [(2, "z y x w v")] * 2 + [(None, "without an id")] * 4 + [(None, f"another {i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = lzprint.edited_prints(docs).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, "".join(f"{x:04x}" for x in brute_signature(t))) for i, t in rows)
    assert sum(r["near_next"] == 1.0 for r in got if r["doc_id"] == 1) == 49  # all but the last have an equal text next


def test_fingerprints_tell_edits_from_other_texts(spark):
    rows = lzprint.op12_lzprint(spark, MEDIUM).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    order = sorted(texts, reverse=True)
    for at, i in enumerate(order):
        r, h = next(x for x in rows if x["doc_id"] == i) if at < 5 else None, len(texts[i]) // 2
        if r:
            assert r["edited_sha256"] == hashlib.sha256((texts[i][: len(texts[i]) - h] + texts[order[(at + 1) % len(order)]][:h]).encode()).hexdigest()
    wide = [r for r in rows if r["n_chars"] >= 200]
    assert np.mean([r["near_edited"] > r["near_next"] for r in wide]) > 0.97
    by_print = defaultdict(set)
    for r in rows:
        by_print[texts[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_print.values())


# op13


def brute_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = bytes.fromhex(hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest())
            own[c].append((turn is not None, turn or 0, role, key, text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute_trie(paths):
    """paths: {conv_id: list of (role, text)}."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    total = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(node[-1][1])) if node else 0
        below = [total[x] for x in children[node]]
        total[node] = (sum(x[0] for x in below) or 1, (len(members[node]) - 1) * words + sum(x[1] for x in below))
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), *total[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, m in members.items()
    )


def shown(rows):
    return sorted(tuple(-(10**9) if x is None else x for x in r) for r in rows)


KIND = "conv_id long, turn long, role string, text string, path int, words string, run int"


def built(spark, rows, parts=6):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], KIND).repartition(parts)
    return trie.rebuilt(trie.arrays(df))


@pytest.mark.parametrize("seed", range(4))
def test_trie_as_brute_force(spark, many_partitions, seed):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-60, 900), 400):
        for turn in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            rows.append((c, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]) if seed > 1 else "user", rng.choice(["a", "b c", "", None, "d e f"]) if rng.random() < 0.9 else f"own {rng.random()}"))
    rows += [(None, 0, "user", "nobody's")] * 3
    rows += [(2000 + i, t, "user", x) for i in range(200) for t, x in enumerate(["the same", "opening", "for", "a third", "of all", "rows"])]
    got = trie.trie(built(spark, rows)).collect()
    assert shown(got) == shown(brute_trie(brute_rebuilt(rows)))


def test_trie_of_few(spark):
    assert trie.trie(built(spark, [], 1)).count() == 0
    for rows in ([(3, None, None, None)], [(0, 1, "user", "a b"), (0, 1, "user", "a b"), (0, None, "user", "first")], [(c, 0, "u", "t") for c in range(40)]):
        assert shown(trie.trie(built(spark, rows)).collect()) == shown(brute_trie(brute_rebuilt(rows)))


def test_trie_of_long_and_chained_conversations(spark, many_partitions):
    chain = [f"turn {i}" for i in range(300)]
    rows = [(1000 + c, t, "user", x) for c in range(0, 60) for t, x in enumerate(chain[: 5 * c + 1])]
    assert shown(trie.trie(built(spark, rows)).collect()) == shown(brute_trie(brute_rebuilt(rows)))


def test_ends_of_thousands_pass_in_pieces(spark, many_partitions):
    rows = [(c, 0, "user", "only") for c in range(1, 30_000)]
    paths = spark.createDataFrame([(c, [(b"x" * 32, 2)]) for c, *_ in rows], "conv_id long, turns array<struct<digest:binary,words:long>>").repartition(5)
    got = sorted(map(tuple, trie.trie(paths).collect()), key=lambda r: r[1])
    ids = ",".join(map(str, range(1, 30_000)))
    assert got == [(1, 0, None, 29_999, 1, 1, 2 * 29_998, hashlib.sha256(b"").hexdigest()), (1, 1, 1, 29_999, 0, 1, 2 * 29_998, hashlib.sha256(ids.encode()).hexdigest())]
