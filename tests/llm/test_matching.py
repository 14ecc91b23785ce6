"""Near-duplicates, decontamination, top-k and chat against brute-force versions; the pipeline's rules."""

import hashlib
import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pytest

from sessionloom.llm import chat, decontaminate, neardup, queries, tokens, topk
from sessionloom.llm.common import blocks, table

SMALL = "/root/testdata/sf0.001"


def shown(x):
    return "null" if x is None else str(x)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    found = con.execute(queries.SQL[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    want = sorted(tuple(shown(r[at.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == want


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_groups(rows, size=2):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(i for i in sets if sets[i]), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * len(sets[a] | sets[b]) and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def family(rng, size, edits, words=60):
    base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
    out = []
    for _ in range(size):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(words)] = f"e{rng.randint(0, 10_000)}"
        out.append(" ".join(text))
    return out


def test_groups_of_many_near_copies(spark):
    rng = random.Random(8)
    texts = [None, "", " \t\n", "one", "ONE", "one two", "One  Two", "one two three"]
    for size, edits in ((120, 6), (60, 12), (40, 4), (2, 3), (2, 5)):
        texts += family(rng, size, edits)
    texts += ["chain " + " ".join(f"c{j}" for j in range(i, i + 40)) for i in range(0, 30, 2)]
    texts += texts[20:40]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, component_id int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.groups(df.repartition(3), 2).collect()}
    want = brute_groups(rows)
    assert {i: w for i, w in got.items() if w != want[i]} == {}
    kept = neardup.keep_first(df, 2)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if w[2]}


def test_groups_by_shingle_size(spark):
    rng = random.Random(9)
    rows = list(enumerate([None, "one", "a b c d", "a b c d e f", *family(rng, 30, 4), *family(rng, 20, 2, 200)]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    two, want = brute_groups(rows), brute_groups(rows, 5)
    assert {i for i, w in want.items() if w[2]} != {i for i, w in two.items() if w[2]}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.groups(df).collect()} == want
    assert {r["doc_id"] for r in neardup.keep_first(df).collect()} == {i for i, w in want.items() if w[2]}


def test_crowded_bucket_is_cut_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    members = spark.createDataFrame([(64, i) for i in range(300)] + [(65, i) for i in range(30)], "key long, id long")
    labels = spark.createDataFrame([(i, 0) for i in range(100)], "id long, label long")
    blocks = {}
    for r in neardup._dealt(*neardup._mixed(members, labels)).collect():
        blocks.setdefault((r["key"], r["block"]), []).append((r["id"], r["comp"], r["every"], r["minor"]))
    assert {k for k, _ in blocks} == {64}
    assert max(map(len, blocks.values())) <= 4 * 16
    met = [(x, y) for rows in blocks.values() for x, _, e, _ in rows if not e for y, _, f, _ in rows if f]
    assert len(met) == len(set(met)) and set(met) == {(x, y) for x in range(300) for y in range(100, 300)}


def test_unlinked_members_of_one_bucket(spark, monkeypatch):
    rng = random.Random(10)
    common = [f"t{i}" for i in range(80)]
    texts = [" ".join(common + [f"o{i}x{j}" for j in range(24)]) for i in range(150)]  # similarities near 0.6
    texts += [texts[i] + " more" for i in range(0, 150, 10)]
    rows = list(enumerate(rng.sample(texts, len(texts))))
    monkeypatch.setattr(neardup, "BLOCK", 8)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == brute_groups(rows)


def test_groups_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b c"), (3, "a b c")], "doc_id long, text string")
    assert {tuple(r) for r in neardup.groups(df, 2).collect()} == {(1, 0, 1, True), (2, 0, 2, True), (None, 2, None, True), (3, 2, 3, True)}
    assert neardup.groups(df.limit(0), 2).count() == 0


def test_groups_of_repeated_ids_and_long_texts(spark):
    """A doc_id with several texts has the links of all; a very long text is one set."""
    rng = random.Random(12)
    long = " ".join(f"w{rng.randint(0, 50_000)}" for _ in range(120_000))
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "a b c d e f"), (3, "u v w x y z"), (4, "q r s t"), (5, long), (6, long + " more"), (7, " ".join(long.split()[::-1])), (5, long)]
    got = [tuple(r) for r in neardup.groups(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string"), 2).collect()]
    assert sorted((d, c, k) for d, _, c, k in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (5, 5, True), (6, 5, False), (7, 7, True)]


def test_rarest_shingles_lose_no_link(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(["t"] + [f"c{j}" for j in range(30)] + family(rng, 1, 6, 40))) for i in range(60)] + [(60 + i, t) for i, t in enumerate(family(rng, 60, 9, 50))]
    df = spark.createDataFrame(rows, "id long, text string")
    keys: dict = {}
    for key, i in neardup._rarest(df, df.select("id"), 2).collect():
        keys.setdefault(key, set()).add(i)
    met = {p for ids in keys.values() for p in combinations(sorted(ids), 2)}
    sets = {i: shingles(t) for i, t in rows}
    linked = {(a, b) for a, b in combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert linked and linked <= met
    assert len({p for p in met if p[1] < 60}) < 200  # pages of one template do not meet


def test_bucket_of_10_000_unlinked_members(spark):
    """A hot source: pages of one template, of similarity near 0.6, in common buckets; only their near copies are linked."""
    common = [f"t{i}" for i in range(46)]
    texts = [" ".join(common + [f"o{i}x{j}" for j in range(15)]) for i in range(10_000)]
    rows = list(enumerate(texts + [texts[i] + " more" for i in range(0, 10_000, 500)]))
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 2)
    assert sorted((r["doc_id"], r["component_id"]) for r in got.filter("NOT kept").collect()) == [(10_000 + k, 500 * k) for k in range(20)]


def test_likelihood_estimate():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8, 0.95):
        n = 2000
        common = rng.integers(1 << 63, size=int(n * 2 * share / (1 + share)), dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(1 << 63, size=n - len(common), dtype=np.uint64)]) for _ in range(2))
        ra, rb = (neardup.registers(neardup.mixed(x)) for x in (a, b))
        assert (neardup.registers(neardup.mixed(np.concatenate([a, b]))) == neardup.merged(ra, rb)).all()
        found = neardup.estimate(ra[None], rb[None], np.array([float(n)]), np.array([float(n)]))[0]
        assert abs(found - share) < 0.1


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute_contamination(docs, items, window=10):
    out = []
    phrases = {}
    for item, text in items:
        w = words_of(text) if item is not None else []
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for p, owners in phrases.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found |= owners
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [16 << 20, 200])
def test_decontamination(spark, block_bytes):
    rng = random.Random(3)
    vocabulary = ["a", "b", "C", "dé", "1", "x-y", "ß"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(8, 30))) for i in range(12)] + [(20, "a b"), (21, "Zebra!"), (22, ""), (23, None), (None, "a"), (3, "zebra z")]
    docs = []
    for i in range(60):
        body = text(rng.randint(0, 300))
        if i % 3 == 0:
            body += "\n" + items[i % 12][1].upper() + ", end"
        docs.append((i, body))
    docs += [(100, None), (101, ""), (102, "the zebra."), (103, "A, b"), (0, docs[0][1])]
    df = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, n_hit int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    found = decontaminate.find(df, bench, block_bytes=block_bytes)
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str) == brute_contamination(docs, items)
    clean = decontaminate.keep_clean(df, bench, block_bytes=block_bytes)
    assert clean.columns == df.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r[0] for r in brute_contamination(docs, items) if not r[5])


def test_decontamination_with_long_repeats(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD", 500)
    docs = [(1, "a b c d " * 2000), (2, "a " * 3000), (3, "a b c d e f g h i j k")]
    items = [(1, "b c d a b c d a b c"), (2, "a a a a a a a a a a a a"), (3, "b c d e f g h i j k l")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = sorted((tuple(r[c] for c in columns) for r in decontaminate.find(df, bench).collect()), key=str)
    assert got == brute_contamination(docs, items)
    assert decontaminate.find(df.limit(0), bench).count() == 0
    assert all(not r["contaminated"] for r in decontaminate.find(df, bench.limit(0)).collect())


def brute_top(rows, k):
    usable = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in usable if i % 100 == 0}.items():
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in usable if i != q)[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8) * (i % 4), 1)]) for i in range(0, 900, 4)]
    rows += [(1000 + i, [1.0] * 8) for i in range(150)]  # many ties
    rows += [(5000, None), (5100, [1.0, None] * 4), (5200, [float("nan")] * 8), (5300, [float("inf")] * 8), (None, [1.0] * 8), (5400, [0.0] * 8), (5500, []), (5600, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    v = topk.quantised(df)
    got = set(map(tuple, topk.top_k(v.filter("vec_id % 100 = 0"), v, 10, block).collect()))
    assert got == brute_top(rows, 10)
    few = v.filter("vec_id in (0, 100, 104)")
    assert topk.top_k(few.filter("vec_id = 0"), few, 10).count() == 2
    assert topk.top_k(v.limit(0), v).count() == 0 and topk.top_k(few, v.limit(0)).count() == 0


def test_chat_folds_events(spark):
    e = [
        (1, 1, "message", 0, 0, "user", "hi"),
        (1, 2, "message", 1, 0, "assistant", "old"),
        (1, 3, "message", 2, 0, "user", "dropped by the regeneration"),
        (1, 4, "regenerate", 1, 0, "assistant", None),
        (1, 5, "delta", 1, 0, "assistant", "new "),
        (1, 6, "delta", 1, 0, "assistant", "answer"),
        (1, 7, "edit", 0, 0, "user", "hello"),
        (1, 8, "message", 2, 0, "user", "next"),
        (2, 1, "delta", 0, 0, "assistant", "only"),
        (2, 2, "delta", 0, 0, "assistant", " pieces"),
        (None, 1, "message", 0, 0, None, None),
    ]
    events = spark.createDataFrame(e, "conv_id long, seq long, kind string, turn long, message int, role string, text string").repartition(3)
    final = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat.messages(events).collect()}
    assert final == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "new answer"), (1, 2): ("user", "next"), (2, 0): ("assistant", "only pieces"), (None, 0): ("", "")}
    assert chat.digest(chat.render(chat.messages(events.limit(0)))).count() == 0


NASTY = ["", "\\", "\\\\", "###", "####", "</turn>", "</turn>\n", "<\\/turn>", "\\### Assistant: </turn> ok", "#\\##", "### assistant: x</turn>\n### user: y", "a\nb\r\n", "</tur", "\\n", ":", "é🙂"]


def test_chat_round_trip(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "a:b\\", "system"]), "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 4)))) for c in range(40) for t in range(6)]
    rows += [(50, 0, "assistant", None), (51, 0, "user", "x"), (51, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", chat.F.lit("clash"))
    rendered = chat.render(chat.messages(chat.logged(df)))
    read = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in rendered.select("conv_id", chat.parse(chat.F.col("formatted")).alias("turns")).collect()}
    want: dict = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] or "")):
        want.setdefault(c, []).append((role, text or ""))
    assert read == want


@pytest.mark.parametrize("at_once", [1, 3, 16])
def test_top_k_in_twenty_blocks(spark, monkeypatch, at_once):
    """Every block is proven to fit, and what repeats has one result: the smallest vector of a query id, each row of a candidate."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(0, 20_000, 25)]
    rows += [(100, [9.0] * 6), (100, [-9.0] * 6), (125, [3.0] * 6), (125, [3.0] * 6)]
    monkeypatch.setattr(topk, "BLOCKS_A_PASS", at_once)
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4))
    queries = v.filter("vec_id % 100 = 0")
    parts = blocks(queries.groupBy("vec_id").agg(topk.F.min("q").alias("q")), "vec_id", 10)
    assert len(parts) >= 20 and max(p.count() for p in parts) <= 10 and sum(p.count() for p in parts) == 200
    smallest = {}
    for i, x in rows:
        if i % 100 == 0:
            smallest[i] = min(smallest.get(i, x), x)
    want = set()
    for q, a in smallest.items():
        score = lambda b: sum(int(np.floor(1024 * float(np.float32(x)))) * int(np.floor(1024 * float(np.float32(y)))) for x, y in zip(a, b, strict=True))  # noqa: B023, E731
        best = sorted((-score(b), i) for i, b in rows if i != q)[:5]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert set(map(tuple, topk.top_k(queries, v, 5, 10).collect())) == want


def brute_chat(events):
    """Messages by a plain loop over each conversation's log."""
    first = lambda x: (x is not None, x if x is not None else 0)
    restarts = [(c, s, t) for c, s, k, t, *_ in events if k == "regenerate" and t is not None and s is not None]
    logs: dict = {}
    for c, s, k, t, m, role, text in events:
        if t is not None and s is not None and any(c == rc and rt < t and rs > s for rc, rs, rt in restarts):
            continue
        logs.setdefault((c, t, m), []).append((first(s), k, role or "", text or ""))
    out: dict = {}
    for (c, t, m), log in logs.items():
        log.sort()
        begin = max((i for i, e in enumerate(log) if e[1] in ("message", "edit", "regenerate")), default=0)
        out.setdefault(c, []).append((first(t), m, log[begin][2], "".join(e[3] for e in log[begin:])))
    return {c: [(role, text) for _, _, role, text in sorted(rows)] for c, rows in out.items()}


def test_chat_as_brute_force(spark):
    """Random logs with null turns and numbers, ties, repeated events, a long text and a busy conversation."""
    rng = random.Random(14)
    events = []
    for i in range(3000):
        turn = rng.choice([None, *range(6)])
        events.append((rng.choice([0, 0, 0, 1, 2, 3, None]), rng.choice([None, rng.randint(0, 400)]), rng.choice(["message", "delta", "delta", "edit", "regenerate", "other"]) if i % 9 else "regenerate", turn, rng.randint(0, 1), rng.choice([None, "user", "assistant"]), rng.choice([None, "", "### x", f"t{i} "])))
    events += events[:40]
    events += [(9, 1, "message", 0, 0, "assistant", "</turn> \\" * 200_000), (9, 2, "delta", 0, 0, "assistant", "end")]
    df = spark.createDataFrame([(*e, "clash") for e in events], "conv_id long, seq long, kind string, turn long, message int, role string, text string, formatted string").repartition(3)
    rendered = chat.render(chat.messages(df))
    read = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in rendered.select("conv_id", chat.parse(chat.F.col("formatted")).alias("turns")).collect()}
    assert read == brute_chat(events)


def test_pipeline(spark):
    """Every stage against a brute-force version of its rule, on what its predecessor kept."""
    import corpus_pipeline
    from test_files import assert_packed
    from test_models import brute_bayes, brute_quality

    docs = table(spark, SMALL, "documents")
    stage, columns = dict(corpus_pipeline.STAGES), docs.columns
    for name in ("language", "quality", "near_duplicates", "decontamination"):
        rows = docs.collect()
        docs = stage[name](spark, docs, SMALL)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept = {r["doc_id"] for r in docs.collect()}
        before = [(r["doc_id"], r["text"]) for r in rows]
        if name == "language":
            found = brute_bayes([(r["doc_id"], r["text"], r["lang"]) for r in rows])
            want = {i for i, (lang, score) in found.items() if lang != "und" and score >= 0.5}
        elif name == "quality":
            labels = [tuple(r) for r in table(spark, SMALL, "labels").select("doc_id", "quality").collect()]
            want = {i for i, score in brute_quality(before, labels).items() if score >= 0.3}
        elif name == "near_duplicates":
            want = {i for i, g in brute_groups(before, 5).items() if g[2]}
        else:
            items = [tuple(r) for r in table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
            want = {r[0] for r in brute_contamination(before, items) if not r[5]}
        assert kept == want, name
    packed = corpus_pipeline.run(spark, SMALL)
    assert_packed(packed.collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], tokens.load(tokens.vocabulary("byte_bpe_50k.json")))
