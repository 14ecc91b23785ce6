"""Language identification and quality: held-out accuracy, and rows of every odd kind."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from sessionloom.llm import langid, quality

MEDIUM = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = langid.op2_langid(spark, MEDIUM).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) >= 0.98 * len(out)


SMALL = "/root/testdata/sf0.001"


def brute_bayes(rows):
    """Multinomial naive Bayes with one loop over every n-gram; rows are (doc_id, text, lang)."""
    odd, mask = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), 0xFFFFFFFF

    def grams(text):
        points = [0, 0, *map(ord, text.lower()), 0, 0]
        for order in range(3):
            for i in range(len(points) - order):
                h = sum(points[i + j] * odd[j] for j in range(order + 1)) & mask
                h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & mask
                yield (h >> 7) & 0xFFFF

    counts, docs = {}, Counter()
    for doc_id, text, lang in rows:
        if not held(doc_id) and lang is not None and text is not None:
            docs[lang] += 1
            counts.setdefault(lang, Counter()).update(grams(text))
    total = {lang: sum(c.values()) + 0.5 * 0x10000 for lang, c in counts.items()}
    out = {}
    for doc_id, text, _ in rows:
        if text is None or not any(map(str.isalpha, text)):
            out[doc_id] = ("und", 0.0)
            continue
        seen = Counter(grams(text))
        logs = {lang: math.log(docs[lang] / docs.total()) + sum(n * math.log((c[g] + 0.5) / total[lang]) for g, n in seen.items()) for lang, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        out[doc_id] = (best, 1 / sum(math.exp(x - logs[best]) for x in logs.values()))
    return out


def test_language_as_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]
    want = brute_bayes(rows)
    for r in langid.op2_langid(spark, SMALL).collect():
        assert (r["lang_pred"], pytest.approx(r["score"], abs=1e-6)) == want[r["doc_id"]]


def test_languages_in_blocks(spark, monkeypatch):
    """More languages than a block holds: the same rows as from one block."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 4 + i % 10, 5)) for _ in range(12)) if i % 9 else None, f"l{i % 10}" if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, _most int")
    whole = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df).collect()}
    kept = sorted(r["doc_id"] for r in langid.keep_known(df, 0.3).collect())
    monkeypatch.setattr(langid, "MOST_LANGS", 3)
    assert len(list(langid.train(df))) == 4
    blocks = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df).collect()}
    assert {i: (lang, pytest.approx(score, abs=1e-9)) for i, (lang, score) in whole.items()} == blocks
    assert sorted(r["doc_id"] for r in langid.keep_known(df, 0.3).collect()) == kept and 0 < len(kept) < 300
    want = brute_bayes(rows)
    assert all(blocks[i] == (lang, pytest.approx(score, abs=1e-6)) for i, (lang, score) in want.items())


def test_language_edges(spark):
    rows = [(i, "the cat and the dog are here" if i % 2 else "der hund und die katze sind da", "en" if i % 2 else "de", "x") for i in range(60)]
    odd = [(100, None, "en", "x"), (101, "", "de", "x"), (102, "123 !?", None, "x"), (None, "the dog", "en", "x"), (103, "the cat and " * 100_000, None, "x"), (1, "the cat and the dog are here", "en", "x")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string")
    got = langid.identify(df).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    for i in (100, 101, 102):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[103]["lang_pred"] == "en" and by[None]["lang_pred"] == "en" and by[None]["held_out"]
    assert langid.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.drop("lang").withColumn("lang", df["text"].substr(1, 0).cast("string")).filter("false")).collect()} == set()
    kept = langid.keep_known(df)
    assert kept.columns == df.columns and kept.filter("doc_id in (100, 101, 102)").count() == 0 and kept.count() == len(rows) + 3


def test_long_texts_score_as_their_slices(monkeypatch):
    import numpy as np

    text = "abc déf ghi " * 500
    logs = np.log(np.random.default_rng(0).dirichlet(np.ones(langid.BUCKETS), 3).T)
    whole = langid._summed([text, "x"], logs)
    monkeypatch.setattr(langid, "SLICE", 701)
    assert np.allclose(langid._summed([text, "x"], logs), whole)


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.op3_quality(spark, MEDIUM).collect()
    assert len(rows) == docs.count() and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    out = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good, bad = [s for s, q in out if q], [s for s, q in out if not q]
    assert sum(g > b or (g == b) / 2 for g in good for b in bad) >= 0.95 * len(good) * len(bad)


def brute_statistics(text):
    """The statistics, each by its own plain loop."""
    text = text or ""
    words, lines = text.split(), text.split("\n")
    if not words:
        return [0.0] * quality.STATS
    n, nw = len(text), len(words)
    mean = sum(map(len, words)) / nw
    kinds = Counter()
    for c in text:
        x = ord(c)
        if x >= 128 or c.isalpha():
            kinds["letter"] += 1
        elif c in "\t\n\x0b\x0c\r ":
            kinds["space"] += 1
        elif c.isdigit():
            kinds["digit"] += 1
        elif c in quality._SYMBOLS:
            kinds["symbol"] += 1
        else:
            kinds["other"] += 1
    upper = sum(c != d for c, d in zip(text, text.lower(), strict=True)) if len(text.lower()) == n else sum(map(str.isupper, text))
    counts, chars = Counter(words), Counter(ord(c) & 1023 for c in text)
    doubled = sum(text.count(2 * c) for c in "!?$*#")
    return [
        math.log1p(n), math.log1p(nw), mean, math.log1p(math.sqrt(sum((len(w) - mean) ** 2 for w in words) / nw)),
        kinds["space"] / n, kinds["digit"] / n, kinds["letter"] / n, kinds["symbol"] / n, kinds["other"] / n, upper / max(1, kinds["letter"]),
        len(counts) / nw, len(counts) / math.sqrt(nw), max(counts.values()) / nw, sum(words[i] == words[i + 1] for i in range(nw - 1)) / max(1, nw - 1),
        len(set(lines)) / len(lines), math.log1p(nw / len(lines)), sum(w[-1] in ".?!" for w in words) / nw,
        -sum(k / n * math.log2(k / n) for k in chars.values()) + min(1.0, doubled / nw),
    ]


def brute_isotonic(value, weight):
    """max over starts of min over ends of the mean, for each place."""
    n = len(value)
    mean = lambda a, b: sum(v * w for v, w in zip(value[a:b], weight[a:b], strict=True)) / sum(weight[a:b])
    return [max(min(mean(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]


def brute_quality(docs, labels):
    """One matrix of all labelled documents, one solve, one plain isotonic fit."""
    given: dict = {}
    for doc_id, label in labels:
        if label is not None and not held(doc_id):
            given.setdefault(doc_id, []).append(label)
    stats = {i: np.array(brute_statistics(t)) for i, t in docs}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in stats}
    label = {i: sum(x) / len(x) for i, x in given.items() if i in stats}
    fit, cal = ([i for i in label if (fold[i] == 4) == last] for last in (False, True))
    x = np.array([stats[i] for i in fit])
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    random = np.random.default_rng(quality.SEED)
    directions = random.normal(size=(quality.STATS, quality.FEATURES)) / math.sqrt(quality.STATS)
    phases = random.uniform(0, 2 * math.pi, quality.FEATURES)
    features = lambda i: np.append(np.cos(np.clip((stats[i] - mean) / spread, -6, 6) @ directions + phases) * math.sqrt(2 / quality.FEATURES), 1.0)
    z = np.array([features(i) for i in fit])
    weights = np.linalg.lstsq(np.vstack([z, np.eye(z.shape[1])]), np.append([label[i] for i in fit], np.zeros(z.shape[1])), rcond=None)[0]
    raw = {i: float(features(i) @ weights) for i in stats}
    cells: dict = {}
    for i in cal:
        cells.setdefault(min(quality.CELLS - 1, max(0, int((raw[i] + 0.5) * quality.CELLS / 2))), []).append(label[i])
    at = sorted(cells)
    levels = brute_isotonic([sum(cells[c]) / len(cells[c]) for c in at], [len(cells[c]) for c in at])
    return {i: float(np.interp(r, [(c + 0.5) * 2 / quality.CELLS - 0.5 for c in at], levels)) for i, r in raw.items()}


def test_statistics_as_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("text").collect()]
    for text in [*texts, None, "", " ", "İ", "A", "!!??", "a a a\n\na a", "é\u2028x 1.5% #tag"]:
        assert quality.statistics(text) == pytest.approx(brute_statistics(text), abs=1e-9)


def test_quality_as_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "quality").collect()]
    want = brute_quality(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.op3_quality(spark, MEDIUM).collect()}
    assert got.keys() == want.keys()
    # a raw score next to the edge of a cell may be counted on its other side
    assert sum(abs(got[i] - want[i]) < 1e-6 for i in got) >= 0.98 * len(got)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "word " * 50_000, 1.0), (3, "again", 1.0), (None, "x", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1), (3, 1)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        rows = quality.score(docs, some).collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(docs.limit(0), labels).count() == 0
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 5


@pytest.mark.parametrize("values, fit", [([1, 2, 3], [1, 2, 3]), ([3, 1, 2], [2, 2, 2]), ([1, 3, 2, 4], [1, 2.5, 2.5, 4])])
def test_isotonic(values, fit):
    assert list(quality.isotonic(values, [1.0] * len(values))) == fit
