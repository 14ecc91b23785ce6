"""Query strings, snippets and the growing index, against the full-text engine of the standard library."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import fulltext, search

POOL = ["run", "running", "the", "fox", "Café", "jumps", "over", "lazy", "text", "texts", "lax", "jumper", "naïve"]


def collection(n=60, seed=3, longest=40):
    rng = random.Random(seed)
    ends = [" ", " ", " ", ", ", ". ", ": ", "\n"]
    return [(f"{i:03}", rng.choice(["text", "user_text", "note"]), "".join(rng.choice(POOL) + rng.choice(ends) for _ in range(rng.randint(0, longest)))) for i in range(n)]


def engine(docs):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(hash UNINDEXED, kind, content, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", docs)
    return con


def expression(rng, depth=0):
    """A random query string."""
    if depth < 3 and rng.random() < 0.55:
        left, right = expression(rng, depth + 1), expression(rng, depth + 1)
        if rng.random() < 0.25:
            column = rng.choice(["kind", "content", "{kind content}", "-kind"])
            left = f"{column} : ({left})"
        if rng.random() < 0.5:
            right = f"({right})"
        return f"{left} {rng.choice(['AND', 'OR', 'NOT'])} {right}"
    parts = []
    for _ in range(rng.choice([1, 1, 2])):
        words = [rng.choice(POOL) for _ in range(rng.choice([1, 1, 2]))]
        part = f'"{" ".join(words)}"' if len(words) > 1 or rng.random() < 0.2 else words[0]
        part += rng.choice(["", "", "", "*", " + fox"])
        part = rng.choice(["", "", "", "^"]) + part
        parts.append(rng.choice(["", "", "", "content:", "kind : "]) + part)
    return " ".join(parts)


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    docs, path = collection(50, 5, 150), str(tmp_path_factory.mktemp("stored"))
    blobs = spark.createDataFrame(docs, "hash string, kind string, content string").persist()
    fulltext.add(blobs, path)
    return docs, blobs, fulltext.read(spark, path)


ODD = ['"" run', 'run AND ""', 'run NOT ""', '"" NOT run', "foo_bar", 'say "a ""quoted"" run"', "hash:run OR fox", "AND_ OR or", "running*"]


def test_queries_as_the_full_text_engine(spark, one_partition):
    """The same blobs; and the same ranks, but where an OR holds phrases of more than a word or a column: of such a branch the engine counts words
    also in blobs that hold all words of the branch but not its phrase."""
    docs = collection()
    con, rng = engine(docs), random.Random(7)
    index = fulltext.of_blobs(spark.createDataFrame(docs, "hash string, kind string, content string").coalesce(1))
    index = fulltext.Index(index.postings.coalesce(1).persist(), index.lengths.persist(), index.totals.persist(), True)
    queries = [expression(rng) for _ in range(24)] + ODD
    ranked = found = 0
    for q in queries:
        want = dict(con.execute("SELECT hash, bm25(t) FROM t WHERE t MATCH ?", (q,)))
        got = {r["hash"]: r["rank"] for r in fulltext.find(index, q).select("hash", "rank").collect()}
        assert got.keys() == want.keys(), q
        found += bool(want)
        if "OR" not in q.split() or not set(q) & set('":^+'):
            ranked += bool(want)
            assert all(abs(got[h] - want[h]) < 1e-9 for h in want), q
    assert found > 12 and ranked > 5


@pytest.mark.parametrize("query", ['"unclosed', "(a", "a)", "a AND", "OR a", "NOT a", "a (b)", "nowhere: a", "*", "a $ b", "{kind content} a", "a + ", "-kind a", "^", ":a", "a NEAR(b c)", "()"])
def test_what_is_no_query(query):
    with pytest.raises(fulltext.QueryError):
        fulltext.parse(query)


def test_empty_query(spark):
    index = fulltext.of_blobs(spark.createDataFrame(collection(3), "hash string, kind string, content string"))
    assert [fulltext.find(index, q).count() for q in ("", "  ", '""', '"!?"')] == [0, 0, 0, 0]


@pytest.mark.parametrize("query, words", [("run", 64), ("lazy fox", 12), ('"over the" OR jumper', 64), ("texts AND naïve", 3), ('"run the fox" OR "the fox" OR lax*', 12), ("content: (cafe OR fox) NOT kind:note", 64)])
def test_snippets_as_the_full_text_engine(spark, one_partition, stored, query, words):
    docs, blobs, index = stored
    want = dict(engine(docs).execute("SELECT hash, snippet(t, 2, '<mark>', '</mark>', '...', ?) FROM t WHERE t MATCH ?", (words, query)))
    rows = fulltext.page(fulltext.find(index, query), blobs, limit=100, words=words).collect()
    assert {r["hash"]: r["snippet"] for r in rows} == want and len(want) > 3


def test_pages(spark):
    docs = [(f"{i}", "text", f"searchable item number {i} with common term") for i in range(5)]
    blobs = spark.createDataFrame(docs, "hash string, kind string, content string")
    found = fulltext.find(fulltext.of_blobs(blobs), "searchable")
    assert [len(fulltext.page(found, blobs, 2, at).collect()) for at in (0, 2, 4)] == [2, 2, 1]


def test_index_grows_by_segments(spark, tmp_path):
    docs = collection(40)
    blobs = spark.createDataFrame(docs, "hash string, kind string, content string")
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    fulltext.add(blobs, one)
    fulltext.add(blobs.filter("hash < '025'"), two)
    fulltext.add(blobs.filter("hash >= '010'").unionByName(blobs.filter("hash >= '030'")), two)
    fulltext.add(blobs, two)  # nothing is absent any more

    def rows(path):
        index = fulltext.read(spark, path)
        return [sorted(map(tuple, df.collect())) for df in (index.postings, index.lengths, index.totals)], sorted(map(tuple, fulltext.find(index, "(run OR lax*) NOT kind:note").select("hash", "rank").collect()))

    want = rows(one)
    assert rows(two) == want and len(want[0][1]) == 40
    spark.read.parquet(f"{two}/postings").limit(5).select("hash", "column", "position", "term").write.parquet(f"{two}/postings/segment=cut-off")
    assert rows(two) == want  # a segment without totals does not count
    fulltext.merge(spark, two)
    assert rows(two) == want and len(fulltext._segments(spark, two)[0]) == 1
    with pytest.raises(ValueError):
        fulltext.add(blobs, two, stem=False)


def test_search_reads_the_row_groups_of_its_terms(spark, tmp_path):
    blobs = spark.range(4000).select(F.col("id").cast("string").alias("hash"), F.lit("text").alias("kind"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(5000)).cast("string")) for k in range(30)]).alias("content"))
    path = str(tmp_path / "index")
    fulltext.add(blobs, path, stem=False)
    index = fulltext.read(spark, path)
    found = fulltext.find(index, "w77 OR w123*")
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(In(term, [w77])" in plan.replace("EqualTo(term,w77)", "In(term, [w77])") and "StringStartsWith(term,w123)" in plan
    found.collect()
    read = []

    def walk(node):
        if node.nodeName().startswith("Scan parquet") and "postings" in str(node.relation().location().rootPaths()):
            read.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))
        if "AdaptiveSparkPlan" in node.nodeName():
            walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            walk(node.plan())

    walk(found._jdf.queryExecution().executedPlan())
    assert read and max(read) < 4000 * 31 / 2  # of all postings


@pytest.mark.parametrize("stem", [True, False])
def test_index_moves_texts_not_words(spark, tmp_path, stem):
    """Words and hashes are many times the size of the texts: no shuffle deals rows by word, and a hash stands in one file only."""
    blobs = spark.createDataFrame(collection(300), "hash string, kind string, content string").repartition(7)
    assert not [x for x in search.postings(blobs, stem)._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x and ("word" in x or "term" in x)]
    path = str(tmp_path / "index")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(fulltext, "PART_BYTES", 4096)
        fulltext.add(blobs, path, stem)
    index = fulltext.read(spark, path)
    files = index.postings.select("hash", F.input_file_name().alias("file")).distinct()
    assert files.select("file").distinct().count() > 3 and files.count() == files.select("hash").distinct().count()
    want = fulltext.of_blobs(blobs, stem)
    assert sorted(map(tuple, index.postings.collect())) == sorted(map(tuple, want.postings.collect()))


def test_search_deals_places_once(spark, stored):
    """All phrases of all blobs are counted where their places were dealt to by hash; no second shuffle of them by phrase and start."""
    _, _, index = stored
    found = fulltext.find(index, 'content : (run OR "the fox") AND te* NOT kind:note')
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "ReusedExchange" not in x]
    assert dealt and not [x for x in dealt if "phrase" in x.split("]")[0] or "start" in x.split("]")[0]]
    assert len([x for x in dealt if "hashpartitioning(hash" in x]) <= 2  # the places, and the lengths they are joined with


def test_search_reads_and_deals_places_once(spark, stored):
    """What is counted over all blobs, for the idf, takes the places that were dealt for the blobs: no second scan of the postings."""
    _, _, index = stored
    found = fulltext.find(index, '"the fox" OR run OR lax*')
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    assert len([x for x in final if "Exchange hashpartitioning(hash" in x and "REPARTITION_BY_NUM" in x and "ReusedExchange" not in x]) == 1
    assert len([x for x in final if "FileScan parquet" in x and "term" in x.split("]")[0]]) == 1


def test_vocabulary_shuffles_terms_of_many_files_once(spark, tmp_path, monkeypatch):
    """A task for each file would shuffle the words that all files hold once for each of them."""
    monkeypatch.setattr(fulltext, "PART_BYTES", 1024)
    path, before = str(tmp_path / "index"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    fulltext.add(spark.createDataFrame(collection(300), "hash string, kind string, content string"), path, stem=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        index = fulltext.read(spark, path)
        want = len({r["term"] for r in index.postings.select("term").distinct().collect()})
        found = fulltext.vocabulary(index)
        files, got = len(index.postings.inputFiles()), found.collect()[0]["terms"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    written = []

    def walk(node):
        if node.nodeName().startswith("Exchange"):
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))
        if "AdaptiveSparkPlan" in node.nodeName():
            walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            walk(node.plan())

    walk(found._jdf.queryExecution().executedPlan())
    assert got == want and files > 24 and 0 < max(written) <= 12 * want, (got, files, written)
