"""Exact top-k inner-product search by term-at-a-time accumulation.

Every dimension of a vector is a term. A block of query rows is broadcast as sparse
(term, query, weight) rows; each task turns its candidates into one posting list per term
and scatters weight * posting into dense score arrays, selects the k best of the
partition for every query, and the partial lists are merged by one small shuffle. A broadcast holds
several blocks, which a task searches in one pass over its candidates. Where there are more queries, one broadcast is
searched after the other: its partial lists are written and it is destroyed before the next one is sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, table, written

#: Queries and candidates of one dense score array; blocks of queries of one broadcast at most, and its bytes if it has more than one.
QUERY_BLOCK = 1024
CANDIDATES = 4096
BLOCKS_A_PASS, PASS_BYTES = 16, 16 << 20
#: Scores are exact in a double while |weights| * |values| * terms stays below this.
EXACT = 2**53


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, q array<long>) of usable vectors: floor(scale * component as double).

    Vectors (or ids) that are null, or hold a null, NaN or infinite component, are left out. Components beyond 64 bits
    after scaling take the largest or smallest 64-bit integer; an empty vector scores 0 with all others.
    """
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))),
    )
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return vectors.filter(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of any length as one integer matrix, missing terms as 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), int(sizes[0]))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes]).astype(np.int64)] = flat
    return out


def _select(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best scores of each row; the columns ascend by id, so ties go to the left."""
    n = scores.shape[1]
    if n <= k:
        rows = np.repeat(np.arange(len(scores)), n)
        return rows, np.tile(np.arange(n), len(scores))
    least = np.partition(scores, n - k, axis=1)[:, n - k : n - k + 1]
    above, equal = scores > least, scores == least
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= room)))


def _accumulate(ids: np.ndarray, values: np.ndarray, qids: np.ndarray, terms: list, top: int, kind) -> tuple:
    """Scores of one candidate block against the query block, term by term."""
    scores = np.zeros((len(qids), len(ids)), kind)
    for term, (queries, weights) in enumerate(terms[: values.shape[1]]):
        posting = np.flatnonzero(values[:, term])
        if not len(posting) or not len(queries):
            continue
        weighted = np.multiply.outer(weights.astype(kind), values[posting, term].astype(kind))
        if len(posting) == len(ids) and len(queries) == len(qids):
            scores += weighted
        else:
            scores[np.ix_(queries, posting)] += weighted
    rows, cols = _select(scores, top)
    return rows, ids[cols], scores[rows, cols]


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple:
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.searchsorted(query, query, side="left")
    keep = np.arange(len(query)) - first < k
    return query[keep], vec[keep], score[keep]


def _searcher(sent, k: int, block: int):
    every, q = sent.value["ids"], sent.value["q"]
    parts = []
    for at in range(0, len(every), block):
        weights = q[at : at + block]
        parts.append((every[at : at + block], [(np.flatnonzero(weights[:, t]), weights[np.flatnonzero(weights[:, t]), t]) for t in range(q.shape[1])]))
    most = int(np.abs(q).max(initial=0)) * max(1, q.shape[1])

    def search(batches):
        best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)) for _ in parts]
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = _matrix(batch.column(1))
            order = np.argsort(ids, kind="stable")
            ids, values = ids[order], values[order]
            kind = np.float64 if most * int(np.abs(values).max(initial=0)) < EXACT else np.int64
            for at in range(0, len(ids), CANDIDATES):
                part, rows = ids[at : at + CANDIDATES], values[at : at + CANDIDATES]
                for i, (qids, terms) in enumerate(parts):
                    # rows that bear the query's own id are removed after selection: room for them is added
                    own = np.isin(part, qids)
                    room = int(np.bincount(np.searchsorted(qids, part[own])).max(initial=0)) if own.any() else 0
                    r, vec, score = _accumulate(part, rows, qids, terms, k + room, kind)
                    other = vec != qids[r]
                    best[i] = _best(
                        np.concatenate([best[i][0], qids[r[other]]]),
                        np.concatenate([best[i][1], vec[other]]),
                        np.concatenate([best[i][2], score[other].astype(np.int64)]),
                        k,
                    )
        for found in best:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])

    return search


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` highest integer inner products of every query with all candidates but itself.

    ``queries`` and ``candidates`` are (vec_id, q) of ``quantised``. Returns query_id, rank,
    vec_id, score; ties go to the smaller vec_id. A query with fewer candidates gets all of
    them, one without any gets no row. Vectors of unequal length are padded with zeros.
    Repeated candidate rows each count; every row with the query's id is its own; of queries
    that repeat an id the smallest vector counts. Products and their sums must fit 64 bits. The query set is taken in
    blocks of at most ``block`` rows, BLOCKS_A_PASS of them at a time or as many as PASS_BYTES hold, so what is broadcast and what the driver holds have a fixed bound; where that
    is not all of it, the candidates are written once, so that they are not quantised again for each pass.
    """
    spark = candidates.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("q").alias("q"))
    longest = queries.agg(F.max(F.size("q"))).first()[0] or 0
    most = max(1, min(BLOCKS_A_PASS, PASS_BYTES // max(1, 8 * block * longest)))
    every, parts = blocks(queries, "vec_id", block * most), []
    if len(every) > 1:
        candidates = written(candidates.select("vec_id", "q"), "quantised")
    for one in every:
        rows = sorted(one.collect())
        if not rows:
            continue
        width = max(len(r[1]) for r in rows)
        q = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            q[i, : len(r[1])] = r[1]
        sent = spark.sparkContext.broadcast({"ids": np.array([r[0] for r in rows], np.int64), "q": q})
        found = candidates.mapInArrow(_searcher(sent, k, block), "query_id long, vec_id long, score long")
        if len(every) > 1:
            found = written(found, "top")
            sent.destroy()
        parts.append(found)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0] if len(parts) == 1 else spark.read.schema(parts[0].schema).parquet(*[p._written_at for p in parts])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(w).cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.filter(F.col("vec_id") % 100 == 0), vectors)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
