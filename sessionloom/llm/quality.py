"""Quality classifier: random Fourier features, ridge normal equations, isotonic calibration.

Statistics of the whole text are standardised and mapped to random Fourier features, which
approximate a Gaussian kernel. Each partition sums its part of the normal equations; their
solution scores documents, and an isotonic fit on other training folds turns raw scores into
probabilities of label 1.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, held_out, map_arrow, table, written

THRESHOLD = 0.3
#: Labelled documents that are learned from, in expectation (chosen by a hash of the id).
TRAIN_ROWS = 40_000
#: Partitions of the training rows: each sends one matrix of (FEATURES + 1)^2 to the driver.
TRAIN_PARTS = 12
FEATURES = 256
RIDGE = 1.0
#: Cells of the raw score in which calibration counts labels.
CELLS = 2048
SEED = 20240607
_ENDS, _SYMBOLS = frozenset(".?!"), "#$%&*|@^~_=+<>{}[]\\/"
_CLASS = np.zeros(128, np.uint8)  # 1 white space, 2 digit, 3 letter, 4 symbol, 5 other punctuation
_CLASS[:] = 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 3
_CLASS[[ord(c) for c in _SYMBOLS]] = 4
STATS = 18


def statistics(text: str | None) -> list[float]:
    """STATS numbers of a whole text; null counts as empty."""
    text = text or ""
    words, lines = text.split(), text.split("\n")
    n, nw, nl = len(text), len(words), len(lines)
    if not nw:
        return [0.0] * STATS
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = np.bincount(np.where(points < 128, _CLASS[np.minimum(points, 127)], 3), minlength=6)
    low = text.lower()
    upper = int((np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32) != points).sum()) if len(low) == n else sum(map(str.isupper, text))
    lengths = np.fromiter(map(len, words), float, nw)
    counts = Counter(words)
    top = counts.most_common(1)[0][1]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ends = sum(w[-1] in _ENDS for w in words)
    chars = np.bincount(points & 1023)
    share = chars[chars > 0] / n
    doubled = text.count("!!") + text.count("??") + text.count("$$") + text.count("**") + text.count("##")
    return [
        math.log1p(n),
        math.log1p(nw),
        float(lengths.mean()),
        math.log1p(float(lengths.std())),
        classes[1] / n,
        classes[2] / n,
        classes[3] / n,
        classes[4] / n,
        classes[5] / n,
        upper / max(1, int(classes[3])),
        len(counts) / nw,
        len(counts) / math.sqrt(nw),
        top / nw,
        same / max(1, nw - 1),
        len(set(lines)) / nl,
        math.log1p(nw / nl),
        ends / nw,
        float(-(share * np.log2(share)).sum()) + min(1.0, doubled / nw),
    ]


class Model:
    """Standardisation, random Fourier features, ridge weights and calibration; plain numpy, so it can be broadcast."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        random = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.directions = random.normal(size=(STATS, FEATURES)) / math.sqrt(STATS)
        self.phases = random.uniform(0, 2 * math.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.steps, self.levels = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.directions + self.phases) * math.sqrt(2 / FEATURES)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.steps, self.levels)


def _stats_of(batches):
    for batch in batches:
        stats = [statistics(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "fold", "stats"])


def _stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), STATS)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of ``value`` by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools[-1]
            pools[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(n, v) for v, _, n in pools])


def train(documents: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """A model of ``labels.quality`` from the statistics of documents outside fold 0.

    ``most`` bounds the expected number of labelled documents. Null labels are not used; a
    document with several labels has their mean. Folds 1 to 3 fit the weights and fold 4 the
    calibration. Without any label every score is 0.5. Each of TRAIN_PARTS partitions sends its
    sums to the driver, calibration a count for each of CELLS cells.
    """
    known = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.avg(F.col("quality").cast("double")).alias("label"))
        .filter(~held_out())
    )
    n, grain = known.count(), 1 << 20
    few = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(grain)) < min(grain, -(-most * grain // max(1, n)))
    rows = documents.filter(~held_out() & few).select(F.col("doc_id").cast("long").alias("doc_id"), fold().alias("fold"), "text")
    stats = map_arrow(rows, _stats_of, "doc_id long, fold int, stats array<double>")
    known = known.filter(few).select(F.col("doc_id").cast("long").alias("doc_id"), "label")
    sample = written(stats.join(known, "doc_id").select("fold", "stats", "label").repartition(TRAIN_PARTS), "quality")
    each = [F.col("stats")[i] for i in range(STATS)]
    row = sample.filter("fold < 4").agg(*[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    if row[0] is None:
        return Model(np.zeros(STATS), np.ones(STATS))
    spread = np.array(row[STATS:])
    model = Model(np.array(row[:STATS]), np.where(spread > 1e-9, spread, 1.0))

    def normal(batches):
        left, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            z = model.features(_stacked(batch.column(0)))
            left += z.T @ z
            right += z.T @ batch.column(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([left.ravel()]), pa.array([right])], ["l", "r"])

    sums = map_arrow(sample.filter("fold < 4").select("stats", "label"), normal, "l array<double>, r array<double>").collect()
    left = sum(np.array(s[0]) for s in sums).reshape(FEATURES + 1, FEATURES + 1)
    model.weights = np.linalg.solve(left + RIDGE * np.eye(FEATURES + 1), sum(np.array(s[1]) for s in sums))

    def cells(batches):
        count, total = np.zeros(CELLS), np.zeros(CELLS)
        for batch in batches:
            raw = model.raw(_stacked(batch.column(0)))
            at = np.clip((raw + 0.5) * CELLS / 2, 0, CELLS - 1).astype(int)
            count += np.bincount(at, minlength=CELLS)
            total += np.bincount(at, weights=batch.column(1).to_numpy(zero_copy_only=False), minlength=CELLS)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at]), pa.array(total[at])], ["cell", "n", "total"])

    for folds in ("fold = 4", "fold < 4"):  # the fitted folds only where fold 4 has no label
        held = map_arrow(sample.filter(folds).select("stats", "label"), cells, "cell long, n double, total double")
        found = sorted(held.groupBy("cell").agg(F.sum("n"), F.sum("total")).collect())
        if found:
            break
    cell, count, total = (np.array(c, float) for c in zip(*found, strict=True))
    model.steps, model.levels = (cell + 0.5) * 2 / CELLS - 0.5, np.clip(isotonic(total / count, count), 0, 1)
    return model


def score(documents: DataFrame, labels: DataFrame, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``documents``; other columns are ignored.

    Null and empty texts have the statistics 0 and are scored like any other. Repeated rows are
    each scored. A score is a calibrated probability of label 1; it uses nothing but the text.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model or train(documents, labels))

    def run(batches):
        for batch in batches:
            found = sent.value.score(np.array([statistics(t) for t in batch.column(2).to_pylist()]).reshape(-1, STATS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all columns, whose score is at least ``threshold``.

    Null and empty texts are scored as empty and may stay. Repeated rows stay or go together; without any label all scores
    are 0.5. A null doc_id plays no part.
    """
    sent = documents.sparkSession.sparkContext.broadcast(train(documents, labels))
    at = documents.columns.index("text")

    def chosen(batches):
        for batch in batches:
            found = sent.value.score(np.array([statistics(t) for t in batch.column(at).to_pylist()]).reshape(-1, STATS))
            yield batch.filter(pa.array(found >= threshold))

    return map_arrow(documents, chosen, documents.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
