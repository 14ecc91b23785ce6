"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts (language, bucket) are summed by Spark over a bounded sample; the matrix of
log probabilities is broadcast; documents are scored in numpy as sparse bucket indices.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, fold, held_out, map_arrow, table, written

ORDERS = 3
BUCKETS = 1 << 16
#: Languages of one block of the model: a broadcast matrix holds 8 bytes for each bucket and language, 128 MB at most.
MOST_LANGS = 256
#: Documents of a language that are learned from, in expectation (chosen by a hash of the id).
TRAIN_PER_LANG = 2000
SMOOTHING = 0.5
UNKNOWN = "und"
#: Code points that are scored at once.
SLICE = 1 << 19
_LIKELY_LETTER = re.compile(r"[^\W\d_]")
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def has_letter(text: str) -> bool:
    found = _LIKELY_LETTER.search(text)
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text)))


def _points(text: str) -> np.ndarray:
    """Lower-cased code points with two zeros at both ends, so that no n-gram spans two texts."""
    return np.frombuffer(("\0\0" + text.lower() + "\0\0").encode("utf-32-le", "surrogatepass"), np.uint32)


def _ngrams(points: np.ndarray):
    """Bucket of every n-gram of each order, by its first code point."""
    mixed = np.zeros(len(points), np.uint32)
    for order in range(ORDERS):
        if len(points) <= order:
            return
        mixed = mixed[: len(points) - order] + points[order:] * _ODD[order]
        turned = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        yield ((turned >> np.uint32(7)) & np.uint32(BUCKETS - 1)).astype(np.intp)


def _slices(texts: list[str]):
    """Runs of texts of about SLICE code points: (first text, points, start of each)."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        run.append(_points(text))
        size += len(run[-1])
        if size >= SLICE or i == len(texts) - 1:
            starts = np.cumsum([0, *map(len, run[:-1])])
            yield first, np.concatenate(run), starts
            first, run, size = i + 1, [], 0


def _summed(texts: list[str], logs: np.ndarray) -> np.ndarray:
    """Log likelihood of every text under every language, long texts slice by slice."""
    out = np.zeros((len(texts), logs.shape[1]))
    for first, points, starts in _slices(texts):
        here = out[first : first + len(starts)]
        if len(starts) == 1:
            for at in range(0, len(points), SLICE):
                part = points[at : at + SLICE + ORDERS - 1]
                for h in _ngrams(part):
                    here[0] += logs[h[:SLICE]].sum(axis=0)
            continue
        ends = np.append(starts[1:], len(points))
        for order, h in enumerate(_ngrams(points)):
            values = logs[h]
            for j in range(1, order + 1):  # n-grams that begin in one text and end in the next
                values[(ends - j)[ends - j < len(h)]] = 0
            here += np.add.reduceat(values, np.minimum(starts, len(h) - 1), axis=0)
    return out


def _count(batches):
    for batch in batches:
        by_lang: dict[str, np.ndarray] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = by_lang.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for h in _ngrams(_points(text)):
                counts += np.bincount(h, minlength=BUCKETS)
        for lang, counts in by_lang.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())],
                ["lang", "bucket", "n"],
            )


Model = tuple[list[str], np.ndarray, np.ndarray]


def train(documents: DataFrame, per_lang: int = TRAIN_PER_LANG) -> Iterator[Model]:
    """Blocks of (languages, log priors, log probabilities [bucket, language]) from documents outside fold 0.

    Only text and lang are used. ``per_lang`` bounds the expected number of documents of each
    language; which ones is decided by a hash of the id. Rows without text or lang are not used. Languages come in the order of
    their names, MOST_LANGS to a block; what reaches the driver for one is a count for each (language, bucket) at most. A language's
    probabilities do not depend on others, so blocks are learned one after the other. Without any language there is no block.
    """
    rows = documents.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    by_lang = rows.groupBy("lang").agg(F.count("*").alias("n"))
    known = {r["lang"]: r["n"] for r in by_lang.orderBy("lang").limit(MOST_LANGS + 1).collect()}
    if len(known) <= MOST_LANGS:
        if known:
            yield _block(rows, known, sum(known.values()), per_lang)
        return
    by_lang = written(by_lang, "langs")
    total, last = by_lang.agg(F.sum("n")).first()[0], None
    while True:
        after = by_lang if last is None else by_lang.filter(F.col("lang") > last)
        known = {r["lang"]: r["n"] for r in after.orderBy("lang").limit(MOST_LANGS).collect()}
        if not known:
            return
        last = max(known, key=lambda lang: lang.encode("utf-8"))  # as Spark orders
        yield _block(rows.filter(F.col("lang").isin(list(known))), known, total, per_lang)


def _block(rows: DataFrame, known: dict[str, int], total: int, per_lang: int) -> Model:
    """The model of the languages ``known`` with their numbers of documents, of ``total`` in all."""
    langs, grain = sorted(known), 1 << 20
    limit = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(grain, -(-per_lang * grain // known[lang])))])
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(grain)) < limit[F.col("lang")])
    counts = (
        map_arrow(sample.select("text", "lang"), _count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    matrix = np.full((BUCKETS, len(langs)), SMOOTHING)
    column = counts["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy(dtype=np.int64)
    matrix[counts["bucket"].to_numpy(dtype=np.int64), column] += counts["n"].to_numpy(dtype=np.float64)
    share = np.array([known[lang] for lang in langs], float)
    return langs, np.log(share / total), np.log(matrix / matrix.sum(axis=0))


def likeliest(texts: list[str | None], model: Model) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Of each text the likeliest language, its log likelihood with the prior, and by how much all languages of the model together
    exceed it; None where there is no letter."""
    langs, prior, logs = model
    at = np.array([i for i, t in enumerate(texts) if t is not None and has_letter(t)], np.int64)
    names: list[str | None] = [None] * len(texts)
    most, rest = np.full(len(texts), -np.inf), np.zeros(len(texts))
    if len(at):
        total = _summed([texts[i] for i in at], logs) + prior
        best = total.argmax(axis=1)
        most[at] = total.max(axis=1)
        rest[at] = np.log(np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1))
        for i, b in zip(at, best, strict=True):
            names[i] = langs[b]
    return names, most, rest


def _scored(documents: DataFrame, columns: list[str], pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``columns`` of ``documents`` (text among them), and as ``pred`` and ``score`` the language of every row and its probability.

    With more blocks of languages than one, the rows go through them one after the other, are written in between, and one block's matrix is
    broadcast at a time.
    """
    spark = documents.sparkSession
    lang, most, every = (f"_{uuid.uuid4().hex}" for _ in range(3))  # no column of the documents
    rows = documents.select(*columns, F.lit(None).cast("string").alias(lang), F.lit(float("-inf")).alias(most), F.lit(float("-inf")).alias(every))
    at, last = columns.index("text"), len(columns)
    before = sent = None
    for model in train(documents):
        if sent is not None:  # the rows so far still need it: they are written before the next block is sent
            stored = written(rows, "langid")
            sent.destroy()
            if before is not None:
                dropped(before)
            rows = before = stored
        sent = spark.sparkContext.broadcast(model)

        def step(batches, sent=sent):
            for batch in batches:
                names, most, rest = likeliest(batch.column(at).to_pylist(), sent.value)
                old = batch.column(last + 1).to_numpy(zero_copy_only=False)
                better = most > old
                known = [n if b else k for n, b, k in zip(names, better, batch.column(last).to_pylist(), strict=True)]
                every = np.logaddexp(batch.column(last + 2).to_numpy(zero_copy_only=False), most + rest)
                added = [pa.array(known, pa.string()), pa.array(np.maximum(most, old)), pa.array(every)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(last)), *added], names=batch.schema.names)

        rows = map_arrow(rows, step, rows.schema)
    probability = F.when(F.col(lang).isNull(), 0.0).otherwise(F.exp(F.col(most) - F.col(every)))
    return rows.select(*columns, F.coalesce(lang, F.lit(UNKNOWN)).alias(pred), probability.alias(score))


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``documents``; other columns are ignored.

    Null texts, empty ones and texts without a letter give ``und`` with score 0; so does every
    text where nothing can be learned. Whole texts are scored, long ones slice by slice.
    Repeated rows are each scored; ties between languages go to the first by name. Any number of languages may be told apart.
    """
    rows = documents.select("doc_id", "text", "lang")
    found = _scored(rows, ["doc_id", "text"])
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "lang_pred", "score")


def keep_known(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose language is recognised with a probability of at least ``least``.

    Null texts, empty ones, and texts without a letter go; so do all rows where nothing can be learned. Repeated rows stay or go
    together; a null doc_id plays no part.
    """
    pred, score = (f"_{uuid.uuid4().hex}" for _ in range(2))
    found = _scored(documents, documents.columns, pred, score)
    return found.filter((F.col(pred) != UNKNOWN) & (F.col(score) >= least)).drop(pred, score)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
