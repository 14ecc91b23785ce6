"""Outcomes of sessions: learned from those that users set, or told by a model backend; both become the same stored rows.

The learned classifier is multinomial naive Bayes over hashed words. A word falls into one of BUCKETS buckets, so a model has the
same size however large the corpus is: it is broadcast, and scoring shuffles one row of sums for each session. Weights are whole
millionths, so sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from . import backends, enrich, store
from .warehouse import Warehouse

# The outcomes of a session, and the reasons of those that are no success.
OUTCOMES = ("success", "partial", "failed", "abandoned")
REASONS = ("repro_missing", "context_drift", "tool_misuse", "dependency_trap", "unknown")
#: Buckets of words: what four hex digits of a hash tell apart.
BUCKETS = 65_536
#: The bucket that each session has once: it carries the prior.
PRIOR = -1
SCALE = 1_000_000


def buckets(text: Column, words: Callable[[Column], Column] = tokens) -> Column:
    """PRIOR and the distinct buckets of a text's words; of a null or wordless text PRIOR alone."""
    bucket = lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int")
    found = F.array_distinct(F.transform(F.array_distinct(words(F.coalesce(text, F.lit("")))), bucket))
    return F.concat(F.array(F.lit(PRIOR)), found)


def learn(digests: DataFrame, labels: DataFrame, classes: dict[str, tuple[str, ...]], words: Callable[[Column], Column] = tokens) -> DataFrame:
    """A model of the labelled digests: for each bucket a weight ``<column>_<class>`` of each class of each label column.

    ``labels`` (session_id, label columns) has one row a session; a label that is null or none of its classes teaches its column nothing. Counts
    are smoothed by one over the buckets that labelled sessions hold, so a class that nobody has used is possible but unlikely. Other buckets weigh
    nothing; without labels all classes are alike.
    """
    rows = digests.join(labels.select("session_id", *classes), "session_id").select(*classes, F.explode(buckets(F.col("digest"), words)).alias("bucket"))
    every = digests.sparkSession.range(PRIOR, BUCKETS).select(*[F.lit(None).cast("string").alias(c) for c in classes], F.col("id").cast("int").alias("bucket"))
    pairs = [(c, k) for c, kinds in classes.items() for k in kinds]
    counts = rows.unionByName(every).groupBy("bucket").agg(*[F.count_if(F.coalesce(F.col(c) == k, F.lit(False))).alias(f"{c}_{k}") for c, k in pairs])
    model = Window.partitionBy(F.lit(0))  # BUCKETS + 1 rows
    here = F.col("bucket") == PRIOR

    def weight(c: str, k: str) -> Column:
        of = [F.col(f"{c}_{other}") for other in classes[c]]
        seen = reduce(Column.__add__, of) > 0
        vocabulary = F.count_if(seen & ~here).over(model)
        mine, sessions = F.sum(F.when(~here, F.col(f"{c}_{k}"))).over(model), F.max(F.when(here, reduce(Column.__add__, of))).over(model)
        share = (F.col(f"{c}_{k}") + 1) / F.when(here, sessions + len(of)).otherwise(mine + vocabulary)
        return F.when(here | seen, F.round(F.ln(share) * SCALE)).otherwise(0).cast("long").alias(f"{c}_{k}")

    return counts.select("bucket", *[weight(c, k) for c, k in pairs])


def predict(digests: DataFrame, model: DataFrame, classes: dict[str, tuple[str, ...]], words: Callable[[Column], Column] = tokens) -> DataFrame:
    """(session_id, and for each label column its likeliest class and ``<column>_probability``); of equally likely classes the first."""
    rows = digests.select("session_id", F.explode(buckets(F.col("digest"), words)).alias("bucket"))
    sums = rows.join(F.broadcast(model), "bucket").groupBy("session_id").agg(*[F.sum(c).alias(c) for c in model.columns if c != "bucket"])  # BUCKETS + 1 rows
    out = sums
    for c, kinds in classes.items():
        scores = [F.col(f"{c}_{k}") for k in kinds]
        best = F.greatest(*scores)
        name = F.coalesce(*[F.when(s == best, F.lit(k)) for s, k in zip(scores, kinds)])
        parts = reduce(Column.__add__, [F.exp((s - best) / SCALE) for s in scores])
        out = out.withColumns({c: name, f"{c}_probability": F.round(1 / parts, 4)})
    return out.select("session_id", *[x for c in classes for x in (c, f"{c}_probability")])


CLASSES = {"outcome": OUTCOMES, "reason_code": REASONS}


def learned(digests: DataFrame, labels: DataFrame, wanted: DataFrame | None = None, least: float = 0.0, words: Callable[[Column], Column] = tokens) -> DataFrame:
    """(session_id, outcome, reason_code, probability) of the sessions that no user has labelled, or of the digests ``wanted``.

    ``labels`` (session_id, outcome, reason_code) are those of users. The reason of a failure is learned of failures only, one without a reason
    as 'unknown'; a success has none. Sessions below the probability ``least`` are left out, so they stay candidates: without any label each class has 1/4.
    """
    known = labels.filter("outcome IS NOT NULL").select("session_id", "outcome", F.when(F.col("outcome") != "success", F.coalesce("reason_code", F.lit("unknown"))).alias("reason_code"))
    wanted = digests.join(known.select("session_id"), "session_id", "left_anti") if wanted is None else wanted
    rows = predict(wanted, learn(digests, known, CLASSES, words), CLASSES, words).withColumnRenamed("outcome_probability", "probability")
    reason = F.when(F.col("outcome") != "success", F.col("reason_code"))
    return rows.filter(F.col("probability") >= least).select("session_id", "outcome", reason.alias("reason_code"), "probability")


INSTRUCTIONS = (
    "Below is the beginning of a session between a user and a coding assistant. Judge how it ended. Answer with one JSON object and nothing else: "
    f'"outcome" is one of {", ".join(OUTCOMES)}; "reason_code" is null for a success and else one of {", ".join(REASONS)}.\n\n'
)


def asked(digests: DataFrame) -> DataFrame:
    """Digests as the texts that a backend is called with."""
    return digests.withColumn("digest", F.concat(F.lit(INSTRUCTIONS), "digest"))


def told(replies: DataFrame) -> DataFrame:
    """(session_id, outcome, reason_code) of a backend's replies (session_id, reply), maybe within other text.

    Failed calls and replies without a known outcome are left out; a success has no reason, another outcome without a known one has 'unknown'.
    """
    told_json = F.from_json(enrich.json_of_reply(enrich.result_of_output(F.col("reply"))), "outcome STRING, reason_code STRING")
    rows = replies.filter("reply IS NOT NULL").withColumn("v", told_json).filter(F.col("v.outcome").isin(*OUTCOMES))
    reason = F.when(F.col("v.reason_code").isin(*REASONS), F.col("v.reason_code")).otherwise("unknown")
    return rows.select("session_id", "v.outcome", F.when(F.col("v.outcome") != "success", reason).alias("reason_code"))


def report(wanted: DataFrame, digests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: candidates (id), those skipped as they have no digest, those classified, and those that failed."""
    marks = lambda rows, name: rows.select(F.col("session_id").cast("string").alias("id"), F.lit(True).alias(name)).distinct()
    rows = wanted.select(F.col("id").cast("string").alias("id")).distinct().join(marks(digests, "asked"), "id", "left").join(marks(verdicts, "done"), "id", "left")
    return rows.agg(F.count("*").alias("total_candidates"), F.count("done").alias("classified"), F.count_if(F.col("asked").isNull()).alias("skipped"), F.count_if(F.col("asked").isNotNull() & F.col("done").isNull()).alias("failed"))


OUTCOME_ROWS = "session_id STRING, outcome STRING, reason_code STRING, is_user_labeled BOOLEAN"


def stored_outcomes(house: Warehouse) -> DataFrame:
    """Outcomes of the warehouse; those of artifacts are no user's and have no reason."""
    rows = house.table("session_outcomes")
    if rows is None:
        return house.spark.createDataFrame([], OUTCOME_ROWS)
    column = lambda name, default: F.coalesce(F.col(name), default) if name in rows.columns else default
    return rows.select("session_id", "outcome", column("reason_code", F.lit(None).cast("string")).alias("reason_code"), column("is_user_labeled", F.lit(False)).alias("is_user_labeled"))


def set_by_user(house: Warehouse, labels: DataFrame) -> None:
    """Store what users say of sessions (session_id, outcome, reason_code); it replaces any outcome and no classifier changes it."""
    rows = labels.select("session_id", "outcome", "reason_code", F.lit(True).alias("is_user_labeled"))
    house.commit({"session_outcomes": store.first_wins(rows, ["session_id"], [F.desc("outcome"), F.desc("reason_code")])})


def classify(house: Warehouse, backend: backends.Backend | None = None, model: str = "learned", limit: int | None = None, again: bool = True, force: bool = False, least: float = 0.5, **how) -> dict:
    """Classify sessions of a warehouse, latest first, store their outcomes and return the counts of ``report``.

    Candidates are sessions without an outcome, with ``again`` also those whose outcome no user has set, with ``force`` all. A ``backend``
    is called for each; without one the classifier that the users' outcomes teach decides, and what it finds less likely than ``least`` fails.
    """
    messages, sessions = house.table("messages"), house.table("sessions")
    if messages is None or sessions is None:
        return dict.fromkeys(("total_candidates", "classified", "skipped", "failed"), 0)
    known = stored_outcomes(house)
    settled = known.limit(0) if force else known.filter("is_user_labeled") if again else known
    wanted = enrich.candidates(sessions, settled.withColumn("is_user_labeled", F.lit(True)), limit)
    every = enrich.digests(messages, ["turn_index", "timestamp", "id"])
    digests = every.join(wanted.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    if backend is None:
        verdicts = learned(every, known.filter("is_user_labeled"), digests, least)
    else:
        verdicts = told(backends.call_all(asked(digests), backend, model, **how))
    rows = verdicts.select("session_id", "outcome", "reason_code", F.lit(False).alias("is_user_labeled"))
    with house.staged(rows) as done:  # a backend is called once for each session, and what is counted is what is stored
        counts = report(wanted, digests, done).first().asDict()
        house.commit({"session_outcomes": done})
    return counts
