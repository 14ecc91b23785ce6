"""Context burden: what tool outputs cost in all later messages of a session, and what-if variants.

An item at position idx of a session with n messages stays in context for the n - idx + 1 messages
from its own on; its burden is its size times that number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(messages: DataFrame, order: list[str]) -> DataFrame:
    """Adds idx (from 1), n and remaining of each message in its session; one shuffle by session."""
    by = Window.partitionBy("session_id")
    return (
        messages.withColumn("idx", F.row_number().over(by.orderBy(*order)))
        .withColumn("n", F.count("*").over(by))
        .withColumn("remaining", F.col("n") - F.col("idx") + 1)
    )


def burden(placed: DataFrame, size: Column) -> DataFrame:
    return placed.withColumn("burden", size * F.col("remaining"))


def by_group(rows: DataFrame, key: str) -> DataFrame:
    """Items, bytes, average and burden of each group, with the share of the whole burden."""
    groups = rows.groupBy(key).agg(
        F.count("*").alias("items"),
        F.sum("size").cast("long").alias("bytes"),
        F.round(F.avg("size"), 6).alias("avg_bytes"),
        F.sum("burden").cast("long").alias("burden"),
    )
    total = groups.agg(F.sum("burden").alias("all"))
    return groups.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("burden") / F.col("all"), 9)).drop("all")  # one row


def top_share(rows: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """The groups of highest burden and the cumulative share of the whole burden they hold."""
    groups = rows.groupBy(key).agg(F.sum("burden").cast("long").alias("burden"))
    total = groups.agg(F.sum("burden").alias("all"))
    top = groups.orderBy(F.desc("burden"), key).limit(limit)
    running = Window.orderBy(F.desc("burden"), key).rowsBetween(Window.unboundedPreceding, 0)  # over `limit` rows
    return top.crossJoin(F.broadcast(total)).select(key, "burden", F.round(F.sum("burden").over(running) / F.col("all"), 9).alias("cumulative_share"))


def flat_caps(rows: DataFrame, caps: list[int]) -> DataFrame:
    """Burden if every output were cut at a cap, for each cap, beside the burden as it is."""
    sums = [F.sum(F.least(F.col("size"), F.lit(c)) * F.col("remaining")).cast("long").alias(f"cap_{c}") for c in caps]
    return rows.agg(F.sum("burden").cast("long").alias("uncapped"), *sums)


def dynamic_cap(tiers: list[tuple[int, int]], last: int) -> Column:
    """The cap of the first tier (remaining below, cap) that fits, else ``last``."""
    return reduce(lambda c, t: c.when(F.col("remaining") < t[0], t[1]), tiers, F).otherwise(last)


def dynamic_caps(rows: DataFrame, tiers: list[tuple[int, int]], last: int) -> DataFrame:
    capped = F.least(F.col("size"), dynamic_cap(tiers, last)) * F.col("remaining")
    return rows.agg(F.sum("burden").cast("long").alias("uncapped"), F.sum(capped).cast("long").alias("capped"))


def session_cap(rows: DataFrame, most: int, size: Column | None = None) -> DataFrame:
    """Burden if sessions ended at message ``most``: later items go, earlier ones are carried less far."""
    size = F.col("size") if size is None else size
    kept = rows.filter(F.col("idx") <= most)
    return kept.agg(F.count("*").alias("items"), F.sum(size * (F.least(F.col("n"), F.lit(most)) - F.col("idx") + 1)).cast("long").alias("burden"))


def combined(rows: DataFrame, most: int, tiers: list[tuple[int, int]], last: int) -> DataFrame:
    """Both: a session cap, and the dynamic cap by what then remains."""
    kept = rows.filter(F.col("idx") <= most).withColumn("remaining", F.least(F.col("n"), F.lit(most)) - F.col("idx") + 1)
    return kept.agg(F.count("*").alias("items"), F.sum(F.least(F.col("size"), dynamic_cap(tiers, last)) * F.col("remaining")).cast("long").alias("burden"))


def transitions(calls: DataFrame, first: str, then: str, order: list[str]) -> DataFrame:
    """How often ``then`` directly follows ``first`` in each session."""
    before = F.lag("tool_name").over(Window.partitionBy("session_id").orderBy(*order))
    return calls.withColumn("before", before).groupBy("session_id").agg(F.count_if((F.col("before") == first) & (F.col("tool_name") == then)).alias("transitions"))


def since_user(rows: DataFrame, order: list[str], user: Column) -> DataFrame:
    """For each session the longest run of rows after a row of the user (rows before the first count as run 0)."""
    run = F.sum(F.when(user, 1).otherwise(0)).over(Window.partitionBy("session_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("run", run).groupBy("session_id", "run").agg(F.count_if(~user).alias("calls"))
    return runs.groupBy("session_id").agg(F.max("calls").alias("longest"))


def tripwires(rows: DataFrame, messages: int, run: int, size: int, after: int, order: list[str], user: Column) -> DataFrame:
    """Sessions and which limits they cross: messages, calls since the user, large outputs late in the session."""
    runs = since_user(rows, order, user)
    base = rows.groupBy("session_id").agg(
        (F.max("n") > messages).alias("long_session"),
        F.coalesce(F.max((F.col("size") > size) & (F.col("idx") > after)), F.lit(False)).alias("late_large_output"),
    )
    return base.join(runs, "session_id").withColumn("long_run", F.col("longest") > run).drop("longest")


def with_transitions(tripped: DataFrame, calls: DataFrame, first: str, then: str, most: int, order: list[str]) -> DataFrame:
    """Tripwires with the one of too many steps from one tool to another; sessions without calls do not cross it."""
    over = transitions(calls, first, then, order).select("session_id", (F.col("transitions") > most).alias("ping_pong"))
    return tripped.join(over, "session_id", "left").withColumn("ping_pong", F.coalesce("ping_pong", F.lit(False)))


def histogram(rows: DataFrame, size: str, edges: list[int]) -> DataFrame:
    """Rows and bytes by size bucket (number of edges not above the size) with the share of all rows."""
    bucket = reduce(Column.__add__, [F.when(F.col(size) >= e, 1).otherwise(0) for e in edges])
    groups = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("bytes"))
    return groups.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))  # a row for each bucket


def reread_histogram(reads: DataFrame) -> DataFrame:
    """How many (file, session) pairs read their file once, twice, ..."""
    times = reads.groupBy("file_path", "session_id").agg(F.count("*").alias("reads"))
    return times.groupBy("reads").agg(F.count("*").alias("pairs"))


def cross_session_reads(reads: DataFrame) -> DataFrame:
    """How many files are read in one session, two, ..."""
    times = reads.select("file_path", "session_id").distinct().groupBy("file_path").agg(F.count("*").alias("sessions"))
    return times.groupBy("sessions").agg(F.count("*").alias("files"))


def depth(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """Mean and maximum messages and tool calls of a session; sessions without calls count as 0."""
    per = messages.groupBy("session_id").agg(F.count("*").alias("m")).join(calls.groupBy("session_id").agg(F.count("*").alias("c")), "session_id", "left")
    c = F.coalesce("c", F.lit(0))
    return per.agg(
        F.round(F.avg("m"), 6).alias("avg_messages"), F.max("m").alias("max_messages"), F.round(F.avg(c), 6).alias("avg_calls"), F.max(c).alias("max_calls")
    )


def unedited_reads(files: DataFrame) -> DataFrame:
    """Reads, and the share that no later edit or write of the same file in the session follows."""
    last = files.filter("operation <> 'read'").groupBy("file_path", "session_id").agg(F.max("message_id").alias("last_edit"))
    reads = files.filter("operation = 'read'").join(last, ["file_path", "session_id"], "left")
    followed = F.coalesce(F.col("last_edit") > F.col("message_id"), F.lit(False))
    out = reads.agg(F.count("*").alias("reads"), F.count_if(~followed).alias("unedited"))
    return out.withColumn("percent", F.round(F.when(F.col("reads") == 0, 0.0).otherwise(100 * F.col("unedited") / F.col("reads")), 6))


def percentiles(rows: DataFrame, over: int) -> DataFrame:
    """Exact median, p95 and p99 of session burdens and how many exceed a bound.

    At a scale where one sort of all sessions is too much, ``percentile_approx`` takes the place.
    """
    per = rows.groupBy("session_id").agg(F.sum("burden").cast("double").alias("burden"))
    q = lambda p: F.round(F.percentile("burden", F.lit(p)), 6)
    return per.agg(q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.count_if(F.col("burden") > over).alias("over"))


#: Accuracy of quantile sketches: with this k a quantile's rank is off by less than 1.5 % in all but one of a hundred cases.
SKETCH_K, RANK_ERROR = 200, 0.0165


def burden_sketches(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., sketch): a KLL sketch of session burdens for each group, such as a day or a project; a few kilobytes each, to be stored.

    Sessions are summed first, so a session that lies in several groups counts in each with what it has there.
    """
    per = rows.groupBy("session_id", *by).agg(F.sum("burden").cast("long").alias("burden"))
    return per.groupBy(*by).agg(F.kll_sketch_agg_bigint("burden", F.lit(SKETCH_K)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, *by: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(by..., n, p50, ...): quantiles of all sessions of the merged sketches, each of a rank that is off by RANK_ERROR at most (99 % sure)."""
    whole = sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))
    names = {q: f"p{round(q * 100)}" for q in at}
    return whole.select(*by, F.kll_sketch_get_n_bigint("sketch").alias("n"), *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias(names[q]) for q in at])


def readings(calls: DataFrame, lines: Column, few: int) -> DataFrame:
    """Reads by how much of the file they ask for: 'surgical' below ``few`` lines, 'full', or 'none' where no number is given."""
    reading = F.when(lines.isNull(), "none").when(lines < few, "surgical").otherwise("full")
    return calls.select(reading.alias("reading")).groupBy("reading").agg(F.count("*").alias("n"))


def followed_within(calls: DataFrame, first: str, then: str, seconds: int, keys: tuple = ("session_id",)) -> DataFrame:
    """Pairs (id, then_id, gap) of ``first`` and a later ``then`` of the same keys (a session, or a file in it) within ``seconds``.

    A range join on time buckets as wide as the range: a row meets its own and the next bucket
    only, so a busy session is spread over its buckets and no session is joined with itself whole.
    """
    bucket = F.floor(F.col("sec") / seconds)
    left = calls.filter(F.col("tool_name") == first).select(*keys, F.col("id").alias("id"), F.col("sec").alias("start"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    right = calls.filter(F.col("tool_name") == then).select(*keys, F.col("id").alias("then_id"), "sec", bucket.alias("bucket"))
    gap = F.col("sec") - F.col("start")
    return left.join(right, [*keys, "bucket"]).filter((gap > 0) & (gap <= seconds)).select(*keys, "id", "then_id", gap.alias("gap"))


def by_output(calls: DataFrame, placed: DataFrame, blobs: DataFrame) -> DataFrame:
    """Burden of each tool's outputs: the bytes of a call's output blob are carried from its message to the session's end.

    ``placed`` are messages with their positions; the window runs before the joins, over slim rows.
    """
    sizes = blobs.select(F.col("hash").alias("output_hash"), "size")
    rows = calls.select("message_id", "tool_name", "output_hash").join(placed.select(F.col("id").alias("message_id"), "remaining"), "message_id").join(sizes, "output_hash")
    return rows.groupBy("tool_name").agg(F.count("*").alias("calls"), F.sum("size").cast("long").alias("bytes"), F.sum(F.col("size") * F.col("remaining")).cast("long").alias("burden"))


def carry_forward(rows: DataFrame, order: list[str], wanted: Column, value: str) -> DataFrame:
    """Adds parent: the last ``value`` before the row, within the session, of rows that are ``wanted``."""
    before = Window.partitionBy("session_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("parent", F.last(F.when(wanted, F.col(value)), ignorenulls=True).over(before))
