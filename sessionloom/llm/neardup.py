"""Near-duplicate groups by SetSketch registers.

A document's set of word shingles becomes SetSketch registers: the minimum of an exponential
variable over the set, on an exponentially spaced scale and truncated. Documents with one set are
first grouped by its fingerprint, so only class representatives go on. Bands of registers
propose links, a likelihood over all registers jointly estimates the similarity of proposed
pairs, and full shingle sets confirm the links.

No group is expanded into all its pairs: first every member of a band's bucket is
compared with one centre, confirmed links merge components, and only members that are still apart go on. Where they
are many in one bucket, they are dealt anew by their rarest shingles: two linked sets share one of the rarest fifth of each, so
pages that share nothing but a template do not meet. No task gets more than two blocks of a bucket.
"""

from __future__ import annotations

import math
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, map_arrow, release, table, written
from .words import SPACED, mixed, word_hashes

#: Words of a shingle where no other size is given, and those of the op7 query.
SHINGLE, OP7_SHINGLE = 5, 2
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: A link of just that similarity shares a band of ROWS registers with probability 0.8^6 = 0.26,
#: so all of BANDS miss it with probability below 1e-8.
ROWS, BANDS = 6, 62
REGISTERS = ROWS * BANDS
#: Base of the register scale, its rate, and the largest register value.
SCALE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: Pairs whose estimate is this many standard deviations below the threshold are not compared in full.
DEVIATIONS = 5.0
#: Members of a bucket in one block: a task holds a block of all members and one of those that are still apart.
BLOCK = 512
SEED = 7

_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(1 << 62, size=REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(1 << 63, size=REGISTERS, dtype=np.uint64)
_BAND_FACTORS = _random.integers(1 << 62, size=ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has one shingle, without words none."""
    hashes, counts = word_hashes([t or "" for t in texts], SPACED)
    out, at = [], 0
    for n in counts.tolist():
        words = hashes[at : at + n]
        at += n
        width = min(size, n)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        found = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            found = mixed(found * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n - width + 1])
        out.append(np.unique(found))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch of one set: floor(1 - log_b(min h)), truncated to 0..TOP + 1."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 256):
        values = np.multiply.outer(_FACTORS, shingles[at : at + 256])
        values += _SHIFTS[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    uniform = (least >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54
    exponential = -np.log1p(-uniform) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / math.log(SCALE)), 0, TOP + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_keys(low: np.ndarray) -> np.ndarray:
    """One key for each band of the registers' low bytes; its last six bits are the band's number."""
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    keys = mixed((rows * _BAND_FACTORS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return ((keys & ~np.uint64(63)) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _log_share(x: np.ndarray) -> np.ndarray:
    """Probability that one register exceeds another by the scale's step, p_b of the SetSketch paper."""
    return -np.log1p(-x * (SCALE - 1) / SCALE) / math.log(SCALE)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches (rows) with set sizes ``na`` and ``nb``."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)[:, None]
    up = np.clip(_log_share(np.maximum(u[:, None] - v[:, None] * grid, 0)), 1e-12, 1)
    down = np.clip(_log_share(np.maximum(v[:, None] - u[:, None] * grid, 0)), 1e-12, 1)
    level = np.clip(1 - up - down, 1e-12, 1)
    likelihood = more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(level)
    return grid[np.arange(len(grid)), likelihood.argmax(axis=1)]


def _sketched(batches, size: int):
    for batch in batches:
        sets = shingle_sets(batch.column(1).to_pylist(), size)
        prints = [None if not len(s) else f"{int(s.sum(dtype=np.uint64)):016x}{int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)):016x}" for s in sets]
        found = [registers(s).tobytes() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(prints, pa.string()), pa.array(found, pa.binary())],
            ["doc_id", "n_shingles", "print", "sketch"],
        )


def _with_sets(batches, size: int):
    for batch in batches:
        sets = shingle_sets(batch.column(1).to_pylist(), size)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "set"])


def _with_keys(batches):
    for batch in batches:
        keys = [band_keys(np.frombuffer(s, np.uint16).astype(np.uint8)) for s in batch.column(1).to_pylist()]
        if keys:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(ids, BANDS))], ["key", "id"])


def _likely(batches):
    """Pairs whose likelihood estimate does not rule a link out."""
    least = PERCENT / 100 - DEVIATIONS * math.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS)
    for batch in batches:
        if not batch.num_rows:
            continue
        na, nb = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3))
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
        keep = estimate(a, b, na, nb) >= least
        slim = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"])
        yield slim.filter(pa.array(keep))


def confirmed(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are linked: size ratio, then likelihood, then intersection."""
    left = sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    close = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
    both = pairs.join(left, "a").join(right, "b").filter(close).select("a", "b", "na", "nb", "sa", "sb")
    likely = written(map_arrow(both, _likely, "a long, b long"), "likely")
    needed = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
    sets = written(map_arrow(texts.join(needed, "id", "left_semi"), partial(_with_sets, size=size), "id long, set array<long>"), "sets")
    shared = F.size(F.array_intersect("xa", "xb"))
    union = F.size("xa") + F.size("xb") - shared
    return (
        likely.join(sets.select(F.col("id").alias("a"), F.col("set").alias("xa")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("set").alias("xb")), "b")
        .filter(100 * shared >= PERCENT * union)
        .select("a", "b")
    )


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(id, label): the smallest id that ``links`` (a, b) and earlier ``labels`` reach from each id.

    Labels are lowered to the smallest of all neighbours' and then to their label's own label,
    until nothing changes; each round is a few shuffles of slim rows and is written.
    """
    if labels is not None:  # an earlier component is a link from each member to its label
        links = links.unionByName(labels.select(F.col("id").alias("a"), F.col("label").alias("b")))
    both = written(
        links.filter("a <> b").unionByName(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    now = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        seen = both.join(now.select(F.col("id").alias("a"), "label"), "a").groupBy(F.col("b").alias("id")).agg(F.min("label").alias("m"))
        lower = written(now.join(seen, "id").select("id", F.least("label", "m").alias("label"), F.col("label").alias("was")), "labels")
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("root"))
        after = written(lower.join(jump, "label", "left").select("id", F.coalesce("root", "label").alias("label"), "was"), "labels")
        dropped(now, lower)
        if after.filter("label <> was").isEmpty():
            dropped(both)
            return after.select("id", "label")
        now = after


def groups(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``documents``; other columns are ignored.

    Shingles have ``size`` words. Rows of one doc_id are one document, whose links are those of all its texts. Null texts, and
    texts without words, have the empty set and are linked with nothing. Rows
    with one set are linked. Repeated rows each get a row; a row without a doc_id is
    in no group: its component is null and it is kept.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = written(map_arrow(docs, partial(_sketched, size=size), "doc_id long, n_shingles long, print string, sketch binary"), "prints")
    classes = written(
        prints.filter("print IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("print")
        .agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.min_by("sketch", "doc_id").alias("sketch")),
        "classes",
    )
    keys = map_arrow(classes.select("id", "sketch"), _with_keys, "key long, id long")
    centres = written(keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select("key", "a"), "centres")
    members = written(keys.join(centres, "key"), "members")
    dropped(centres)
    active = members.select("id").distinct()
    sketches = written(classes.select("id", "n", "sketch").join(active, "id", "left_semi"), "sketches")
    texts = written(docs.withColumnRenamed("doc_id", "id").join(active, "id", "left_semi"), "texts")
    release(docs.sparkSession)
    labels = _linked(members, sketches, texts, size)
    of_class = written(classes.join(labels, "id", "left").select("print", F.coalesce("label", "id").alias("component")), "of_class")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = prints.drop("sketch").join(of_class, "print", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of a sorted set with each of other sets."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def _with_small_sets(batches, size: int):
    """Sets of 32-bit hashes: they never show fewer shared shingles but for rare collisions, which are allowed for."""
    for batch in batches:
        sets = shingle_sets(batch.column(1).to_pylist(), size)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in sets], pa.binary())], ["id", "small"])


def _apart(batches):
    """Links to confirm, by the low bytes of registers and small sets, between a block of a bucket's members and one of those that are still apart: rows come sorted by (key, block)."""
    least = PERCENT / 100 - DEVIATIONS * math.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS)

    def pairs(rows: list) -> list[tuple[int, int]]:
        ids, comps, n = (np.array([r[i] for r in rows]) for i in (2, 3, 5))
        every, minor = np.array([r[6] for r in rows]), np.array([r[7] for r in rows])
        low = np.frombuffer(b"".join(r[4] for r in rows), np.uint16).astype(np.uint8).reshape(len(rows), REGISTERS)
        band, mine, out = rows[0][0] & 63, np.flatnonzero(~every), []
        for y in np.flatnonzero(every):
            once = ~minor[mine] | (ids[mine] > ids[y])
            xs = mine[(comps[mine] != comps[y]) & once & (100 * np.minimum(n[mine], n[y]) >= PERCENT * np.maximum(n[mine], n[y]))]
            if not len(xs):
                continue
            same = low[xs] == low[y]
            first = band if rows[0][9] else same.reshape(len(xs), BANDS, ROWS).all(axis=2).argmax(axis=1)  # a pair is left to the first band it shares
            xs = xs[(first == band) & (same.mean(axis=1) >= least)]
            if not len(xs):
                continue
            mine_sets = [np.frombuffer(rows[x][8], np.uint32) for x in xs.tolist()]
            shared = _shared(np.frombuffer(rows[y][8], np.uint32), mine_sets) + 2 + (np.maximum(n[xs], n[y]) >> 15) ** 2
            xs = xs[100 * shared >= PERCENT * (n[xs] + n[y] - shared)]
            out += [(min(ids[x], ids[y]), max(ids[x], ids[y])) for x in xs.tolist()]
        return out

    key, rows = None, []
    for batch in batches:
        found = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (row[9], *row[:2]) != key:
                if rows:
                    found += pairs(rows)
                key, rows = (row[9], *row[:2]), []
            rows.append(row)
        if found:
            yield _pairs_batch(found)
    if rows and (found := pairs(rows)):
        yield _pairs_batch(found)


def _pairs_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*sorted(set(found)), strict=True)], ["a", "b"])


def _mixed(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, id, comp) of all members, and (key, all, few, large) of buckets that hold several components so far.

    Minors are the members outside their bucket's largest component, ``large``. ``all`` and ``few`` are the numbers of blocks of its members and of its minors.
    """
    placed = members.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("comp"))
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("m"))
    mixed_keys = written(
        sizes.groupBy("key")
        .agg(F.sum("m").alias("m"), F.count("*").alias("c"), F.max("m").alias("most"), F.max_by("comp", F.struct("m", "comp")).alias("large"))
        .filter("c > 1")
        .select("key", F.ceil(F.col("m") / BLOCK).cast("long").alias("all"), F.ceil((F.col("m") - F.col("most")) / BLOCK).cast("long").alias("few"), "large"),
        "mixed",
    )
    return written(placed, "placed"), mixed_keys


def _dealt(placed: DataFrame, mixed_keys: DataFrame) -> DataFrame:
    """(key, block, id, comp, every, minor) of the buckets of ``mixed_keys``.

    All members of a bucket are cut into blocks, and so are its minors; a ``block`` is one pair of them, with both sides
    (``every`` are the minors), so each minor meets each member once and a group holds about two
    blocks, however many members are minors. The rows of a bucket grow with members x minors / BLOCK.
    """
    rows = placed.join(mixed_keys, "key").withColumn("minor", F.col("comp") != F.col("large"))
    block = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), n)
    others = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = rows.withColumn("j", others("few")).withColumn("i", block(0, F.col("all"))).withColumn("every", F.lit(False))
    every = rows.filter("minor").withColumn("i", others("all")).withColumn("j", block(1, F.col("few"))).withColumn("every", F.lit(True))
    both = one.unionByName(every)
    return both.select("key", (F.col("i") * F.col("few") + F.col("j")).alias("block"), "id", "comp", "every", "minor")


def _rarest(texts: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(key, id): those of the rarest shingles of each of ``ids`` that another of them has.

    A set of n shingles is linked only with sets that hold 80 % of it, so with every set that it is linked with it shares one of
    its n - 0.8 n + 1 rarest, in any order that all sets agree on; here by how many of the sets hold a shingle. No link is lost.
    """
    sets = written(map_arrow(texts.join(ids, "id", "left_semi"), partial(_with_sets, size=size), "id long, set array<long>").withColumn("row", F.monotonically_increasing_id()), "sets")
    each = sets.select("row", "id", F.size("set").alias("n"), F.explode("set").alias("key"))
    common = each.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1")
    mine = Window.partitionBy("row")
    ranked = each.join(common, "key").withColumn("place", F.row_number().over(mine.orderBy("held", "key"))).withColumn("shared", F.count("*").over(mine))
    alone = F.col("n") - F.col("shared")  # shingles of no other set come first
    most = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    return ranked.filter(F.col("place") <= most - alone).select("key", "id").distinct()


def _remaining(members: DataFrame, labels: DataFrame, sketches: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(a, b) that share a bucket, are in different components so far, and may be linked."""
    placed, mixed_keys = _mixed(members, labels)
    rows = _dealt(placed, mixed_keys.filter("few = 1")).withColumn("rare", F.lit(False))
    crowded = placed.join(mixed_keys.filter("few > 1"), "key", "left_semi").select("id").distinct()
    if not crowded.isEmpty():
        rare, rare_keys = _mixed(_rarest(texts, written(crowded, "crowded"), size), labels)
        rows = rows.unionByName(_dealt(rare, rare_keys).withColumn("rare", F.lit(True)))
    needed = written(rows.filter("NOT every").select("id").distinct(), "needed")
    small = map_arrow(texts.join(needed, "id", "left_semi"), partial(_with_small_sets, size=size), "id long, small binary")
    data = written(sketches.join(small, "id"), "data")
    rows = rows.join(data, "id")
    parts = max(12, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(parts, "rare", "key", "block").sortWithinPartitions("rare", "key", "block")
    return map_arrow(dealt.select("key", "block", "id", "comp", "sketch", "n", "every", "minor", "small", "rare"), _apart, "a long, b long").distinct()


def _linked(members: DataFrame, sketches: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(id, label) of all ids that are linked with another."""
    star = members.filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    links = written(confirmed(star, sketches, texts, size), "confirmed")
    release(texts.sparkSession)
    labels = components(links)
    more = written(confirmed(_remaining(members, labels, sketches, texts, size), sketches, texts, size), "confirmed")
    return components(more, labels)


def keep_first(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows, with all columns, of the first document of each group, and of all that are linked with none.

    A row without a doc_id is in no group and stays. Rows that repeat a kept doc_id all stay.
    """
    gone = f"_{uuid.uuid4().hex}"  # no column of the documents
    rest = groups(documents, size).filter("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    return documents.join(written(rest, "gone"), F.col("doc_id") == F.col(gone), "left_anti")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), OP7_SHINGLE)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS sh
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws), 2))) AS i) AS r
  WHERE len(ws) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2
  ) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * i >= 80 * (na.n + nb.n - i)
),
reach(id, r) AS (
  SELECT a, b FROM link
  UNION
  SELECT reach.id, link.b FROM reach JOIN link ON reach.r = link.a
),
c AS (SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.r, w.doc_id)) AS component_id
      FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id, min(r) AS r FROM reach GROUP BY id) m ON m.id = w.doc_id)
SELECT doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c
"""
