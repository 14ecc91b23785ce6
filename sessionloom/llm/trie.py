"""Prefix trie of conversations by a global sort.

A conversation is an array of turn digests. Arrays are sorted over all partitions, so that the
conversations below a node are one interval. Each task sweeps its sorted run with a stack: adjacent
arrays share as many turns as their longest common prefix says, deeper nodes close. Nodes on the
path of a run's first or last array may go on in the next run: their pieces, a stack for each end of
a run, are stitched in the order of the runs.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, written

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an output batch, and ids in one row of a piece.
ROWS, IDS = 2048, 1024
NO_ENDS = hashlib.sha256(b"").hexdigest()
PIECES = (
    "run int, id long, parent_run int, parent_id long, depth int, left boolean, open boolean, chunk int, turn binary, words long, "
    "conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
)
STITCHED = "conv_id long, depth int, parent_run int, parent_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, pieces array<struct<run:int,id:long>>"


def arrays(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns (digest, words) in order, from (conv_id, turn, role, text).

    A null turn comes first, turns that repeat a number are ordered by role and digest; null roles and texts are
    empty. Rows without a conv_id take no part. Texts stay where they are read, only their digests move.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.size(F.regexp_extract_all(text, F.lit(WORD), 0)).cast("long")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), words.alias("words"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    found = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return found.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(own: DataFrame, family: int = 20, opening: int = 4) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of c - c % ``family``, h = crc32(c) % ``opening``.

    The turns of an absent conversation are none. At most 2 * ``family`` conversations share an opening, of at most ``opening`` - 1 turns.
    """
    c = F.col("conv_id")
    first = own.filter(c % family == 0).select(c.alias("of"), F.slice("turns", 1, opening - 1).alias("opening"))
    h = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(opening)).cast("int")
    both = own.join(first, own["conv_id"] - own["conv_id"] % family == first["of"], "left").withColumn("h", h)
    none = F.slice("turns", 1, 0)
    head = F.slice(F.coalesce("opening", none), F.lit(1), F.col("h"))
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


class Node:
    """An open node or a piece of one; what has been closed below it is folded into it."""

    __slots__ = ("id", "depth", "turn", "words", "left", "conv", "n", "children", "leaves", "saved", "ends", "open", "pieces", "hash")

    def __init__(self, id, depth, turn, words, left):
        self.id, self.depth, self.turn, self.words, self.left = id, depth, turn, words, left
        self.conv, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, []
        self.open, self.pieces, self.hash = True, [], None

    def takes(self, conv, n, children, leaves, saved) -> None:
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv = conv
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved

    def closes(self, parent) -> None:
        """All members are known now."""
        self.leaves = self.leaves if self.children else 1
        self.saved += (self.n - 1) * self.words
        if parent is not None:
            parent.takes(self.conv, self.n, 1, self.leaves, self.saved)


def _batches(rows, schema: str, most: int = ROWS):
    """Rows as record batches of a schema given as Spark writes it."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split(" ", 1) for x in schema.split(", ")]
    kind = pa.schema([(name, kinds.get(k, pa.list_(pa.struct([("run", pa.int32()), ("id", pa.int64())])))) for name, k in fields])
    out = []
    for row in rows:
        out.append(row)
        if len(out) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)


def _swept(batches):
    """Nodes of one sorted run: closed ones are whole, those of the first and the last path are pieces."""
    run, stack, before, made = TaskContext.get().partitionId(), [], [], 0

    def row(node, parent, piece, chunk=0, ends=None):
        return (
            run, node.id, None if parent is None else run, None if parent is None else parent.id, node.depth, piece and node.left, piece and node.open, chunk,
            node.turn if piece else None, node.words, node.conv, node.n, node.children, node.leaves, node.saved, ends,
        )

    def pieces(node, parent):
        yield row(node, parent, True)
        for chunk, at in enumerate(range(0, len(node.ends), IDS), 1):
            yield row(node, parent, True, chunk, ",".join(map(str, node.ends[at : at + IDS])))

    for batch in batches:
        for conv, turns, words in zip(*(batch.column(i).to_pylist() for i in range(3))):
            common = 0
            while common < len(before) and common < len(turns) and before[common] == turns[common]:
                common += 1
            while len(stack) > common + 1:
                node = stack.pop()
                if node.left:
                    node.open = False
                    yield from pieces(node, stack[-1])
                else:
                    node.closes(stack[-1])
                    yield row(node, stack[-1], False, 0, hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest() if node.ends else None)
            first = not stack
            for depth in range(len(stack), len(turns) + 1):
                stack.append(Node(made, depth, turns[depth - 1] if depth else b"", words[depth - 1] if depth else 0, first))
                made += 1
            stack[-1].takes(conv, 1, 0, 0, 0)
            stack[-1].ends.append(conv)
            before = turns
    for depth, node in enumerate(stack):
        yield from pieces(node, stack[depth - 1] if depth else None)


def _stitched(rows):
    """Whole nodes from pieces in the order of run, side (left first), depth and chunk."""
    stack: list[Node] = []

    def close():
        node = stack.pop()
        parent = stack[-1] if stack else None
        node.closes(parent)
        above = parent.pieces[0] if parent else (None, None)
        ends = node.hash.hexdigest() if node.hash else None
        return (node.conv, node.depth, *above, node.n, node.children, node.leaves, node.saved, ends, [{"run": r, "id": i} for r, i in node.pieces])

    for _, of_run in groupby(rows, lambda r: r["run"]):
        same, sides = True, False
        for r in of_run:
            if r["chunk"]:
                node = stack[r["depth"]]
                data = r["ends"].encode()
                node.hash = node.hash or hashlib.sha256()
                node.hash.update(b"," + data if node.ends else data)
                node.ends = [True]
                continue
            if not r["left"] and not sides:
                sides = True
                while not stack[-1].open:
                    yield close()
            if r["left"]:
                same = same and r["depth"] < len(stack) and stack[r["depth"]].turn == r["turn"]
            else:
                same = False
            if not same:
                while len(stack) > r["depth"]:
                    yield close()
                stack.append(Node(None, r["depth"], r["turn"], r["words"], False))
            node = stack[r["depth"]]
            node.takes(r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"])
            node.open = r["open"]
            node.pieces.append((r["run"], r["id"]))
        while stack and not stack[-1].open:
            yield close()
    while stack:
        yield close()


def trie(paths: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the arrays ``turns`` (digest, words) of ``paths`` (conv_id, turns).

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Each conv_id comes once. A conversation without turns is a member of the
    root alone; without conversations there is no node. Equal arrays are sorted by conv_id, so a
    sequence that a third of all conversations share is swept by several tasks. What they pass on is a
    stack of open nodes for each end of a run and, for a node whose ends go on, its ids joined by the
    thousand; one task stitches these: its rows grow with runs and depth, not with conversations.

    A parent is known to its children by (run, number), the latter given when it was opened; so a node
    with very many children is as many keys as there are runs that it spans.
    """
    flat = paths.select("conv_id", F.transform("turns", lambda t: t["digest"]).alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))
    runs = flat.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "path", "words")
    pieces = written(map_arrow(runs, lambda batches: _batches(_swept(batches), PIECES), PIECES), "trie")
    edge = F.col("left") | F.col("open")
    ends = pieces.filter(edge).repartition(1).sortWithinPartitions("run", F.desc("left"), "depth", "chunk")
    stitched = written(map_arrow(ends, lambda batches: _batches(_stitched(r for b in batches for r in b.to_pylist()), STITCHED, 64), STITCHED), "stitched")
    whole = pieces.filter(~edge)
    columns = ["conv_id", "depth", "parent_run", "parent_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    nodes = whole.select(*columns).unionByName(stitched.select(*columns))
    parents = whole.filter("n_children > 0").select("run", "id", "conv_id").unionByName(stitched.select(F.inline("pieces"), "conv_id").select("run", "id", "conv_id"))
    parents = parents.select("run", "id", F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(parents, (nodes["parent_run"] == parents["run"]) & (nodes["parent_id"] == parents["id"]), "left")
    long: list[Column] = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return found.select(*long, F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(arrays(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, sha256(length(r) || ':' || r || x) AS digest, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, sha256(length(r) || ':' || r || x)) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
),
k AS (
  SELECT DISTINCT c, c - c % 20 AS b,
         xor(list_reduce([4294967295] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
             lambda crc, s: list_reduce([xor(crc, s)] || [CAST(j AS BIGINT) FOR j IN range(8)],
               lambda v, j: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) % 4 AS h
  FROM t
),
r AS (
  SELECT k.c, 0 AS part, i, digest, words FROM k JOIN t ON t.c = k.b AND t.i <= k.h
  UNION ALL SELECT k.c, 1, i, digest, words FROM k JOIN t ON t.c = k.c AND t.i > k.h
),
m AS (
  SELECT c, CAST(0 AS BIGINT) AS d, 'root' AS node, NULL AS above, CAST(0 AS BIGINT) AS words FROM k
  UNION ALL
  SELECT c, d, node, coalesce(lag(node) OVER (PARTITION BY c ORDER BY d), 'root'), words FROM (
    SELECT c, row_number() OVER w AS d, md5(string_agg(digest, '') OVER w) AS node, words
    FROM r WINDOW w AS (PARTITION BY c ORDER BY part, i)
  )
),
n AS (SELECT node, any_value(above) AS above, any_value(d) AS d, min(c) AS c, count(*) AS n_convs, any_value(words) AS words FROM m GROUP BY node),
x AS (SELECT above AS node, count(*) AS n_children FROM n GROUP BY above),
s AS (
  SELECT m.node, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (WHERE x.node IS NULL) AS n_leaves
  FROM n JOIN m ON m.c = n.c AND m.d <= n.d LEFT JOIN x ON x.node = n.node GROUP BY m.node
),
e AS (
  SELECT node, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends
  FROM (SELECT c, node, d = max(d) OVER (PARTITION BY c) AS at_end FROM m) WHERE at_end GROUP BY node
)
SELECT n.c AS conv_id, n.d AS depth, p.c AS parent_conv_id, n.n_convs AS n_convs, coalesce(x.n_children, 0) AS n_children,
       s.n_leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n LEFT JOIN n p ON p.node = n.above LEFT JOIN x ON x.node = n.node JOIN s ON s.node = n.node LEFT JOIN e ON e.node = n.node
"""
