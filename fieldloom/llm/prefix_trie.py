"""The prefix trie of conversations: members, leaves and the words that sharing prefixes saves, for every node.

A node is a distinct sequence of messages (role and text); conversations that start with it are its members. It is owned by its smallest member. The
members of a longer prefix are some of those of a shorter one, so a conversation owns a suffix of its own path. What the
subtree of a node saves is therefore a sum over its members alone: the words of all their occurrences from the node on, minus
those that each member owns. A node's leaves are counted by the owners of childless nodes in the same way. So after a
window has marked the owned nodes, one group-by over prefixes gives every figure.

A node's identity is a chain of SHA-256 over its messages; texts are read once and never shuffled. Chains run in blocks of
`BLOCK` turns, and blocks of one conversation are chained by their ends, so a conversation that holds a third of all turns is many
tasks, as it is when turns are numbered: they are numbered within a partition of a global sort, and one number for each partition (all that the
driver sees) carries on from the one before. The window keeps one row a node before it shuffles (Spark limits it), and sums are
partial, so the root and a first message that many share are no hot keys. The hash of a node's ids reads them in sorted
portions; the portions of one node are hashed by one task, as a stream.

Cases: a null role or text is empty; turns are in order, null first, equal ones by role and then by hash of the message; repeated rows are messages of their
own; a null conv_id is no conversation; an empty table has no nodes, and without any turn there is the root alone; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm import common

BLOCK = 1024
#: Bytes of ids in one portion, and nodes that leave a task together.
PORTION, ROWS = 1 << 20, 4096
#: Fixed: the white space of `[^\x20\x09-\x0D]+`.
WHITE = " \t\n\x0b\f\r"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[ \\t-\\r]+"))).cast("long")


def messages(rows: DataFrame) -> DataFrame:
    """(conv_id, place, key, words): every turn with its number from 1 and a hash of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    df = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), key.alias("key"), _words(text).alias("words"))
    in_order = df.orderBy("conv_id", F.asc_nulls_first("turn"), "role", "key").select("conv_id", "key", "words")
    counted = common.checkpoint(in_order.mapInArrow(_numbered, "conv_id long, key binary, words long, part int, n long"))
    # One row for each partition, which bounds what is collected and sent back.
    parts = sorted(counted.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "n")).alias("last")).collect())
    before, have, carried = None, 0, []
    for part, first, last in parts:
        have = have if first == before else 0
        if have:
            carried.append((part, first, have))
        have = last.n + have * (first == last.conv_id)
        before = last.conv_id
    more = F.broadcast(rows.sparkSession.createDataFrame(carried, "part int, conv_id long, more long"))
    return counted.join(more, ["part", "conv_id"], "left").select("conv_id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("place"), "key", "words")


def _numbered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, held, n = TaskContext.get().partitionId(), None, 0
    for b in it:
        numbers = []
        for c in b.column("conv_id").to_pylist():
            n = n + 1 if c == held else 1
            held = c
            numbers.append(n)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(numbers, pa.int64())], ["conv_id", "key", "words", "part", "n"])


def spliced(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, key, words) and (conv_id): conversations that begin with those of their group's first one.

    Of conversation c, crc32(c) % most turns are replaced by those of c - c % group. At most twice as many conversations as a group
    is wide meet one head, of fewer than `most` turns.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % group
    sizes = common.checkpoint(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    convs = sizes.select("conv_id", "n", h.alias("h"), base.alias("base"))
    heads = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    convs = common.checkpoint(convs.join(heads, "base", "left").select("conv_id", "n", "h", "base", F.least("h", F.coalesce("there", F.lit(0))).alias("given")))
    first = turns.where((F.col("place") < most) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "key", "words")
    begun = convs.select("conv_id", "base", "given").join(first, "base").where(F.col("depth") <= F.col("given")).select("conv_id", "depth", "key", "words")
    own = turns.withColumn("h", h).where(F.col("place") > F.col("h"))
    own = common.split_join(own, convs.select("conv_id", "given", "n"), ["conv_id"]).select("conv_id", (F.col("place") - F.col("h") + F.col("given")).alias("depth"), "key", "words")
    return begun.unionByName(own), convs.select("conv_id")


def _chained(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, parent (empty for the first of a block) and the words before, within a block."""
    sha, held, node, before = hashlib.sha256, None, b"", 0
    for b in it:
        nodes, parents, words_before = [], [], []
        for c, k, key, words in zip(*(b.column(x).to_pylist() for x in ("conv_id", "block", "key", "words")), strict=True):
            if (c, k) != held:
                held, node, before = (c, k), b"", 0
            parents.append(node)
            node = sha(node + key).digest()
            nodes.append(node)
            words_before.append(before)
            before += words
        yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("conv_id", "depth", "block", "words")), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), pa.array(words_before, pa.int64())], ["conv_id", "depth", "block", "words", "node", "parent", "before"])


def _tops(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the last turns of full blocks in order: the node that the next block begins after, and the words up to it."""
    held, top, have = None, b"", 0
    for b in it:
        tops, words = [], []
        for c, node, n in zip(*(b.column(x).to_pylist() for x in ("conv_id", "node", "words")), strict=True):
            if c != held:
                held, top, have = c, b"", 0
            top = hashlib.sha256(top + node).digest() if top else node
            have += n
            tops.append(top)
            words.append(have)
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("block"), pa.array(tops, pa.binary()), pa.array(words, pa.int64())], ["conv_id", "block", "top", "so_far"])


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, words, node, parent, before): the node of every turn, and the words of the turns before it."""
    at = turns.withColumn("block", F.expr(f"(depth - 1) div {BLOCK}"))
    one = at.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth").select("conv_id", "depth", "block", "words", "key")
    one = common.checkpoint(one.mapInArrow(_chained, "conv_id long, depth long, block long, words long, node binary, parent binary, before long"))
    full = one.where(F.col("depth") % BLOCK == 0).select("conv_id", (F.col("block") + 1).alias("block"), "node", (F.col("before") + F.col("words")).alias("words"))
    if full.isEmpty():
        return one.drop("block")
    tops = full.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_tops, "conv_id long, block long, top binary, so_far long")
    after = lambda c: F.unhex(F.sha2(F.concat("top", c), 256))
    both = one.join(tops, ["conv_id", "block"], "left")
    later = F.col("top").isNotNull()
    parent = F.when(~later, F.col("parent")).when(F.col("depth") % BLOCK == 1, F.col("top")).otherwise(after("parent"))
    return common.checkpoint(both.select("conv_id", "depth", "words", F.when(later, after("node")).otherwise(F.col("node")).alias("node"), parent.alias("parent"), (F.col("before") + F.coalesce("so_far", F.lit(0))).alias("before")))


def _listed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) rows to (node, first, ids): ids in decimals, comma-joined, in portions."""
    held, first, ids, size = None, None, [], 0
    rows, waiting = ([], [], []), 0

    def close():
        for column, x in zip(rows, (held, first, ",".join(ids)), strict=True):
            column.append(x)

    def taken():
        out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.binary(), pa.int64(), pa.string()), strict=True)], ["node", "first", "ids"])
        for column in rows:
            column.clear()
        return out

    for b in it:
        for node, c in zip(b.column("node").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
            if node != held or size > PORTION:
                if ids:
                    close()
                    waiting += size
                if waiting > PORTION or len(rows[0]) >= ROWS:
                    yield taken()
                    waiting = 0
                held, first, ids, size = node, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
    if ids:
        close()
    yield taken()


def _hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, sha = None, None
    for b in it:
        nodes, out = [], []
        for node, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if node == held:
                sha.update(b"," + ids.encode())
                continue
            if sha is not None:
                nodes.append(held)
                out.append(sha.hexdigest())
            held, sha = node, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(out, pa.string())], ["node", "ends_sha256"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["node", "ends_sha256"])


def id_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): the hash of each node's ids in ascending order."""
    in_order = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    listed = in_order.mapInArrow(_listed, "node binary, first long, ids string")
    return listed.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for every node of turns(conv_id, depth, key, words), depth from 1 without gaps, and convs(conv_id), turnless ones included.

    conv_id (the owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node (empty for the root).
    """
    root = F.lit(b"")
    occurs = paths(turns)
    every = occurs.select("node", "parent", "conv_id", "depth", "before").unionByName(convs.select(root.alias("node"), F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("before")))
    smallest = F.row_number().over(Window.partitionBy("node").orderBy("conv_id"))
    owned = common.checkpoint(every.withColumn("k", smallest).where("k = 1").drop("k"))
    kids = common.checkpoint(owned.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")))
    owners = owned.join(kids, "node", "left").groupBy("conv_id").agg(F.min("depth").alias("from"), F.min_by("before", "depth").alias("own_from"), F.max(F.col("n_children").isNull().cast("long")).alias("leaf"))
    ends = occurs.groupBy("conv_id").agg(F.max("depth").alias("length"), F.sum("words").alias("total"), F.max_by("node", "depth").alias("node"))
    known = convs.join(ends, "conv_id", "left").join(owners, "conv_id", "left")
    length, total = F.coalesce("length", F.lit(0)), F.coalesce("total", F.lit(0))
    # What a conversation does not own ends where its own suffix begins, or with its last word.
    known = common.checkpoint(known.select("conv_id", F.coalesce("from", length + 1).alias("from"), F.coalesce("own_from", total).alias("own_from"), F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("node", root).alias("end"), (length + 1).alias("n")))
    met = common.split_join(every, known.drop("end"), ["conv_id"])
    shared = F.when(F.col("depth") < F.col("from"), F.col("own_from") - F.col("before")).otherwise(0)
    nodes = met.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(shared).alias("saved_tokens"))
    above = common.checkpoint(kids.join(owned.select("node", "conv_id"), "node").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n")))
    nodes = common.split_join(nodes, above, ["parent"], "left").join(kids, "node", "left").join(id_hashes(known.select(F.col("end").alias("node"), "conv_id")), "node", "left")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"), "node")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*spliced(messages(common.table(spark, sf_dir, "conversations")))).drop("node")


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLE_SQL = {
    "op11_prefix_trie": r"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
o AS (SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list(x ORDER BY i) AS xs FROM o GROUP BY conv_id),
k AS (SELECT conv_id, xs, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)), lambda a, c: xor(a >> 8, t[xor(a % 256, c) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 4 AS h FROM s, t),
b AS (SELECT k.conv_id, list_concat(coalesce(s.xs[1:h], []), k.xs[h + 1:]) AS xs FROM k LEFT JOIN s ON s.conv_id = k.conv_id - k.conv_id % 20),
n AS (SELECT conv_id, d, xs[1:d] AS p, len(xs) = d AS whole FROM (SELECT *, unnest(range(len(xs) + 1)) AS d FROM b)),
g AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (whole) AS ids,
  CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(list_filter(regexp_split_to_array(p[d].t, '[\x20\x09-\x0D]+'), lambda w: w <> '')) END AS saved FROM n GROUP BY p, d),
c AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1),
l AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN c ON c.p = g.p),
u AS (SELECT p[1:a] AS p, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(d + 1)) AS a FROM l) GROUP BY 1)
SELECT l.conv_id, l.d AS depth, up.conv_id AS parent_conv_id, l.n_convs, l.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(l.ids, '')) AS ends_sha256
FROM l JOIN u ON u.p = l.p LEFT JOIN g up ON l.d > 0 AND up.d = l.d - 1 AND up.p = l.p[1:l.d - 1]
"""
}
