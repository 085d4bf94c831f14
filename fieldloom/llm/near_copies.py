"""One document of every group of near copies: shingles of five words, similarity 0.8 or more.

Two texts are linked if the Jaccard similarity of their sets of word shingles (64 bits of XXH64 each) is
`SIMILARITY` or more; linked texts form components, and one row of each stays.

1. A text's set becomes a node (texts of equal sets are one) with `BANDS` keys, each of the least of
   its shingles in `ROWS` orders. Texts of similarity s share no key with probability
   (1 - s**ROWS)**BANDS: at 0.8 one pair in 190,000, at 0.85 one in 10**8. Such a pair is missed
   unless others connect it.
2. Nodes that share a key with any other are joined to the key's least node, and the components of
   that are candidates. Only their texts are read again and sent, once for each chunk of `CHUNK`
   others in their component, so no task gets a whole large one.
3. In a chunk, nodes that share a key and fit in size are compared by their whole sets. The links leave
   the task as a spanning forest, never as pairs.
4. Of each component of these links the row of least doc_id, then of least hash of its text, stays.

Cases: texts of fewer words than a shingle have one shingle, all their words; null, empty and blank texts
are copies of each other; a null doc_id comes after all others, and a row that has one stays if no other
of its component does; of rows with equal doc_id and text (by 64 bits of hash) one stays; rows of one
doc_id and different texts are judged each by its text; texts are read whole; all columns are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import common, simhash
from fieldloom.llm.common import U64
from fieldloom.llm.components import components
from fieldloom.llm.simhash import CHUNK_BYTES, _shingle_hashes
from fieldloom.llm.substring_dedup import LAST_ID

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
CHUNK = 512
_ORDERS = common.mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
KEY = ["doc_id", "th"]


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    return np.unique(_shingle_hashes(text, size))


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """The keys of every set; zeros for an empty one."""
    out = np.zeros((len(sets), BANDS), U64)
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    some = np.flatnonzero(n)
    if some.size:
        h, at = np.concatenate(sets), (np.cumsum(n) - n)[some]
        for b in range(BANDS):
            key = np.full(some.size, b + 1, U64)
            for k in range(b * ROWS, (b + 1) * ROWS):
                key = common.mix(key ^ np.minimum.reduceat(common.mix(h * _ORDERS[k]), at))
            out[some, b] = key
    return out


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, th, node, bands) of every row."""

    def run(it):
        for t in common.batches(it, CHUNK_BYTES):
            sets = [shingle_set(x) for x in common.texts_of(t.column("text"))]
            node = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), U64, len(sets)).view(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(bands_of(sets).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in KEY), pa.array(node), keys], [*KEY, "node", "bands"])

    return common.map_texts(_keyed(docs), run, "doc_id long, th long, node long, bands array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    """common.keyed with LAST_ID for null and a value for a null text."""
    return common.keyed(docs).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), F.coalesce("th", F.lit(0)).alias("th"), "text")


def forest(bands: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links among sets that share a key, as (place, place of another of its tree)."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    left, u, v = np.arange(len(sets)), [], []
    while left.size:
        queue, left = [int(left[0])], left[1:]
        while queue and left.size:
            i = queue.pop()
            x = left[(size[left] >= SIMILARITY * size[i]) & (size[i] >= SIMILARITY * size[left])]
            x = x[(bands[x] == bands[i]).any(axis=1)]
            if not x.size:
                continue
            others = np.concatenate([sets[j] for j in x])
            hit = sets[i][np.minimum(np.searchsorted(sets[i], others), size[i] - 1)] == others
            both = np.add.reduceat(hit, np.cumsum(size[x]) - size[x], dtype=np.int64)
            x = x[both >= SIMILARITY * (size[i] + size[x] - both) - 1e-9]
            left = np.setdiff1d(left, x, assume_unique=True)
            queue += x.tolist()
            u += x.tolist()
            v += [i] * x.size
    return u, v


def links(docs: DataFrame, nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(u, v): a spanning set of the links between nodes(node, doc_id, th, bands) of docs."""
    keys = nodes.select("node", F.explode("bands").alias("key"))
    many = keys.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    near = keys.join(many, "key").where(F.col("node") != F.col("least")).select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()
    root = components(near)
    placed = root.unionByName(root.select(F.col("v").alias("u"), "v").distinct()).select(F.col("u").alias("node"), F.col("v").alias("root"))
    parts = placed.groupBy("root").agg(F.ceil(F.count("*") / chunk).cast("int").alias("c"))
    todo = placed.join(parts, "root").join(nodes.select("node", *KEY, "bands"), "node")
    # A row for each node: of rows with equal doc_id and text any does.
    texts = _keyed(docs).join(todo, KEY).dropDuplicates(["node"])

    def send(it):
        for t in common.batches(it, CHUNK_BYTES):
            sets = [shingle_set(x).tobytes() for x in common.texts_of(t.column("text"))]
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("node", "root", "c", "bands")), pa.array(sets, pa.binary())], ["node", "root", "c", "bands", "words"])

    sent = common.map_texts(texts.select("node", "root", "c", "bands", "text"), send, "node long, root long, c int, bands array<long>, words binary")
    sent = sent.withColumn("own", F.pmod(F.xxhash64("node"), F.col("c")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    sent = sent.select("node", "bands", "words", F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("g"))

    def run(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        u, v = forest(bands, [np.frombuffer(x, U64) for x in t.column("words").to_pylist()])
        return pa.table({"u": pa.array(node[u], pa.int64()), "v": pa.array(node[v], pa.int64())})

    return sent.groupBy("g").applyInArrow(run, "u long, v long")


def keep_one(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of docs that stay."""
    rows = _sketches(docs).groupBy("node", *KEY).agg(F.count("*").alias("n"), F.first("bands").alias("bands"))
    first = rows.groupBy("node").agg(F.min(F.struct(*KEY, "n", "bands")).alias("x"))
    nodes = common.checkpoint(first.select("node", "x.*"))
    return _least(docs, nodes, links(docs, nodes, chunk))


def keep_one_by_fingerprint(docs: DataFrame) -> DataFrame:
    """The rows that stay of components of SimHash fingerprints within simhash.MOST_BITS bits, found by op5's pivot tables; cases as above."""

    def run(it):
        for t in common.batches(it, CHUNK_BYTES):
            fp = simhash.fingerprints_of(common.texts_of(t.column("text")))
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in KEY), pa.array(fp.view(np.int64))], [*KEY, "node"])

    rows = common.map_texts(_keyed(docs), run, "doc_id long, th long, node long").groupBy("node", *KEY).agg(F.count("*").alias("n"))
    nodes = common.checkpoint(rows.groupBy("node").agg(F.min(F.struct(*KEY, "n")).alias("x")).select("node", "x.*"))
    return _least(docs, nodes, simhash.links(simhash.pivot_table(nodes.select(F.col("node").alias("fp")))))


def _least(docs: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """One row of docs for each component of nodes(node, doc_id, th, n) under the links found(u, v): the least."""
    root = components(found).select(F.col("u").alias("node"), F.col("v").alias("root"))
    least = nodes.join(root, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct(*KEY, "n")).alias("x"))
    one = least.select(F.col("x.doc_id").alias("_id"), F.col("x.th").alias("_th"), F.col("x.n").alias("_n"))
    kept = docs.join(one, (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)) == F.col("_id")) & (F.coalesce(F.xxhash64("text"), F.lit(0)) == F.col("_th")))
    again = kept.where("_n > 1").dropDuplicates(["_id", "_th"])
    return kept.where("_n = 1").unionByName(again).select(docs.columns)
