"""SimHash near-dedup with pivot distance tables.

A document's fingerprint has a bit set if over half of its shingles' XXH64 have it. Fingerprints that
differ in at most three bits are linked, and linked documents form components.

1. Fingerprints are computed per batch, and equal ones become one node: copies are never paired.
2. The pivot table: every node's Hamming distances to `PIVOTS` reference fingerprints, computed once and
   kept with it. By the triangle inequality a pair with a distance to any pivot that differs by more than
   three is no link.
3. Three bits touch three of five blocks of bits at most, so linked nodes agree in two whole blocks
   (10 choices, 25 or 26 bits each). A node, with its row of the table, meets the others that share such
   a key; keys that one node has are dropped.
4. The nodes of a key are sorted by their distance to the first pivot, and each is compared with those whose
   first coordinate is at most three more: the work is that of the pairs the first pivot leaves. The other
   coordinates discard all but few, which are verified by their own distance. A key's links leave the
   task as a spanning forest, never as pairs. A key of many nodes is dealt out as pairs of chunks, and a task
   reads its groups one after the other, so none holds more than about two chunks.
5. Components of the forests' links; the least doc_id of each names it.

Work in a key grows with the square of its different fingerprints (not documents), spread over tasks.

Cases: null, empty and blank texts have the fingerprint zero and are linked like any other; a null
doc_id never names a component that has another; repeated rows stay; texts are read whole; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import common
from fieldloom.llm.components import components

MOST_BITS = 3
SHINGLE = 3
PIVOTS = 16
CHUNK_BYTES = 512 << 10
#: Nodes of one key that a task compares at once, at least and at most; between them, a 32nd of the key.
CHUNK_LOW, CHUNK_HIGH, CHUNK_PARTS = 512, 8192, 32
#: Rows of a partition that are read before whole groups of them are compared.
READ_ROWS = 1 << 15
_EDGES = [0, 13, 26, 39, 52, 64]
MASKS = [sum(((1 << _EDGES[b + 1]) - (1 << _EDGES[b])) for b in kept) for kept in itertools.combinations(range(5), 2)]
_REFERENCES = common.mix(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _shingle_hashes(text: bytes, size: int) -> np.ndarray:
    words = text.lower().split()  # of bytes: A-Z, and ASCII white space
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(b" ".join(words), 42)] if words else [], np.uint64)
    buf = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: -size])]
    return np.fromiter((h(buf[s:e], 42) for s, e in zip(starts, ends[size - 1 :], strict=True)), np.uint64, len(starts))


def fingerprints_of(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    hashes = [_shingle_hashes(t, size) for t in texts]
    n = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(n)
    if some.size:
        h = np.concatenate(hashes)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * counts > n[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(it):
        for t in common.batches(it, CHUNK_BYTES):
            fp = fingerprints_of(common.texts_of(t.column("text")), size)
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return common.map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def pivot_table(nodes: DataFrame) -> DataFrame:
    """nodes(fp, ...) with pivots: PIVOTS bytes, the distances to the references."""
    names = nodes.columns

    def run(it):
        for b in it:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            table = np.bitwise_count(fp[:, None] ^ _REFERENCES).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in table], pa.binary())], [*names, "pivots"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    return nodes.mapInArrow(run, f"{schema}, pivots binary")


def forest(group: np.ndarray, fp: np.ndarray, table: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Links within groups as (fingerprint, another of its tree), and how many pairs the table left to be verified."""
    by = np.lexsort((fp, table[:, 0], group))
    group, fp, table = group[by], fp[by], table[by].astype(np.int8)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, group.size))
    left = np.repeat(first + size, size) - np.arange(group.size)  # rows from this one to the group's end
    root, near, verified = np.arange(group.size), np.arange(group.size), 0
    for d in range(1, int(size.max(initial=1))):
        near = near[left[near] > d]
        near = near[table[near + d, 0] - table[near, 0] <= most]  # in order of this coordinate: what is too far stays so
        if not near.size:
            break
        i = near
        for p in range(1, PIVOTS):
            i = i[np.abs(table[i, p] - table[i + d, p]) <= most]
        verified += i.size
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= most]
        a, b = root[i], root[i + d]
        while (a != b).any():
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
            a, b = root[i], root[i + d]
    own = root != np.arange(group.size)
    return fp[own], fp[root[own]], verified


def links(nodes: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(u, v): a spanning set of the links between different fingerprints of nodes(fp, pivots); the table is made here if nodes come without."""
    if "pivots" not in nodes.columns:
        nodes = pivot_table(nodes)
    if most > MOST_BITS:
        raise ValueError(f"five blocks find links of up to {MOST_BITS} bits")
    keys = nodes.select("fp", "pivots", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (m >> 63 << 64)).cast("long")) for m in MASKS])).alias("t", "key"))
    many = keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keys.join(many, ["t", "key"])
    chunk = F.least(F.lit(CHUNK_HIGH), F.greatest(F.lit(CHUNK_LOW), F.ceil(F.col("n") / CHUNK_PARTS)))
    parts = F.ceil(F.col("n") / chunk).cast("int")
    dealt = met.select("fp", "pivots", "t", "key", parts.alias("c"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("own")).select(
        "fp", "pivots", "t", "key", "own", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other")
    )
    dealt = dealt.select("fp", "pivots", F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("g"))

    def compared(g, fp, pivots):
        table = np.frombuffer(b"".join(pivots), np.uint8).reshape(-1, PIVOTS)
        u, v, _ = forest(g, fp.view(np.uint64), table, most)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    def run(it):
        # Rows come in order of g: whole groups are compared as soon as the next one begins.
        kept, n = [], 0
        for b in it:
            kept.append((b.column("g").to_numpy(zero_copy_only=False), b.column("fp").to_numpy(zero_copy_only=False), b.column("pivots").to_pylist()))
            n += b.num_rows
            if n >= READ_ROWS and kept[-1][0].size and kept[-1][0][0] != kept[-1][0][-1]:
                g, fp = (np.concatenate([x[k] for x in kept]) for k in (0, 1))
                pivots = [y for x in kept for y in x[2]]
                cut = int(np.searchsorted(g, g[-1]))
                yield compared(g[:cut], fp[:cut], pivots[:cut])
                kept, n = [(g[cut:], fp[cut:], pivots[cut:])], n - cut
        if n:
            yield compared(*(np.concatenate([x[k] for x in kept]) for k in (0, 1)), [y for x in kept for y in x[2]])

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of docs."""
    prints = common.checkpoint(fingerprints(docs, size))
    nodes = common.checkpoint(pivot_table(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))))
    root = components(links(nodes.select("fp", "pivots"), most)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    placed = nodes.join(root, "fp", "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = common.checkpoint(placed.join(least, "root").select("fp", "component_id", "n"))
    # Copies of one text share a fingerprint, which may be that of a third of all documents.
    return common.split_join(prints, named, ["fp"]).select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
#: XXH64 and reachability over all pairs are not SQL; tests compare with brute force.
ORACLE_SQL: dict[str, str] = {}
