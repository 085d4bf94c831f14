"""Substring dedup: Rabin-Karp hashes of every window of `window` words, counted in Spark.

A word that lies in a window whose word sequence also starts in a document with a smaller doc_id is
removed. Windows are judged on the input.

1. Map, per batch of documents: rolling hashes of all windows, straight from the words' bytes. Equal
   windows of a batch are combined to the one of the smallest doc_id; the rest is decided here (a
   smaller doc_id has it) or follows that one (the same doc_id). One row per (batch, bucket) carries
   the packed hashes.
2. By bucket, a hash independent of the first: a window is flagged if its hash has a smaller doc_id
   in any batch. A window counts as another's copy if 64 bits and the bucket agree; among n windows
   in b buckets some n * n / (b * 2**65) pairs may agree by chance.
3. By batch: flagged windows merge into maximal intervals of words per document.
4. The documents are joined with their intervals.

A sequence that a third of all documents share is one value per batch after step 1, so no task
gets the group. Buckets grow in number with the input without an upper bound: one stands for 2 MB of input until there are
`FEW_BUCKETS`, then for more, up to 64 MB, and from there on (2 TB) their number grows again, and with it the size of a batch up to
32 MB, so that a batch still has some windows for each. So what a task holds is bounded at every size.

Cases: null, empty and short texts have no windows and keep all words; rows that share a doc_id are
not earlier than each other; repeated rows get equal results; a null doc_id counts as the largest.
Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import common
from fieldloom.llm.common import pack, pack_sorted, unpack, unpack_sorted

WINDOW = 13
#: Text of a batch while buckets are few, and at most.
BATCH_BYTES, WIDEST_BATCH = 4 << 20, 32 << 20
CHUNK_BYTES = 1 << 20
#: Input bytes for a bucket while there are at most so many (a batch of 700,000 windows then has about 20 in each), and in the end.
BUCKET_BYTES, FEW_BUCKETS, WIDEST_BUCKET = 2 << 20, 1 << 15, 64 << 20
LAST_ID = np.iinfo(np.int64).max

_EXCHANGE = "bucket long, batch long, kind int, docs binary, hashes binary, places binary, more binary"
_FLAGS = "batch long, kind int, docs binary, places binary, more binary"
_SPANS = "doc_id long, th long, starts binary, ends binary"


def buckets_for(size: int) -> int:
    """Buckets for an input of so many bytes."""
    return int(max(64, min(FEW_BUCKETS, size // BUCKET_BYTES), size // WIDEST_BUCKET))


def batch_bytes(n_buckets: int) -> int:
    return min(WIDEST_BATCH, BATCH_BYTES * max(1, n_buckets // FEW_BUCKETS))


def _ids(column) -> np.ndarray:
    return column.fill_null(LAST_ID).to_numpy().astype(np.int64)


def windows_by_bucket(docs: DataFrame, n_buckets: int, window: int = WINDOW) -> DataFrame:
    """Step 1. kind 0: windows of one bucket; kind 1: the batch's documents and what is decided."""

    narrow = np.uint16 if n_buckets <= 1 << 16 else np.uint32  # numpy sorts 16 bits by radix

    def run(it):
        part, n = TaskContext.get().partitionId(), 0
        for t in common.batches(it, batch_bytes(n_buckets)):
            ids = _ids(t.column("doc_id").combine_chunks())
            order = np.argsort(ids, kind="stable")
            t, ids = t.take(pa.array(order)), ids[order]
            got = [common.word_hashes(texts) for texts in _chunked(t)]
            h1, h2, counts = (np.concatenate(x) for x in zip(*got, strict=True))
            at = np.concatenate([[0], np.cumsum(counts)])
            ends = np.repeat(at[1:], counts)
            starts = np.flatnonzero(np.arange(h1.size) + window <= ends)
            batch = (part << 24) + n
            n += 1
            a = common.WORDS_1.spans(h1, starts, starts + window)
            bucket = (common.mix(common.WORDS_2.spans(h2, starts, starts + window)) % np.uint64(n_buckets)).astype(np.int64)
            ids_of = ids[np.searchsorted(at, starts, "right") - 1]
            # Stable, and starts ascend by doc_id: a group's first is that of its smallest doc_id.
            by = np.argsort(a, kind="stable")
            by = by[np.argsort(bucket[by].astype(narrow), kind="stable")]
            new = np.ones(by.size, bool)
            new[1:] = (a[by][1:] != a[by][:-1]) | (bucket[by][1:] != bucket[by][:-1])
            head = by[np.maximum.accumulate(np.where(new, np.arange(by.size), 0))]
            later = ids_of[by] > ids_of[head]
            sure = np.sort(starts[by[later]])
            tied = ~new & ~later
            more = [pack_sorted(sure), pack(starts[by[tied]]), pack(starts[head[tied]])]
            heads = np.sort(by[new])
            heads = heads[np.argsort(bucket[heads].astype(narrow), kind="stable")]
            rows = []
            for x in common.split_by(bucket[heads], heads):
                own, first = np.unique(ids_of[x], return_index=True)
                docs_of = _join([pack_sorted(own), pack(np.diff(np.append(first, x.size)))])
                rows.append((int(bucket[x[0]]), batch, 0, docs_of, a[x].tobytes(), pack_sorted(starts[x]), None))
            th = t.column("th").to_numpy().astype(np.int64)
            rows.append((batch % n_buckets, batch, 1, _join([ids.tobytes(), th.tobytes(), pack(counts)]), None, None, _join(more)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "batch", "kind", "docs", "hashes", "places", "more"])

    return docs.mapInArrow(run, _EXCHANGE)


def _chunked(t: pa.Table):
    texts = common.texts_of(t.column("text"))
    for c in common.chunks(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, CHUNK_BYTES):
        yield texts[c]


def _join(parts: list[bytes]) -> bytes:
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def _split(b: bytes, n: int) -> list[bytes]:
    lens = np.frombuffer(b, np.int64, n)
    at = 8 * n + np.concatenate([[0], np.cumsum(lens)])
    return [b[i:j] for i, j in zip(at, at[1:], strict=False)]


def flags(exchange: DataFrame, size: int) -> DataFrame:
    """Step 2: by batch, which windows have a smaller doc_id elsewhere; kind 1 passes through."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        out = [(r["batch"], 1, r["docs"], None, r["more"]) for r in rows if r["kind"] == 1]
        rows = [r for r in rows if r["kind"] == 0]
        if rows:
            h = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
            d = []
            for r in rows:
                own, n = _split(r["docs"], 2)
                d.append(np.repeat(unpack_sorted(own), unpack(n)))
            d = np.concatenate(d)
            by = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1]]))
            least = np.minimum.reduceat(d[by], first)
            flag = np.zeros(h.size, bool)
            flag[by] = d[by] > np.repeat(least, np.diff(np.append(first, h.size)))
            i = 0
            for r in rows:
                n = len(r["hashes"]) // 8
                if flag[i : i + n].any():
                    out.append((r["batch"], 0, None, pack_sorted(unpack_sorted(r["places"])[flag[i : i + n]]), None))
                i += n
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["batch", "kind", "docs", "places", "more"])

    return common.spread(exchange, "bucket", size).groupBy("bucket").applyInArrow(run, _FLAGS)


def intervals(found: DataFrame, size: int, window: int = WINDOW) -> DataFrame:
    """Step 3: per document, the maximal runs of words to remove, as word numbers."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        whole = next(r for r in rows if r["kind"] == 1)
        ids, th, counts = _split(whole["docs"], 3)
        sure, tied, heads = _split(whole["more"], 3)
        counts = unpack(counts)
        at = np.concatenate([[0], np.cumsum(counts)])
        hit = np.zeros(at[-1] + 1, bool)
        for r in rows:
            if r["kind"] == 0:
                hit[unpack_sorted(r["places"])] = True
        tied = unpack(tied)
        hit[tied] |= hit[unpack(heads)]
        hit[unpack_sorted(sure)] = True
        places = np.flatnonzero(hit)
        s, e = common.runs(common.covered(int(at[-1]), places, places + window))
        # A run may cross into the next document: cut it at the documents' borders.
        inner = at[1:-1]
        cuts = inner[common.covered(int(at[-1]) + 1, s + 1, e)[np.minimum(inner, at[-1])]] if s.size else inner[:0]
        s, e = np.unique(np.concatenate([s, cuts])), np.unique(np.concatenate([e, cuts]))
        doc = np.searchsorted(at, s, "right") - 1
        out = []
        ids, th = np.frombuffer(ids, np.int64), np.frombuffer(th, np.int64)
        for d in np.unique(doc):
            x = doc == d if doc.size < 64 else slice(*np.searchsorted(doc, [d, d + 1]))
            out.append((None if ids[d] == LAST_ID else int(ids[d]), int(th[d]), pack_sorted(s[x] - at[d]), pack_sorted(e[x] - at[d])))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "th", "starts", "ends"])

    return common.spread(found, "batch", size).groupBy("batch").applyInArrow(run, _SPANS)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, th, starts, ends): removal intervals of the documents that have any; rows of equal doc_id and text once."""
    size = common.size_in_bytes(docs)
    spans = intervals(flags(windows_by_bucket(common.keyed(docs), buckets_for(size), window), size), size, window)
    return spans.groupBy("doc_id", "th").agg(F.first("starts").alias("starts"), F.first("ends").alias("ends"))


def removal(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the kept words joined by a space), kept_sha256."""
    d, s = common.keyed(docs), repeated_spans(docs, window)
    both = d.join(s, d.doc_id.eqNullSafe(s.doc_id) & (d.th == s.th), "left").select(d.doc_id, d.text, s.starts, s.ends)

    def run(it):
        for b in it:
            out = []
            for i, t, s, e in zip(b.column("doc_id").to_pylist(), common.texts_of(b.column("text")), b.column("starts").to_pylist(), b.column("ends").to_pylist(), strict=True):
                words = t.split()
                kept, last = [], 0
                for x, y in zip(unpack_sorted(s or b"").tolist(), unpack_sorted(e or b"").tolist(), strict=True):
                    kept += words[last:x]
                    last = y
                kept += words[last:]
                text = b" ".join(kept)
                out.append((i, len(words), len(words) - len(kept), text, hashlib.sha256(text).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()).cast(pa.string()), pa.array(cols[4], pa.string())], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(common.table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLE_SQL = {
    "op10_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM p),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM g) WHERE doc_id > least),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM h),
f AS (SELECT doc_id, list(k) AS ks FROM r GROUP BY doc_id),
k AS (
  SELECT d.doc_id, len(w) AS n, CASE WHEN ks IS NULL THEN w ELSE list_filter(list_transform(range(1, len(w) + 1), lambda j: CASE WHEN list_contains(ks, j) THEN NULL ELSE w[j] END), lambda x: x IS NOT NULL) END AS kept
  FROM d LEFT JOIN f USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
}
