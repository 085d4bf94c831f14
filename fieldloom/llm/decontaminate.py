"""Benchmark decontamination by winnowing.

A window is `span` consecutive words of a benchmark item (an item of fewer words is one window). A
document word inside any occurrence of a window is hit. Both sides are fingerprinted alike: of every
run of `span - gram + 1` consecutive gram hashes, which is `span` words, the least is kept. Equal
runs keep equal hashes, so every shared span of `span` words or more meets in a kept fingerprint.
A shorter item is fingerprinted by the one gram it is.

1. The benchmark becomes a table of different windows (words, kept hash, items).
2. Documents' kept hashes are matched with the benchmark's. The benchmark's different hashes are broadcast
   if they are at most `block`, which is counted (8 bytes each); else they are joined by hash, and the documents with a
   hash in common are read again. Each hash that meets is extended to the `span` words around it: these are a document's
   candidates, equal ones once with all their places.
3. Candidates are joined with the windows by hash and words, word by word equal. Windows that more than a 1024th of
   the candidates are go by broadcast (fewer than 1024), the rest by key.
4. Places and items of each document are gathered and joined to the documents' word counts.

Only candidates, word counts and keys are shuffled, no texts.

Cases: null and empty texts have no words and no hits; null item texts and items without a word have
no window; a null item_id is left out of the item lists but its windows count; repeated items count
once each item_id; repeated documents get equal rows; texts are read whole; extra columns are
ignored by report and returned by clean.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import common

SPAN, GRAM = 10, 5
#: Different hashes of the benchmark that may be broadcast, and keys of contaminated documents: 8 and 16 bytes each.
BLOCK = 1 << 21
CHUNK_BYTES = 1 << 20
#: Rows that leave a task at once.
OUT_ROWS = 1 << 15
LAST_ID = np.iinfo(np.int64).max
#: Fixed: the bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_WINDOW = ["m", "print", "words"]


def words_of(text: bytes) -> list[bytes]:
    return _WORDS.findall(text.lower())  # bytes.lower() changes A-Z only


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: out.size - step], out[step:])
        have += step
    return out


def kept_hashes(h: np.ndarray, m: int) -> np.ndarray:
    """For every run of m word hashes the gram hash that winnowing keeps; for fewer than SPAN words, the run's own."""
    if h.size < m:
        return np.zeros(0, np.uint64)
    gram = GRAM if m == SPAN else m
    j = np.arange(h.size - gram + 1)
    return least(common.mix(common.WORDS_1.spans(h, j, j + gram)), m - gram + 1)


def windows(benchmark: DataFrame) -> DataFrame:
    """(m, print, words, items): the different windows, of m words each."""

    def run(it):
        for t in common.batches(it, CHUNK_BYTES):
            texts = common.texts_of(t.column("text"))
            h, _, counts = common.word_hashes(texts, WORD_BYTES, common.LOWER, both=False)
            at = np.cumsum(counts) - counts
            for item, text, a, n in zip(t.column("item").to_pylist(), texts, at.tolist(), counts.tolist(), strict=True):
                m, w = min(SPAN, n), words_of(text)
                prints = kept_hashes(h[a : a + n], m).view(np.int64) if m else ()
                for i in range(0, len(prints), OUT_ROWS):
                    own = prints[i : i + OUT_ROWS]
                    cols = [pa.array([item] * len(own), pa.string()), pa.array([m] * len(own), pa.int32()), pa.array(own), pa.array([b" ".join(w[k : k + m]) for k in range(i, i + len(own))], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["item", *_WINDOW])

    rows = common.map_texts(benchmark.select(F.col("item_id").cast("string").alias("item"), "text"), run, "item string, m int, print long, words binary")
    return common.checkpoint(rows.groupBy(*_WINDOW).agg(F.collect_set("item").alias("items")))


def _keyed(docs: DataFrame) -> DataFrame:
    return common.keyed(docs).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), "th", "text")


def _prints_of(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, th, m, print): every document's kept hashes, each once."""

    def run(it):
        for t in common.batches(it, CHUNK_BYTES):
            h, _, counts = common.word_hashes(common.texts_of(t.column("text")), WORD_BYTES, common.LOWER, both=False)
            ends = np.cumsum(counts)
            for m in lengths:
                low = kept_hashes(h, m)
                i = np.flatnonzero(np.arange(low.size) + m <= np.repeat(ends, counts)[: low.size])
                doc, low = np.searchsorted(ends, i, "right"), low[i].view(np.int64)
                by = np.lexsort((low, doc))
                one = by[np.concatenate([[True], (np.diff(doc[by]) != 0) | (np.diff(low[by]) != 0)])[: by.size]]
                for x in np.split(one, range(OUT_ROWS, one.size, OUT_ROWS)):
                    row = pa.array(doc[x])
                    yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().take(row) for c in ("doc_id", "th")] + [pa.array(np.full(x.size, m, np.int32)), pa.array(low[x])], ["doc_id", "th", "m", "print"])

    return common.map_texts(_keyed(docs), run, "doc_id long, th long, m int, print long")


def candidates(docs: DataFrame, table: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each document, with n_words, and one for each window of it (m, print, words, places) whose kept hash the table has."""
    prints = common.checkpoint(table.select("m", "print").distinct())
    lengths = sorted(r["m"] for r in prints.select("m").distinct().collect())  # SPAN at most
    if prints.count() <= block:
        found = prints.toPandas()
        sent = docs.sparkSession.sparkContext.broadcast({m: np.sort(found["print"][found["m"] == m].to_numpy(np.int64).view(np.uint64)) for m in lengths})
        own = _keyed(docs).withColumn("prints", F.lit(None).cast("array<struct<m:int,print:bigint>>"))
    else:
        sent = None
        met = _prints_of(docs, lengths).distinct().join(prints, ["m", "print"], "left_semi")
        met = met.groupBy("doc_id", "th").agg(F.collect_list(F.struct("m", "print")).alias("prints"))
        own = _keyed(docs).join(met, ["doc_id", "th"], "left").withColumn("prints", F.coalesce("prints", F.array().cast("array<struct<m:int,print:bigint>>")))

    def marked(keys):
        marks = np.zeros(1 << max(16, int(keys.size).bit_length() + 5), bool)
        marks[(keys & np.uint64(marks.size - 1)).astype(np.int64)] = True
        return marks

    def table_of(batch):
        """The hashes looked for among a batch's documents: a superset of each document's is enough."""
        if sent is not None:
            return sent.value
        flat = {}
        for row in batch.column("prints").to_pylist():
            for x in row:
                flat.setdefault(x["m"], set()).add(x["print"])
        return {m: np.sort(np.fromiter(v, np.int64, len(v)).view(np.uint64)) for m, v in flat.items()}

    names = ["doc_id", "th", "n_words", *_WINDOW, "places"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def rows_of(t, texts, h, counts, marks):
        at = np.concatenate([[0], np.cumsum(counts)])
        ids, th = t.column("doc_id").to_pylist(), t.column("th").to_pylist()
        for d, n in enumerate(counts.tolist()):
            yield ids[d], th[d], n, None, None, None, None
        looked_for = table_of(t)
        if sent is None:
            marks = {m: marked(keys) for m, keys in looked_for.items()}
        ends = np.repeat(at[1:], counts)
        for m, keys in looked_for.items():
            low = kept_hashes(h, m)
            i = np.flatnonzero(marks[m][(low & np.uint64(marks[m].size - 1)).astype(np.int64)])
            i = i[i + m <= ends[i]]
            i = i[keys[np.minimum(np.searchsorted(keys, low[i]), keys.size - 1)] == low[i]]
            doc = np.searchsorted(at, i, "right") - 1
            for x in common.split_by(doc, i):
                d = int(np.searchsorted(at, x[0], "right") - 1)
                w, places = words_of(texts[d]), {}
                for k, p in zip((x - at[d]).tolist(), low[x].view(np.int64).tolist(), strict=True):
                    places.setdefault((p, b" ".join(w[k : k + m])), []).append(k)
                for (p, window), where in places.items():
                    yield ids[d], th[d], None, m, p, window, common.pack_sorted(np.array(where))

    def run(it):
        marks = {m: marked(keys) for m, keys in sent.value.items()} if sent is not None else None
        for t in common.batches(it, CHUNK_BYTES):
            texts = common.texts_of(t.column("text"))
            h, _, counts = common.word_hashes(texts, WORD_BYTES, common.LOWER, both=False)
            out = []
            for r in rows_of(t, texts, h, counts, marks):
                out.append(r)
                if len(out) == OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return common.map_texts(own, run, "doc_id long, th long, n_words long, m int, print long, words binary, places binary")


def verified(found: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, th, m, places, items): the candidates that are windows, by their very words."""
    own = found.where("m IS NOT NULL").drop("n_words").distinct()
    met = common.checkpoint(own.groupBy(*_WINDOW).agg(F.count("*").alias("n")).join(table, _WINDOW))
    return common.split_join(own, met, _WINDOW).select("doc_id", "th", "m", "places", "items")


def hits(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, hit (array of (m, packed places) of windows) and items, in order; both null without a hit."""
    table = windows(benchmark)
    found = common.checkpoint(candidates(docs, table, block))
    own = verified(found, table).groupBy("doc_id", "th").agg(F.collect_list(F.struct("m", "places")).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    rows = found.where("m IS NULL").select("doc_id", "th", "n_words").join(own, ["doc_id", "th"], "left")
    return rows.select(F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")).alias("doc_id"), "n_words", "hit", "items")


def clean(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs without a hit, with all their columns."""
    table = windows(benchmark)
    found = common.checkpoint(candidates(docs, table, block).where("m IS NOT NULL"))
    gone = common.checkpoint(verified(found, table).select(F.struct("doc_id", "th").alias("key")).distinct())
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.xxhash64("text").alias("th"))
    rows = docs.select(key.alias("key"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    return rows.join(F.broadcast(gone) if gone.count() <= block else gone, "key", "left_anti").select("row.*")


def report(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""

    def run(it):
        for b in it:
            n_hit = []
            for n, hit in zip(b.column("n_words").to_pylist(), b.column("hit").to_pylist(), strict=True):
                if hit:
                    places = [common.unpack_sorted(x["places"]) for x in hit]
                    ends = [p + x["m"] for p, x in zip(places, hit, strict=True)]
                    n_hit.append(int(common.covered(n, np.concatenate(places), np.concatenate(ends)).sum()))
                else:
                    n_hit.append(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(n_hit, pa.int64()), b.column("items")], ["doc_id", "n_words", "n_hit", "items"])

    rows = hits(docs, benchmark, block).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    rows = rows.mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<string>")
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return report(docs, common.table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE_SQL = {
    "op4_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT item, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
h AS (SELECT doc_id, item, i, m FROM dw JOIN bw USING (m, g)),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN x USING (doc_id)
"""
}
