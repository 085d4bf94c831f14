"""Line dedup: a suffix array over line-ID sequences, by distributed prefix doubling.

A document is its sequence of lines that have a word; a line's ID is 64 bits of its bytes (among n
different lines some n * n / 2**65 pairs may share one). A run of lines with `min_words` words or more
that also stands earlier (in a document of smaller doc_id, or before it in the same document) is deleted, so every
later copy of a maximal repeated run goes whole. Such a run is a union of least runs in it: from a line on, or back from
a line, as few lines as have `min_words` words. (A line from which too few words are left before the run's end is in the
one back from that end.) So only least runs are looked up, and they decide as all runs would.

Ranks order the suffixes by their first 2**h lines: at h = 0 the repeated line IDs in order, then the
pairs of ranks (at i, at i + 2**h) in order. Only suffixes whose prefix occurs twice stay (the others'
place is final). A least run of n lines is a longest-common-prefix interval of depth n: equal ranks at
its start and at 2**h lines before its end, for the h with 2**h <= n < 2**(h + 1). The earliest of each
interval stays; the lines of the later ones go. Doubling ends with the longest least run, which has
at most `min_words` lines.

Ranks are made of distinct pairs, counted by partial aggregation, and joined back by equality; pairs and runs
with more than a 1024th of all rows are joined by broadcast (fewer than 1024 rows), so a line or run that a third of
all documents have is dealt to no single task.

Cases: null and empty texts have no lines and stay as they are; lines without a word are never deleted
and do not part runs; a null doc_id counts as the largest; rows of equal doc_id and text are one document
and get equal results; extra columns are returned, but those named like an output (kept, n_lines, n_removed, n_runs)
give way to it; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm import common

MIN_WORDS = 10
CHUNK_BYTES = 1 << 20
LAST_ID = np.iinfo(np.int64).max
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[10] = False
DOC = ["doc_id", "th"]


def least_runs(words: np.ndarray, docs: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first line, lines) of the least runs; words of each line, and docs the documents' first lines with one more for the end."""
    n = words.size
    total = np.concatenate([[0], np.cumsum(words)])
    first, last = np.repeat(docs[:-1], np.diff(docs)), np.repeat(docs[1:], np.diff(docs))
    reach = np.searchsorted(total, total[:-1] + min_words)
    i = np.flatnonzero(reach <= last)
    back = np.searchsorted(total, total[1:] - min_words, "right") - 1
    j = np.flatnonzero(back >= first)
    runs = np.unique(np.concatenate([i * (n + 1) + reach[i] - i, back[j] * (n + 1) + j + 1 - back[j]]))
    return runs // (n + 1), runs % (n + 1)


def line_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, pos, line, needs): every line with a word, and how many lines the least runs have that begin with it."""

    def run(it):
        for t in common.batches(it, CHUNK_BYTES):
            buf, at = common.joined(common.texts_of(t.column("text")))
            s, e = common.word_spans(buf, NOT_NEWLINE)
            words = common.word_spans(buf, common.NOT_SPACE)[0]
            n = np.searchsorted(words, e) - np.searchsorted(words, s)
            s, e, n = s[n > 0], e[n > 0], n[n > 0]
            line = common.mix(common.BYTES_1.spans(buf.astype(np.uint64) + np.uint64(1), s, e)).view(np.int64)
            cut = np.searchsorted(s, at)
            first, need = least_runs(n, cut, min_words)
            needs = pa.ListArray.from_arrays(pa.array(np.searchsorted(first, np.arange(n.size + 1)), pa.int32()), pa.array(need, pa.int32()))
            offsets = pa.array(cut, pa.int32())
            cols = [pa.ListArray.from_arrays(offsets, pa.array(line)), pa.ListArray.from_arrays(offsets, needs)]
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks().fill_null(LAST_ID), t.column("th").combine_chunks(), *cols], ["doc_id", "th", "lines", "needs"])

    rows = common.map_texts(common.keyed(docs), run, "doc_id long, th long, lines array<bigint>, needs array<array<int>>")
    rows = rows.select(*DOC, F.posexplode(F.arrays_zip("lines", "needs")).alias("pos", "x"))
    return rows.select(*DOC, "pos", F.col("x.lines").alias("line"), F.col("x.needs").alias("needs"))


def _ranked(keys: DataFrame, *by: str) -> DataFrame:
    """Distinct keys that occur twice, their number, and a rank that rises in their order."""
    twice = keys.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    return common.checkpoint(twice.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()))


def _later(level: DataFrame, h: int) -> DataFrame:
    """(doc_id, th, pos, need) of the least runs of 2**h to 2**(h + 1) - 1 lines that stand earlier too."""
    mine = level.select(*DOC, "pos", "rank", F.explode(F.filter("needs", lambda x: (x >= 2**h) & (x < 2 ** (h + 1)))).alias("need"))
    if h:
        ends = level.select(*DOC, (F.col("pos") + 2**h).alias("end"), F.col("rank").alias("rank2"))
        mine = common.checkpoint(mine.withColumn("end", F.col("pos") + F.col("need")).join(ends, [*DOC, "end"]).drop("end"))
    else:
        mine = mine.withColumn("rank2", F.col("rank"))
    place, run = F.struct("doc_id", "th", "pos"), ["need", "rank", "rank2"]
    first = common.checkpoint(mine.groupBy(run).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    return common.split_join(mine, first, run).where(place != F.col("first")).select(*DOC, "pos", "need")


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, runs array<struct<pos, need>>): what to delete, in lines with a word."""
    lines = common.checkpoint(line_runs(docs, min_words))
    level = common.split_join(lines, _ranked(lines, "line"), ["line"]).select(*DOC, "pos", "needs", "rank").distinct()
    level, found = common.checkpoint(level), []
    longest, h = level.agg(F.max(F.array_max("needs"))).first()[0] or 0, 0
    while True:
        found.append(_later(level, h))
        if 2 ** (h + 1) > longest:
            break
        next_ = level.select(*DOC, (F.col("pos") - 2**h).alias("pos"), F.col("rank").alias("rank2"))
        pairs = common.checkpoint(level.withColumnRenamed("rank", "rank1").join(next_, [*DOC, "pos"]))
        level = common.checkpoint(common.split_join(pairs, _ranked(pairs, "rank1", "rank2"), ["rank1", "rank2"]).select(*DOC, "pos", "needs", "rank"))
        h += 1
    rows = found[0]
    for x in found[1:]:
        rows = rows.unionByName(x)
    return rows.groupBy(*DOC).agg(F.collect_list(F.struct("pos", "need")).alias("runs"))


OUTPUTS = ["kept", "n_lines", "n_removed", "n_runs"]


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with kept (the text without the deleted lines), n_lines, n_removed and n_runs (maximal deleted runs)."""
    gone = deletions(docs, min_words).select(F.struct("doc_id", "th").alias("key"), "runs")
    docs = docs.drop(*OUTPUTS)
    names = docs.columns
    # The documents' columns go as one, so that no name of theirs can be one of ours.
    own = docs.select(F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.xxhash64("text").alias("th")).alias("key"), F.struct(*(docs[c] for c in names)).alias("row"), F.col("text"))
    both = own.join(gone, "key", "left").select("row", "text", "runs")

    def run(it):
        for b in common.batches(it, CHUNK_BYTES):
            kept, figures = [], []
            for t, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                lines = t.split("\n") if t is not None else []
                real = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
                if runs:
                    x = np.array([(r["pos"], r["pos"] + r["need"]) for r in runs])
                    cover = common.covered(len(real), x[:, 0], x[:, 1])
                    out = {real[i] for i in np.flatnonzero(cover).tolist()}
                    kept.append("\n".join(x for i, x in enumerate(lines) if i not in out))
                    figures.append((len(real), int(cover.sum()), len(common.runs(cover)[0])))
                else:
                    kept.append(t)
                    figures.append((len(real), 0, 0))
            more = list(zip(*figures, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column("row").combine_chunks(), pa.array(kept, pa.string()), *(pa.array(x, pa.int64()) for x in more)], ["row", *OUTPUTS])

    schema = T.StructType([T.StructField("row", both.schema["row"].dataType)]).add("kept", "string").add("n_lines", "long").add("n_removed", "long").add("n_runs", "long")
    return common.map_texts(both, run, schema).select("row.*", *OUTPUTS)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLE_SQL = {
    "op2_line_dedup": r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
a AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
w AS (SELECT *, CAST(len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM w WHERE n > 0),
d AS (SELECT doc_id, list(line ORDER BY pos) AS lines, list(upto ORDER BY pos) AS sums FROM r GROUP BY doc_id),
e AS (SELECT doc_id, pos, lines, list_filter(range(pos, least(pos + 10, len(lines) + 1)), lambda j: sums[j] - upto + n >= 10)[1] AS last FROM r JOIN d USING (doc_id)),
b AS (SELECT doc_id, list_filter(range(greatest(1, pos - 9), pos + 1), lambda j: upto - coalesce(sums[j - 1], 0) >= 10)[-1] AS pos, lines, pos AS last FROM r JOIN d USING (doc_id)),
g AS (SELECT DISTINCT doc_id, pos, last, array_to_string(lines[pos:last], chr(10)) AS run FROM (SELECT * FROM e UNION ALL SELECT * FROM b) WHERE pos IS NOT NULL AND last IS NOT NULL),
f AS (SELECT doc_id, pos, last FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS k FROM g) WHERE k > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS pos FROM f),
k AS (SELECT w.doc_id, w.i, w.line, x.pos IS NOT NULL AS gone, r.pos AS p FROM w LEFT JOIN r USING (doc_id, i) LEFT JOIN x ON x.doc_id = w.doc_id AND x.pos = r.pos)
SELECT doc_id, count(p) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM k GROUP BY doc_id
"""
}
