"""Hard negatives of anchors by exact search over k-means inverted lists.

Every row is in the list of its nearest centroid, and each list keeps its radius: the distance of its farthest row.
For a query q, a list with centroid m and radius r holds scores between q.m - |q| r and q.m + |q| r (Cauchy-Schwarz). A
query goes through the lists by their upper bounds, leaves out those that lie outside its window of scores, and stops
when the next upper bound is strictly below the kth score that it has. So the answer is exact, ties included, whatever
the centroids are. A first search finds each anchor's positives, a second one the rows of other labels in each positive's window.

Spark runs the visits in rounds of `FIRST_VISITS` lists, then four times as many and so on: queries meet lists in a shuffle by list and piece,
the best k of each query are kept by a window that Spark limits before it shuffles, and queries that may stop leave.
Lists are dealt into pieces of at most about `PIECE_CELLS` numbers, so a list that holds a third of all rows (one vector copied
many times) is many tasks. Within a task one piece is a matrix, and queries stream past it.

Bounds: the centroids are fitted on about `SAMPLE` rows (Spark's own k-means); every row is indexed. There are at most `MOST_LISTS`
lists and `LIST_CELLS` numbers in all centroids: these are collected, and their radii with them. Queries are the anchors
that the caller names, against all rows; the work grows with their product where bounds discard nothing.

Scores are integers: products of floor(256 * x). They are computed in doubles where all sums are below 2**53, else in
64-bit integers. Cases: rows with a null id, null label, null vector or a component that is null, NaN or infinite take no part, nor do
vectors whose squared length in these integers exceeds 2**62. A shorter vector counts as filled up with zeros. Rows
that are repeated count as often as they occur; a row is other than the anchor if its id is another one. An anchor
without positives, or a positive without negatives in its window, gives no row. Extra columns are ignored; empty tables give
empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm import common

SAMPLE, SAMPLE_TASKS = 50_000, 16
MOST_LISTS = 1024
LIST_CELLS = 1 << 21
PIECE_CELLS = 1 << 20
#: Queries that are scored at once.
QUERIES_AT_ONCE = 256
#: With fewer lists than this, sampled points are the centroids.
FEW = 8
FIRST_VISITS = 8
ITERATIONS = 8
UNBOUNDED = 1 << 62
EXACT = float(1 << 53)


def prepared(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(vec_id, label, x): usable rows with their components as integers."""
    finite = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    square = F.aggregate("x", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    df = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")).dropna()
    return df.where(finite).select("vec_id", "label", F.transform("v", lambda c: F.floor(c * 256)).alias("x")).where(square <= float(UNBOUNDED))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def centroids(rows: DataFrame, n: int, dims: int, seed: int) -> np.ndarray:
    """At most about the square root of n points, from a sample of bounded size."""
    k = max(1, min(MOST_LISTS, math.isqrt(n), LIST_CELLS // dims))
    sample = common.checkpoint(rows.select("x").sample(min(1.0, SAMPLE / n), seed).repartition(SAMPLE_TASKS))
    points = sample.distinct().limit(k + 1).collect()
    if len(points) <= k or k < FEW:  # nothing to fit: these points themselves, or the origin
        return np.array([p.x for p in points[:k]] or [[0] * dims], np.float64)
    features = sample.select(array_to_vector(F.col("x").cast("array<double>")).alias("features"))
    return np.array(KMeans(k=k, maxIter=ITERATIONS, seed=seed).fit(features).clusterCenters())


class Index:
    """The inverted lists: rows (rid, vec_id, label, x, cluster, piece), and centroids, radii and pieces of each list."""

    def __init__(self, rows: DataFrame, seed: int = 42):
        n, dims, top = rows.agg(F.count("*"), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
        self.dims, spark = max(1, dims or 0), rows.sparkSession
        filled = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(self.dims) - F.size("x"))))
        self.exact = self.dims * float(top or 0) ** 2 < EXACT
        self.centres = np.zeros((1, self.dims)) if not n else centroids(filled, n, self.dims, seed)
        assigned = common.checkpoint(filled.mapInArrow(self._nearest(), "vec_id long, label long, x array<bigint>, cluster int, far double"))
        found = {r.cluster: (r.n, r.far) for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
        size = max(64, PIECE_CELLS // self.dims)
        k = len(self.centres)
        self.radii = np.array([found.get(c, (0, 0.0))[1] for c in range(k)])
        self.pieces = np.array([-(-found.get(c, (0, 0))[0] // size) for c in range(k)])
        # As many rows as there are lists: the proven bound of what is broadcast.
        dealt = F.broadcast(spark.createDataFrame([(c, int(p)) for c, p in enumerate(self.pieces.tolist())], "cluster int, pieces int"))
        self.rows = assigned.withColumn("rid", F.monotonically_increasing_id()).join(dealt, "cluster").withColumn("piece", F.pmod("rid", "pieces").cast("int")).drop("pieces", "far")

    def _nearest(self):
        centres, dims = self.centres, self.dims

        def run(it):
            own = (centres**2).sum(1)
            for b in it:
                for c in range(0, b.num_rows, 4096):
                    part = b.slice(c, 4096)
                    x = matrix(part.column("x"), dims).astype(np.float64)
                    near = np.argmin(own - 2 * (x @ centres.T), 1)
                    far = np.sqrt(((x - centres[near]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(far)], ["vec_id", "label", "x", "cluster", "far"])

        return run

    def _visits(self, start: int, stop: int):
        """Queries with the pieces of the lists from place `start` to `stop` of their order."""
        centres, radii, pieces, dims = self.centres, self.radii, self.pieces, self.dims

        def run(it):
            long_centres = np.sqrt((centres**2).sum(1)) + radii
            for b in it:
                for c in range(0, b.num_rows, 1024):
                    part = b.slice(c, 1024)
                    x = matrix(part.column("x"), dims).astype(np.float64)
                    long = np.sqrt((x**2).sum(1))[:, None]
                    middle, reach = x @ centres.T, long * radii
                    reach += 1e-9 * long * long_centres + 1e-6  # rounding never discards
                    low, high, least = (part.column(k).to_numpy(zero_copy_only=False).astype(np.float64)[:, None] for k in ("low", "high", "least"))
                    # Null (no k scores yet) is NaN here.
                    wanted = (pieces > 0) & (middle + reach >= low) & (middle - reach <= high)
                    bound = np.where(wanted, middle + reach, -np.inf)
                    order = np.argsort(-bound, 1, kind="stable")[:, start:stop]
                    bound = np.take_along_axis(bound, order, 1)
                    row, at = np.nonzero((bound > -np.inf) & ~(bound < least))
                    cluster = order[row, at]
                    n = pieces[cluster]
                    piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    row, cluster = np.repeat(row, n), np.repeat(cluster, n)
                    for s in range(0, row.size, 8192):
                        e = slice(s, s + 8192)
                        taken = part.take(pa.array(row[e]))
                        yield pa.RecordBatch.from_arrays([pa.array(cluster[e].astype(np.int32)), pa.array(piece[e].astype(np.int32)), *taken.columns], ["cluster", "piece", *part.schema.names])

        return run

    def _scores(self, k: int):
        """Rows of a piece, then the queries that visit it, to each query's best k of the piece."""
        dims, kind, none = (self.dims, np.float64, -np.inf) if self.exact else (self.dims, np.int64, np.iinfo(np.int64).min)

        def best(q: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            col = lambda name: q.column(name).to_numpy(zero_copy_only=False)
            _, first, back = np.unique(col("gid"), return_index=True, return_inverse=True)
            s = (matrix(q.column("x"), dims)[first].astype(kind) @ own.T)[back]
            alike = labels == col("label")[:, None]
            fit = np.where(col("alike").astype(bool)[:, None], alike & (ids != col("anchor")[:, None]), ~alike)
            least = q.column("least").fill_null(-UNBOUNDED).to_numpy()[:, None]
            s[~(fit & (s >= col("low")[:, None]) & (s <= col("high")[:, None]) & (s >= least))] = none
            at = np.arange(s.shape[0])
            out = []
            for _ in range(k):  # rows are in order of their ids, and the first of equal scores is taken
                top = s.argmax(1)
                score = s[at, top]
                good = score > none
                out.append((col("qid")[good], score[good].astype(np.int64), ids[top[good]]))
                s[at, top] = none
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["qid", "score", "found"])

        def run(it: Iterator[pa.RecordBatch]):
            held, parts, ready = None, [], None
            for b in it:
                key = np.stack([b.column(c).to_numpy() for c in ("cluster", "piece", "query")]) if b.num_rows else np.zeros((3, 0))
                edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
                for s, e in zip([0, *edges], [*edges, b.num_rows], strict=True):
                    if s == e:
                        continue
                    part, here = b.slice(s, e - s), tuple(key[:2, s])
                    if here != held:
                        held, parts, ready = here, [], None
                    if not key[2, s]:
                        parts.append(part)
                        continue
                    if not parts:
                        continue
                    if ready is None:
                        ids = np.concatenate([p.column("anchor").to_numpy() for p in parts])
                        order = np.argsort(ids, kind="stable")
                        ready = ids[order], np.concatenate([p.column("label").to_numpy() for p in parts])[order], np.concatenate([matrix(p.column("x"), dims) for p in parts])[order].astype(kind)
                    for c in range(0, part.num_rows, QUERIES_AT_ONCE):
                        yield best(part.slice(c, QUERIES_AT_ONCE), *ready)

        return run

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, score, found): the best k rows of each query, higher scores and then smaller ids first.

        queries(qid, gid, anchor, label, x, alike, low, high) is checkpointed: rows of the label (alike) but the anchor, or of other
        labels, with low <= score <= high. Queries of one gid have one x.
        """
        names = ["gid", "anchor", "label", "x", "alike", "low", "high"]
        types = "cluster int, piece int, qid long, gid long, anchor long, label long, x array<bigint>, alike boolean, low long, high long, least long"
        none = lambda c, t: F.lit(None).cast(t).alias(c)
        listed = self.rows.select("cluster", "piece", none("qid", "long"), none("gid", "long"), F.col("vec_id").alias("anchor"), "label", "x", none("alike", "boolean"), *(none(c, "long") for c in ("low", "high", "least")), F.lit(0).alias("query"))
        first = Window.partitionBy("qid").orderBy(F.desc("score"), "found")
        best, start, more = None, 0, FIRST_VISITS
        while start < len(self.centres):
            if best is None:
                active = queries.select("qid", *names, none("least", "long"))
            else:
                full = best.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("score"))
                active = queries.join(full, "qid", "left").select("qid", *names, F.when(F.col("n") == k, F.col("score")).alias("least"))
            visits = active.mapInArrow(self._visits(start, start + more), types)
            if best is not None and visits.isEmpty():
                break
            both = listed.unionByName(visits.withColumn("query", F.lit(1)))
            met = both.repartition("cluster", "piece").sortWithinPartitions("cluster", "piece", "query", "gid")
            found = met.mapInArrow(self._scores(k), "qid long, score long, found long")
            every = found if best is None else best.unionByName(found)
            best = common.checkpoint(every.withColumn("k", F.row_number().over(first)).where(F.col("k") <= k).drop("k"))
            start, more = start + more, 4 * more
        return best


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, seed: int = 42) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows(vec_id, label, x) as prepared() gives them.

    Negatives have other labels and low * positive_score <= 100 * negative_score <= high * positive_score; is_anchor speaks of vec_id.
    """
    index = Index(rows, seed)
    bound = lambda v: F.lit(v).cast("long")
    anchors = common.checkpoint(index.rows.where(is_anchor).select(F.col("rid").alias("qid"), F.col("rid").alias("gid"), F.col("vec_id").alias("anchor"), "label", "x", F.lit(True).alias("alike"), bound(-UNBOUNDED).alias("low"), bound(UNBOUNDED).alias("high")))
    found = index.search(anchors, positives)
    # Of a positive score p: the least integer at or over low * p / 100, and the greatest at or under high * p / 100, without a product that overflows.
    p = F.col("positive_score")
    part = lambda of, up: F.expr(f"positive_score div 100 * {of} + (positive_score % 100 * {of} + {up}) div 100")
    pairs = found.select(F.col("qid").alias("gid"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")).where(p >= 0)
    pairs = pairs.join(anchors.select("gid", "anchor", "label", "x"), "gid").withColumns({"low": part(low, 99), "high": part(high, 0), "alike": F.lit(False)})
    pairs = common.checkpoint(pairs.withColumn("qid", F.monotonically_increasing_id()))
    hits = index.search(pairs, negatives)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "found"))
    out = hits.withColumn("rank", rank).join(pairs.select("qid", "anchor", "positive_id", "positive_score"), "qid")
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return mine(prepared(rows), F.col("vec_id") % 50 == 0)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLE_SQL = {
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS alike, CAST(list_sum(list_transform(list_zip(a.x, r.x), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v a, v r WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE alike AND other <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
}
