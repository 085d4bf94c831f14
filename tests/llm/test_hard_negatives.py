"""Exact search over inverted lists against all scores."""

import math
import random

import numpy as np
import pytest

from fieldloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, x string"


def usable(rows):
    out = []
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = [math.floor(256 * float(np.float32(c))) for c in v]
        if sum(c * c for c in x) <= hn.UNBOUNDED:
            out.append((i, label, x))
    return out


def brute(rows, every=50, positives=5, negatives=3):
    rows = usable(rows)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for i, label, x in rows:
        if i % every:
            continue
        near = sorted((-dot(x, y), j) for j, other, y in rows if other == label and j != i)[:positives]
        for s, p in near:
            fit = sorted((-dot(x, y), j) for j, other, y in rows if other != label and 50 * -s <= 100 * dot(x, y) <= 95 * -s)[:negatives]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j) in enumerate(fit)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def vectors(seed, n, dims=8, labels=4):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(i, rnd.randrange(labels), [c + rnd.gauss(0, 0.3) for c in rnd.choice(centres)], "x") for i in range(n)]


def test_equals_all_scores(spark, monkeypatch):
    monkeypatch.setattr(hn, "FIRST_VISITS", 1)
    rows = vectors(1, 400)
    same = rows[50][2]
    rows += [(1000 + i, i % 3, same, "x") for i in range(150)]  # one vector many times: ties everywhere
    rows += [(2000, 1, None, "x"), (2050, None, same, "x"), (2100, 1, [1.0, None], "x"), (2150, 1, [float("nan")] * 8, "x"), (2200, 1, [float("inf")] * 8, "x"), (None, 1, same, "x"), (2250, 2, [], "x"), (2300, 3, [0.5, 0.5], "x"), (2350, 0, [1e30] * 8, "x")]
    rows += rows[:60]  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(hn.mine(hn.prepared(df), hn.F.col("vec_id") % 50 == 0)) == brute(rows)


@pytest.mark.parametrize("name,value", [("PIECE_CELLS", 1), ("MOST_LISTS", 3), ("QUERIES_AT_ONCE", 2), ("EXACT", 1.0), ("SAMPLE", 1)])
def test_plans_do_not_change_results(spark, monkeypatch, name, value):
    monkeypatch.setattr(hn, name, value)
    rows = vectors(2, 220)
    assert found(hn.mine(hn.prepared(spark.createDataFrame(rows, SCHEMA)), hn.F.col("vec_id") % 20 == 0)) == brute(rows, 20)


def test_large_components_and_other_numbers(spark):
    rows = [(i, label, [c * 1e6 for c in v], x) for i, label, v, x in vectors(3, 120, 4)]
    assert found(hn.mine(hn.prepared(spark.createDataFrame(rows, SCHEMA)), hn.F.col("vec_id") % 10 == 0, 2, 4)) == brute(rows, 10, 2, 4)


def test_tables_without_answers(spark):
    none = spark.createDataFrame([], SCHEMA)
    mine = lambda df: found(hn.mine(hn.prepared(df), hn.F.col("vec_id") % 50 == 0))
    assert mine(none) == []
    assert mine(spark.createDataFrame([(0, 1, [1.0], "x")], SCHEMA)) == []
    assert mine(spark.createDataFrame([(0, 1, [1.0], "x"), (1, 1, [1.0], "x"), (2, 2, [-1.0], "x")], SCHEMA)) == []


def test_bounds_leave_lists_out(spark):
    """Clusters far apart: a query meets the list it lies in and few others."""
    rows = [(i, i % 2, [20.0 * (i % 8 == k) + random.Random(i).random() / 10 for k in range(8)], "x") for i in range(400)]
    index = hn.Index(hn.prepared(spark.createDataFrame(rows, SCHEMA)))
    queries = index.rows.where("vec_id % 50 = 0").select(hn.F.col("rid").alias("qid"), hn.F.col("rid").alias("gid"), hn.F.col("vec_id").alias("anchor"), "label", "x", hn.F.lit(True).alias("alike"), hn.F.expr("3000000L").alias("low"), hn.F.lit(hn.UNBOUNDED).alias("high"), hn.F.lit(None).cast("long").alias("least"))
    types = "cluster int, piece int, qid long, gid long, anchor long, label long, x array<bigint>, alike boolean, low long, high long, least long"
    met = queries.mapInArrow(index._visits(0, len(index.centres)), types).count()
    assert len(index.centres) > 8 and met < 0.5 * queries.count() * len(index.centres)
