import hashlib
import random
import re

import pytest

from fieldloom.llm import substring_dedup as sd


def brute(rows, n=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    inf = float("inf")
    least = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            least[g] = min(least.get(g, inf), inf if i is None else i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - n + 1):
            if (inf if i is None else i) > least[tuple(w[k : k + n])]:
                gone |= set(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", sd.F.lit("x")).repartition(3)
    df = sd.common.checkpoint(df)
    got = sorted((tuple(r) for r in sd.removal(df).drop("kept").collect()), key=str)
    assert got == brute(rows)


def test_random_texts(spark):
    rnd = random.Random(3)
    passages = [" ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(13, 40))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [" ".join(rnd.choice(["x", "y", "zz", "é", "w%d" % rnd.randint(0, 50)]) for _ in range(rnd.randint(0, 30))) for _ in range(3)]
        parts.insert(rnd.randint(0, 3), rnd.choice(passages))
        rows.append((rnd.randint(0, 90), rnd.choice([" ", "\n", "\t "]).join(parts)))
    check(spark, rows)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    a = " ".join("abcdefghijklmnop")
    check(spark, [(1, None), (2, ""), (3, a), (3, a), (3, a + " q"), (4, " " + a + "\n"), (5, "z " * 60), (6, "z " * 13), (7, long), (8, long + " end"), (None, a), (9, "a b"), (10, a + "   " + a)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sd.removal(empty).count() == 0


def test_buckets_grow_without_an_end():
    sizes = [1 << k for k in range(20, 48)]
    buckets = [sd.buckets_for(s) for s in sizes]
    assert buckets == sorted(buckets)
    assert all(s / b <= sd.WIDEST_BUCKET for s, b in zip(sizes, buckets))
    assert sd.batch_bytes(64) == sd.BATCH_BYTES and sd.batch_bytes(1 << 21) == sd.WIDEST_BATCH


def test_more_buckets_than_16_bits(spark, monkeypatch):
    monkeypatch.setattr(sd, "buckets_for", lambda size: 100_000)
    a = " ".join("abcdefghijklmnopqrst")
    check(spark, [(k, " ".join(f"{k}w{i}" for i in range(40)) + " " + a) for k in range(20)] + [(30, a)])
