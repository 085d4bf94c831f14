import hashlib
import random

import numpy as np

from fieldloom.llm import suffix_dedup as sd


def brute(rows, n=200):
    count = {}
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            count[b[i : i + n]] = count.get(b[i : i + n], 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, *limits):
    df = sd.common.checkpoint(spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", sd.F.lit("x")).repartition(3))
    assert sorted((tuple(r) for r in sd.removal(df, *limits).drop("kept").collect()), key=str) == brute(rows)


def make(seed, n, hot=False):
    rnd = random.Random(seed)
    letters = "abcdefgh é\n"
    text = lambda k: "".join(rnd.choice(letters) for _ in range(k))
    pool = [text(rnd.randint(100, 700)) for _ in range(8)]
    rows = []
    for i in range(n):
        p = pool[0] if hot else rnd.choice(pool)
        a = rnd.randint(0, 40)
        rows.append((i, text(rnd.randint(0, 120)) + p[a : a + rnd.randint(150, 420)] + text(rnd.randint(0, 60)) + (rnd.choice(pool) if rnd.random() < 0.3 else "")))
    rows += [(n + k, rows[k][1]) for k in range(n // 5)]
    for k in range(n // 5):
        b = list(rows[-k - 1][1])
        if b:
            b[rnd.randint(0, len(b) - 1)] = "#"
        rows.append((2 * n + k, "".join(b)))
    return rows


def test_random(spark):
    check(spark, make(1, 80))


def test_hot_anchors(spark):
    check(spark, make(2, 80, hot=True), 3, 4)


def test_edges(spark):
    a = "".join(random.Random(5).choice("abcdefghijkl ") for _ in range(199))
    check(spark, [(1, None), (2, ""), (3, a), (3, a), (4, a + "x"), (5, a + "x"), (5, a + "x"), (6, "z" * 1000), (7, "z" * 200), (None, "ab" * 300), (8, "é" * 150), (9, a + "\x00" + a)])
    assert sd.removal(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    check(spark, [(1, "long " + "q" * 30_000)])


def test_suffix_array_and_prefixes():
    rnd = random.Random(3)
    for n, alphabet in ((1, "a"), (50, "ab"), (400, "ab"), (600, "abc\0"), (300, "a")):
        b = "".join(rnd.choice(alphabet) for _ in range(n)).encode()
        order, _ = sd.suffix_array(np.frombuffer(b, np.uint8), 4096)
        assert order.tolist() == sorted(range(n), key=lambda i: b[i:])
        lcp = sd.common_prefixes(np.frombuffer(b, np.uint8), order, 90)
        for j in range(1, n):
            x, y = b[order[j - 1] :], b[order[j] :]
            want = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            assert lcp[j] == min(want, 90)


def test_classes_of_passages_repeated_over_256_bytes():
    for seed in range(40):
        rnd = random.Random(seed)
        text = lambda k: bytes(rnd.choice(b"ab") for _ in range(k))
        p = text(320)
        texts = [text(rnd.randint(0, 30)) + p[a : a + rnd.randint(256, 300)] + text(30) for a in (rnd.randint(0, 20) for _ in range(4))] + [text(260)]
        seg, start, cls, _, _ = sd.classes(texts, np.array([len(t) - 199 for t in texts]))
        strings = [texts[g][k : k + 200] for g, k in zip(seg, start)]
        assert len(set(zip(strings, cls.tolist()))) == len(set(strings)) == len(set(cls.tolist()))


def test_segments_listed_by_different_repeated_rows(spark, monkeypatch):
    """One row for each segment to be decided, as when repeated rows lie in different batches."""
    whole = sd.gather

    def split(codes, size):
        def run(it):
            for b in it:
                out = []
                for r in b.to_pylist():
                    cols = [sd.unpack(x) for x in sd._split(r["fine"], 5)] if r["fine"] else []
                    one = [sd._join([sd.pack(c[k : k + 1]) for c in cols]) for k in range(len(cols[0]))] if cols else [None]
                    out += [(r["doc_id"], r["th"], r["starts"], r["ends"], f) for f in one]
                yield sd._table(out, sd._FOUND)

        return whole(codes, size).mapInArrow(run, sd._FOUND)

    monkeypatch.setattr(sd, "gather", split)
    check(spark, make(7, 40))


def test_repeated_rows_of_hot_anchors_in_different_batches(spark):
    rnd = random.Random(4)
    text = lambda k: "".join(rnd.choice("abcdefgh ") for _ in range(k))
    pool = [text(195) for _ in range(10)]
    rows = [(i, "".join(p + text(5) for p in pool)) for i in range(41)]
    parts = [rows, [rows[7], (100, rows[9][1][:300])], [(None, rows[3][1]), (None, rows[3][1])]]
    df = sd.common.checkpoint(spark.createDataFrame(spark.sparkContext.parallelize(parts, 3).flatMap(list), "doc_id long, text string"))
    assert df.rdd.getNumPartitions() == 3
    want = brute([r for p in parts for r in p])
    for limits in ((), (3, 4), (3, 1000)):
        assert sorted((tuple(r) for r in sd.removal(df, *limits).drop("kept").collect()), key=str) == want
