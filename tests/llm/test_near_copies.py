import random

import numpy as np

import corpus_pipeline as cp
from fieldloom.llm import near_copies as nc


def shingles(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def kept(rows):
    """Brute force: the least (doc_id, null last) of each component."""
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    best = {}
    for r, (i, _, _) in zip(root, rows):
        best[r] = min(best.get(r, (True, 0)), (i is None, i or 0)) if r in best else (i is None, i or 0)
    return sorted((None if null else i for null, i in best.values()), key=str)


def make(seed, groups):
    rnd = random.Random(seed)
    rows = []
    for g in range(groups):
        w = [f"w{rnd.randint(0, 900)}" for _ in range(rnd.choice([30, 120, 400]))]
        for _ in range(rnd.randint(1, 6)):
            x = list(w)
            for _ in range(rnd.randint(0, len(w) // 40 + 1)):
                x[rnd.randrange(len(x))] = f"z{rnd.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(x), "s"))
    return rows


def check(spark, rows, *chunk):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = nc.keep_one(df, *chunk)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == kept(rows)


def test_similar_texts_by_brute_force(spark):
    rows = make(1, 25)
    check(spark, rows)
    check(spark, rows, 2)


def test_stage_takes_copies_beyond_three_bits(spark):
    rnd = random.Random(6)
    w = [f"w{rnd.randint(0, 900)}" for _ in range(300)]
    copy = list(w)
    for i in (20, 90, 160, 230):
        copy[i] = "changed"
    rows = [(1, " ".join(w), "s"), (2, " ".join(copy), "s")]
    a, b = (nc.shingle_set(t.encode()) for _, t, _ in rows)
    assert 0.8 <= np.intersect1d(a, b).size / np.union1d(a, b).size < 1
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [r.doc_id for r in cp.keep_one_of_near_copies(spark, df, "").collect()] == [1]


def test_null_ids_and_repeated_rows(spark):
    far = ["alpha beta gamma delta eps zeta", "one two three four five six seven", "a b c d e f g h"]
    rows = [(None, far[0], "s"), (5, far[1], "s"), (5, far[1], "t"), (5, far[2], "s"), (None, far[2], "s"), (7, None, "s"), (8, " ", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.text) for r in cp.keep_one_of_near_copies(spark, df, "").collect()), key=str)
    assert got == sorted([(None, far[0]), (5, far[1]), (5, far[2]), (7, None)], key=str)
    assert cp.keep_one_of_near_copies(spark, df.limit(0), "").count() == 0


def test_stage_takes_fingerprints_within_three_bits(spark):
    """Texts of one repeated run of words in other numbers: their sets of five-word shingles are alike below 0.8, their fingerprints are one."""
    words = "a b c d e f g h i j k l".split()
    one, two = " ".join(words * 40), " ".join([*"x1 x2 x3 x4 x5 x6".split(), *words * 40])
    a, b = (nc.shingle_set(t.encode()) for t in (one, two))
    assert np.intersect1d(a, b).size / np.union1d(a, b).size < 0.8
    fps = nc.simhash.fingerprints_of([one.encode(), two.encode()])
    assert int(fps[0] ^ fps[1]).bit_count() <= 3
    df = spark.createDataFrame([(1, one, "s"), (2, two, "s")], "doc_id long, text string, source string")
    assert [r.doc_id for r in nc.keep_one(df).collect()] != [1]
    assert [r.doc_id for r in cp.keep_one_of_near_copies(spark, df, "").collect()] == [1]
