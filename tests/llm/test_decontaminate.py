import hashlib
import random
import re

from fieldloom.llm import decontaminate as dc

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench):
    out = []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for item, b in bench:
            v = words(b)
            m = min(10, len(v))
            for k in range(len(v) - m + 1 if m else 0):
                for j in range(len(w) - m + 1):
                    if w[j : j + m] == v[k : k + m]:
                        hit |= set(range(j, j + m))
                        items |= set() if item is None else {str(item)}
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, bench, block=dc.BLOCK):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", dc.F.lit(1))
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("hit", dc.F.lit(1))
    assert sorted(map(tuple, dc.report(d, b, block).collect()), key=str) == brute(docs, bench)


def test_random(spark):
    rnd = random.Random(5)
    bench = [(i, " ".join(rnd.choice("abcd") for _ in range(rnd.choice([1, 4, 9, 10, 11, 14, 30])) )) for i in range(12)]
    bench += [(50 + i, " ".join(f"q{rnd.randint(0, 40)}" for _ in range(25))) for i in range(5)]
    docs = []
    for i in range(60):
        w = [f"Q{rnd.randint(0, 40)}" for _ in range(40)]
        v = words(rnd.choice(bench)[1])
        k = rnd.randint(0, max(0, len(v) - 12))
        docs.append((i, ", ".join(w[:20] + v[k : k + rnd.randint(8, 14)] + w[20:])))
    check(spark, docs, bench)
    check(spark, docs, bench, block=60)


def test_edges(spark):
    ten = "one Two three four five six seven eight nine tén"
    bench = [(1, ten), (1, ten), (2, None), (3, ""), (4, "..."), (None, "lone words here"), (10, "x " * 30)]
    docs = [(1, None), (2, ""), (3, ten.upper().replace("É", "é")), (3, ten), (4, "a " + ten + " b " + ten), (5, "x " * 5000), (None, "Lone-words/HERE"), (6, ten[:-4])]
    check(spark, docs, bench)
    check(spark, docs, [])
    check(spark, docs, [(3, None)])
    assert dc.report(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).count() == 0


def test_clean_keeps_all_columns(spark):
    ten = "one two three four five six seven eight nine ten"
    docs = [(1, "x " + ten, "a", 1), (1, "other", "b", 2), (None, ten, "c", 3), (None, None, "d", 4), (2, "", "e", 5), (3, ten[4:], "f", 6), (3, ten[4:], "f", 6)]
    d = spark.createDataFrame(docs, "doc_id long, text string, th string, m int")
    b = spark.createDataFrame([(7, ten)], "item_id long, text string")
    for block in (dc.BLOCK, 0):
        got = dc.clean(d, b, block)
        assert got.columns == d.columns
        assert sorted(r.m for r in got.collect()) == [2, 4, 5, 6, 6]


def test_hot_windows(spark, monkeypatch):
    monkeypatch.setattr(dc.common, "HOT_PART", 4)
    monkeypatch.setattr(dc, "OUT_ROWS", 3)
    test_random(spark)
