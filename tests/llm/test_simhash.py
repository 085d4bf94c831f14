import glob
import os
import random
import re
import time

import numpy as np
import xxhash
from pyspark.sql import functions as F

from fieldloom.llm import simhash
from fieldloom.llm.components import components


def fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(prints):
    n = len(prints)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_links_of_fingerprints(spark):
    rnd = random.Random(2)
    prints = set()
    for _ in range(25):
        x = rnd.getrandbits(64)
        prints.add(x)
        for _ in range(rnd.randint(0, 40)):
            x ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 5)))
            prints.add(x)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in prints], "fp long")
    for low in (512, 7):
        was, simhash.CHUNK_LOW = simhash.CHUNK_LOW, low
        got = {r.u: r.v for r in components(simhash.links(nodes)).collect()}
        simhash.CHUNK_LOW = was
        signed = [int(np.uint64(x).view(np.int64)) for x in prints]
        want = closure(prints)
        groups = {}
        for s, w in zip(signed, want):
            groups.setdefault(w, []).append(s)
        assert all({got.get(s, s) for s in g} == {min(g)} for g in groups.values())
        assert set(got) == {s for g in groups.values() for s in g if s != min(g)}


def test_one_dense_key(spark):
    base = 0x0123456789ABCDEF
    prints = sorted({base ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)})
    nodes = spark.createDataFrame([(x,) for x in prints], "fp long")
    assert components(simhash.links(nodes)).count() == len(prints) - 1


def test_documents(spark):
    rnd = random.Random(4)
    texts = [None, "", " \n ", "One", "one", "two words", "Été DÉJÀ vu", "a " * 5000]
    for _ in range(20):
        w = [rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "é"]) + str(rnd.randint(0, 9)) for _ in range(200)]
        texts += [" ".join(w), " ".join(w).upper()]
        w[50] = "changed"
        texts.append("\n".join(w))
    rows = [(1000 - i, t, "x") for i, t in enumerate(texts)] + [(1000, None, "x"), (None, texts[-1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
    prints = [fp(t) for _, t, _ in rows]
    root = closure(prints)
    best = {}
    for r, (i, _, _) in zip(root, rows):
        best[r] = min(best.get(r, 1 << 60), 1 << 60 if i is None else i)
    want = [(i, int(np.uint64(p).view(np.int64)), best[r]) for (i, _, _), p, r in zip(rows, prints, root)]
    assert got == sorted(want, key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_long_chain(spark):
    e = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert components(e).where("v != 0").count() == 0
    assert components(e).count() == 300


def test_the_table_discards_pairs():
    rnd = np.random.default_rng(5)
    fp = np.unique(np.concatenate([rnd.integers(0, 1 << 63, 400).astype(np.uint64), np.uint64(1) << np.arange(8, dtype=np.uint64)]))
    table = np.bitwise_count(fp[:, None] ^ simhash._REFERENCES).astype(np.uint8)
    u, v, verified = simhash.forest(np.zeros(fp.size, np.int64), fp, table, 3)
    assert len(u) == 7 and 28 <= verified < 0.01 * fp.size**2 / 2
    _, _, every = simhash.forest(np.zeros(fp.size, np.int64), fp, np.zeros_like(table), 3)
    assert every == fp.size * (fp.size - 1) // 2


def test_groups_that_span_arrow_batches(spark, monkeypatch):
    monkeypatch.setattr(simhash, "READ_ROWS", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        test_one_dense_key(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rounds_of_components_take_tasks_by_links(spark):
    """A few links in many parts: a round costs few tasks, and what comes back lies in few parts."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        # chains of 1 to 40 links, their ends in mixed order
        rows = [(1000 * c + x * 37 % 1000, 1000 * c + (x + 1) * 37 % 1000) for c in range(40) for x in range(c + 1)]
        want = {}
        for c in range(40):
            ids = [1000 * c + x * 37 % 1000 for x in range(c + 2)]
            want |= {i: min(ids) for i in ids if i != min(ids)}
        links, sc = spark.createDataFrame(rows, "u long, v long"), spark.sparkContext
        sc.setJobGroup("components", "")
        found = components(links)
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert {r.u: r.v for r in found.collect()} == want
        assert found.rdd.getNumPartitions() <= 8
        stages = {s for j in sc.statusTracker().getJobIdsForGroup("components") for s in sc.statusTracker().getJobInfo(j).stageIds}
        infos = [x for x in map(sc.statusTracker().getStageInfo, stages) if x]
        rounds = sum(x.numCompletedTasks == 1 and x.numTasks == 1 for x in infos) - 1  # the only stages of one task are those of the counts
        assert rounds > 1
        assert sum(x.numCompletedTasks for x in infos) < 5 * 64 * (rounds + 1)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_shuffle_files_of_rounds_go(spark):
    files = lambda: sum(f.endswith(".data") for d in glob.glob(f"{spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]}/*/") for f in os.listdir(d))
    e = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    before = files()
    found = components(e)
    for _ in range(40):  # Spark deletes them in the background
        if files() <= before:
            break
        time.sleep(0.25)
    assert files() <= before
    assert found.count() == 300
