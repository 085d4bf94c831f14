"""Nodes of the prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from fieldloom.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, node string"


def key(m):
    return hashlib.sha256(f"{len(m[0])}:{m[0]}{m[1]}".encode()).hexdigest()


def nodes(paths):
    """What trie() gives for {conv_id: [(role, text)]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
        ends[tuple(p)].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        n = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += n
            leaves[p[:d]] += p not in kids
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def spliced(rows, group=20, most=4):
    convs = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", key((r[2] or "", r[3] or "")))):
        convs[r[0]].append((r[2] or "", r[3] or ""))
    out = {}
    for c, p in convs.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = convs.get(c - c % group, [])[:h] + p[h:]
    return out


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def some(seed, convs=120, turns=9):
    rnd = random.Random(seed)
    out = []
    for c in range(convs):
        for t in range(rnd.randint(1, turns)):
            out.append((c, rnd.choice([t, t, None]), rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "c\td ", "", None, "é\x85f g"]), "x"))
    return out + out[:9] + [(None, 0, "user", "lost", "x")] + [(500 + c, t, "user", "same words here", "x") for c in range(60) for t in range(4)]


def test_nodes_equal_a_dictionary(spark):
    rows = some(1) + [(900, t, "user", f"w{t} x" * 40, "x") for t in range(300)]
    got = pt.trie(*pt.spliced(pt.messages(spark.createDataFrame(rows, SCHEMA))))
    assert rows_of(got) == nodes(spliced(rows))


@pytest.mark.parametrize("block,portion,hot", [(2, 5, 2), (3, 1 << 20, 1024)])
def test_long_conversations_and_shared_nodes(spark, monkeypatch, block, portion, hot):
    monkeypatch.setattr(pt, "BLOCK", block)
    monkeypatch.setattr(pt, "PORTION", portion)
    monkeypatch.setattr(pt.common, "HOT_PART", hot)
    rows = some(2, 50, 12)
    got = pt.trie(*pt.spliced(pt.messages(spark.createDataFrame(rows, SCHEMA).repartition(7))))
    assert rows_of(got) == nodes(spliced(rows))


def test_one_conversation_over_many_partitions(spark):
    rows = [(7, t, "user", str(t % 3), "x") for t in range(4000)] + [(8, 0, "user", "0", "x")]
    numbers = pt.messages(spark.createDataFrame(rows, SCHEMA).repartition(11))
    got = sorted((r.conv_id, r.place) for r in numbers.collect())
    assert got == [(7, t + 1) for t in range(4000)] + [(8, 1)]


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pt.trie(*pt.spliced(pt.messages(none))).count() == 0
    turns, convs = pt.spliced(pt.messages(none))
    alone = pt.trie(turns, spark.createDataFrame([(5,), (3,)], "conv_id long"))
    assert rows_of(alone) == nodes({5: [], 3: []})
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)  # its turns go, and there is no base
    rows = [(lone, 0, "user", "a", "x"), (20, 0, "user", "b", "x")]
    assert rows_of(pt.trie(*pt.spliced(pt.messages(spark.createDataFrame(rows, SCHEMA))))) == nodes(spliced(rows))


def test_owned_nodes_are_limited_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("id AS conv_id", "id % 2 AS node")
    plan = df.withColumn("k", pt.F.row_number().over(pt.Window.partitionBy("node").orderBy("conv_id"))).where("k = 1")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
