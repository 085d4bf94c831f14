import random

from pyspark.sql import functions as F

from fieldloom.llm import chat_format as cf

SCHEMA = "tree string, node long, parent long, role string, text string, score double"


def test_best_paths_of_random_trees(spark):
    rnd = random.Random(9)
    rows, want = [], {}
    for t in range(12):
        n = rnd.randint(1, 25)
        parent = [None] + [rnd.randint(0, i - 1) for i in range(1, n)]
        score = [rnd.randint(0, 3) * 1.0 for _ in range(n)]
        rows += [(f"t{t}", i, parent[i], "user", f"m{i}", score[i]) for i in range(n)]
        best = []
        for leaf in set(range(n)) - set(parent):
            path = [leaf]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            best.append((-sum(score[i] for i in path) / len(path), leaf, path[::-1]))
        want[f"t{t}"] = [(leaf, path) for _, leaf, path in sorted(best)]
    rows += [("loop", 1, 2, "user", "a", 0.0), ("loop", 2, 1, "user", "b", 0.0), ("lost", 5, 99, "user", "c", 0.0)]
    want["lost"] = [(5, [5])]
    df = spark.createDataFrame(rows, SCHEMA)
    for k in (1, 2, None):
        got = {}
        for r in cf.chosen_paths(df, k).collect():
            got.setdefault((r.tree, r.leaf), {})[r.place] = r.node
        assert {key: [v[i + 1] for i in range(len(v))] for key, v in got.items()} == {(t, leaf): path for t, w in want.items() for leaf, path in w[:k]}


def test_escapes_round_trip(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["\\", "#", "###", "</turn>", "\n", ":", ": ", "h", "e", "c", "é", "<"]) for _ in range(rnd.randint(0, 9))) for _ in range(300)]
    rows = [("a", i, None if i == 0 else i - 1, t, t, 0.0) for i, t in enumerate(texts)]
    row = cf.format_trees(spark.createDataFrame(rows, SCHEMA)).select("*", cf.parse(F.col("formatted")).alias("back")).first()
    assert [(x.role, x.text) for x in row.back] == [(t, t) for t in texts]


def test_conversations(spark):
    import hashlib

    rows = [(1, 0, "user", None, "x"), (1, 1, "assistant", "hé ### </turn>\n", "x"), (1, 2, None, "", "x"), (1, 3, "assistant", "b\\", "x"), (2, 5, "assistant", "tie", "x"), (2, 5, "assistant", "tie", "x"), (None, None, "user", "q", "x")]
    rows += [(3, i, "assistant", "long " * 50, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string")
    got = {r.tree: r for r in cf.digests(cf.format_trees(cf.chains(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for key, conv in (("1", 1), ("2", 2), ("3", 3), ("null", None)):
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        r = got.pop(key)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)), len(loss), sha(loss))
    assert not got
    assert cf.format_trees(cf.chains(df.limit(0))).count() == 0


def test_null_trees_repeated_nodes_and_null_scores(spark):
    rows = [(None, 1, None, "user", "a", None), (None, 2, 1, "assistant", "b", 0.5), (None, 3, 1, "assistant", "c", None), ("t", 1, None, "user", "x", 1.0), ("t", 1, None, "user", "x", 1.0), ("t", 1, None, "user", "w", 1.0), ("t", None, 1, "user", "lost", 9.0), ("t", 5, 1, "assistant", None, None), ("t", 4, 1, None, "z", 0.0)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "tree string, node int, parent int, role string, text string, score double, own string")
    got = {r.tree: r for r in cf.format_trees(df).collect()}
    assert {k: (r.leaf, r.formatted) for k, r in got.items()} == {None: (2, "### user: a</turn>\n### assistant: b</turn>\n"), "t": (4, "### user: w</turn>\n### : z</turn>\n")}
    assert [tuple(x) for x in got[None].loss_spans] == [(got[None].formatted.index("b</turn>"), 1)]
    assert {r.leaf for r in cf.format_trees(df, None).where("tree = 't'").collect()} == {4, 5}
    assert cf.format_trees(df.limit(0)).count() == 0


def test_null_turns_come_first_in_spark_and_sql(spark, tmp_path):
    import duckdb

    rows = [(1, 2, "assistant", "c"), (1, None, "user", "a"), (1, 1, "user", "b"), (1, None, "assistant", "z"), (2, None, None, None), (2, 0, "user", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = cf.op1_chat_format(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    rel = con.sql(cf.ORACLE_SQL["op1_chat_format"])
    at = [rel.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
