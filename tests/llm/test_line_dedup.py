import random

from fieldloom.llm import line_dedup as ld


def brute(rows, m=10):
    """Every run of m words or more that stood before; m lines have them, and longer runs are unions of such."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    out = [None] * len(rows)
    runs = {}
    for k in order:
        lines = (rows[k][1] or "").split("\n") if rows[k][1] is not None else []
        real = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        cut = set()
        for a in range(len(real)):
            n = 0
            for b in range(a, min(a + m, len(real))):
                n += len(lines[real[b]].split())
                if n >= m:
                    run = tuple(lines[real[i]] for i in range(a, b + 1))
                    if runs.setdefault(run, (k, a)) != (k, a):
                        cut |= {real[i] for i in range(a, b + 1)}
        out[k] = (rows[k][0], None if rows[k][1] is None else "\n".join(x for i, x in enumerate(lines) if i not in cut), len(real), len(cut))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("need", ld.F.lit(1)).withColumn("runs", ld.F.lit("x"))
    got = sorted(((r.doc_id, r.kept, r.n_lines, r.n_removed) for r in ld.dedup(df).collect()), key=str)
    assert got == brute(rows)


def test_random(spark):
    rnd = random.Random(8)
    pool = ["a", "b c", "d e f", "one two three four five", "x " * 12, "long line with more than ten words in it, you see", "", " ", "\t", "é"]
    rows = [(i, "\n".join(rnd.choice(pool[: rnd.choice([3, 6, 10])]) for _ in range(rnd.randint(0, 25)))) for i in range(60)]
    check(spark, rows)


def test_edges(spark):
    ten = " ".join("abcdefghij")
    words = "\n".join("abcdefghij")
    check(spark, [(1, None), (2, ""), (3, "\n\n"), (4, ten), (5, ten), (6, ten + "\n" + ten), (7, words), (8, "z\n" + words + "\nq"), (None, ten), (9, "\n".join(f"line {i}" for i in range(20_000))), (10, " ".join("abcdefghi"))])
    assert ld.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_same_row_twice(spark):
    df = spark.createDataFrame([(1, " ".join("abcdefghij"))] * 2, "doc_id long, text string")
    assert [r.n_removed for r in ld.dedup(df).collect()] == [0, 0]


def test_the_short_end_of_a_run_goes_too(spark):
    text = " ".join("abcdefghij") + "\nshort end"
    check(spark, [(1, text), (2, text), (3, "else\n" + text + "\nmore"), (4, "short end")])


def test_columns_that_have_the_output_names(spark):
    df = spark.createDataFrame([(1, " ".join("abcdefghij"), "x", 5, 7), (2, " ".join("abcdefghij"), "y", 6, 8)], "doc_id long, text string, kept string, n_lines int, _id int")
    got = ld.dedup(df).orderBy("doc_id").collect()
    assert [(r.kept, r.n_lines, r.n_removed, r._id) for r in got] == [(" ".join("abcdefghij"), 1, 0, 7), ("", 1, 1, 8)]


def test_hot_lines_and_runs(spark, monkeypatch):
    monkeypatch.setattr(ld.common, "HOT_PART", 4)
    ten = " ".join("abcdefghij")
    rows = [(i, f"w{i}\n" + (ten if i % 3 else "a b c d e\nf g h i j k") + f"\nq{i % 5} q q q q q q q q q") for i in range(40)]
    check(spark, [*rows, (None, ten), (50, None)])


def test_other_bounds_than_ten_words(spark):
    rnd = random.Random(3)
    pool = ["a", "b c", "d e f", "one two three four five", "", "é"]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12)))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (1, 3):
        got = sorted(((r.doc_id, r.kept, r.n_lines, r.n_removed) for r in ld.dedup(df, words).collect()), key=str)
        assert got == brute(rows, words)
