import random
import re
from collections import Counter

from fieldloom.llm import host_rules as hr


def figures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    fail = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), fail


def test_figures_and_verdicts(spark):
    rnd = random.Random(1)
    rows = [(1, None, "a"), (2, "", None), (3, " \n\t\x0b\x0c\r ", "a"), (4, "one", "a"), (5, "a b c a b c", None), (6, "x " * 200, "b"), (7, "é#ü<>\n é#ü<>\n\x85", "c"), (7, "w%d " * 3, "c"), (None, " ".join(f"w{i}" for i in range(60)), "good"), (8, " ".join(f"w{i}" for i in range(30_000)) + " w1 w2 w3", "good")]
    rows += [(100 + i, rnd.choice([" ", "\n"]).join(rnd.choice("abcdefgh") + str(rnd.randint(0, 20)) for _ in range(rnd.randint(0, 200))), rnd.choice(["good", "mixed"])) for i in range(60)]
    rows += [(300 + i, "short text", "bad") for i in range(40)] + [(400, " ".join(f"w{i}" for i in range(60)), "bad")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, host int")
    got = {}
    for r in hr.verdicts(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept))
    want = {}
    for i, t, s in rows:
        f = figures(t)
        want.setdefault(i, []).append((*f, not f[-1] and s != "bad"))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert hr.verdicts(df.limit(0)).count() == 0
    assert hr.verdicts(df.withColumn("source", hr.F.lit(None).cast("string"))).where("kept").count() > 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    plan = hr.base_figures(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_hot_hosts(spark, monkeypatch):
    monkeypatch.setattr(hr.common, "HOT_PART", 3)
    test_figures_and_verdicts(spark)


def test_a_rate_of_just_the_limit_is_no_rejection(spark):
    df = spark.createDataFrame([(i, "short", "h") for i in range(5)], "doc_id long, text string, source string")
    assert {r.rate for r in hr.host_rates(hr.base_figures(df)).collect()} == {1.0}
    good = " ".join(f"w{i}" for i in range(60))
    df = df.unionByName(spark.createDataFrame([(9, good, "h")], "doc_id long, text string, source string"))
    rate = hr.host_rates(hr.base_figures(df)).first().rate
    kept = lambda most: {r.doc_id for r in hr.verdicts(df, most_failures=most).collect() if r.kept}
    assert kept(rate) == {9} and kept(rate - 1e-9) == set()
