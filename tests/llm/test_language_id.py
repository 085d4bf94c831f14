import math
import random

import numpy as np
import pytest

from fieldloom.llm import language_id as li


def exact(samples, order, text):
    """Code length by the definition."""
    bits = 0.0
    for i, b in enumerate(text):
        n = min(order, i)
        while True:
            if n < 0:
                bits += 8
                break
            ctx = text[i - n : i]
            after = [t[j + n] for t in samples for j in range(len(t) - n) if t[j : j + n] == ctx]
            if after:
                total, kinds = len(after), len(set(after))
                if b in after:
                    bits += math.log2((total + kinds) / after.count(b))
                    break
                bits += math.log2((total + kinds) / kinds)
            n -= 1
    return bits


def test_exact_code_lengths():
    rnd = random.Random(2)
    words = {"a": ["the", "of", "and"], "b": ["der", "und", "über"]}
    samples = {k: [" ".join(rnd.choice(w) for _ in range(30)).encode() for _ in range(3)] for k, w in words.items()}
    machine = li.Model(samples, 3).compile()
    texts = [b"the und zebra", "über alles".encode(), b"x", ("the of " * 100).encode(), b""]
    got = machine.bits(texts)
    for t, row in zip(texts, got):
        for k, x in zip(("a", "b"), row):
            assert x == pytest.approx(exact(samples[k], 3, t), rel=1e-4, abs=1e-3)


def test_query_is_accurate(spark):
    df = li.op3_language_id(spark, "/root/testdata/sf0.01")
    true = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = df.collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == len(true) and len(out) > 100
    assert np.mean([r.lang_pred == true[r.doc_id] for r in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "123 !?", "de"), (5, "", None), (6, "the dog " * 20_000, None), (7, "the", "en"), (7, "the", "en"), (None, "中", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score_ double")
    got = li.predict(df, li.train(df)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and [by[i].lang_pred for i in (1, 2, 3, 4, 5, 6)] == ["en", "de", "und", "und", "und", "en"]
    assert by[None].lang_pred in ("en", "de")
    assert {r.lang_pred for r in li.predict(df, li.train(df.where("lang IS NULL"))).collect()} == {"und"}
    assert li.predict(df.limit(0), li.train(df)).count() == 0


def test_many_languages_and_long_texts(spark):
    rnd = random.Random(6)
    rows = []
    for k in range(70):
        letters = [chr(0x4E00 + 3 * k + j) for j in range(3)]
        rows.append((k, " ".join("".join(rnd.choice(letters) for _ in range(4)) for _ in range(400 if k else 200_000)), f"l{k:02d}"))
    df = spark.createDataFrame(rows + [(100, None, "none"), (101, "", "empty")], "doc_id long, text string, lang string")
    model = li.train(df, sample_bytes=3000)
    assert model.languages == [f"l{k:02d}" for k in range(70)]
    got = li.predict(df.where("text <> ''"), model).collect()
    assert all(r.lang_pred == r.lang for r in got)
    one = li.Machine([li.Automaton(model)])
    texts = [r[1][:300].encode() for r in rows]
    assert np.allclose(one.bits(texts), model.compile().bits(texts), rtol=1e-5)


def test_columns_that_have_the_output_names(spark):
    df = spark.createDataFrame([(1, "the cat", "en", "x", 5, 6), (2, "der hund", "de", "y", 7, 8)], "doc_id long, text string, lang string, lang_pred string, score int, bits_per_byte int")
    got = li.predict(df, li.train(df)).orderBy("doc_id")
    assert sorted(got.columns) == sorted(df.columns)
    assert [(r.lang_pred, 0 <= r.score <= 1) for r in got.collect()] == [("en", True), ("de", True)]


def test_ties_go_to_the_first_language(spark):
    rows = [(i, "the same words are here for both of them", lang) for i, lang in enumerate(["zz", "aa"] * 10)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in li.predict(train, li.train(train)).collect()} == {("aa", 0.5)}
