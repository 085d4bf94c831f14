import re

import pytest

from tests.llm.test_decontaminate import words
from tests.llm.test_line_dedup import brute as lines_brute
from tests.llm.test_simhash import closure, fp

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = [docs.toPandas()]
    for _, f in cp.STAGES:
        docs = f(spark, docs, d).cache()
        out.append(docs.toPandas())
    return out


def test_columns_and_rejections(stages):
    assert all(list(x.columns) == list(stages[0].columns) for x in stages[:-1])
    a, b = stages[0], stages[1]
    gone = set(a.doc_id) - set(b.doc_id)
    assert len(gone) < 0.05 * len(a)
    assert all(re.search(r"[^\W\d_]", t) for t in b.text)


def test_lines(stages):
    rows = list(zip(stages[1].doc_id.tolist(), stages[1].text.tolist()))
    want = {i: t for i, t, n, gone in lines_brute(rows) if not gone or gone < n}
    assert dict(zip(stages[2].doc_id, stages[2].text)) == want
    assert (stages[2].n_chars == stages[2].text.str.len()).all()


def test_near_copies(stages):
    ids, texts = stages[2].doc_id.tolist(), stages[2].text.tolist()
    root = closure([fp(t) for t in texts])
    least = {}
    for i, r in zip(ids, root):
        least[r] = min(i, least.get(r, i))
    assert set(stages[3].doc_id) == set(least.values())


def test_decontaminated(spark, stages):
    bench = [words(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + min(10, len(w))]) for w in bench for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(g) for g in grams}
    hit = lambda w: any(tuple(w[i : i + m]) in grams for m in sizes for i in range(len(w) - m + 1))
    assert set(stages[4].doc_id) == {i for i, t in zip(stages[3].doc_id, stages[3].text) if not hit(words(t))}


def test_tokens(stages):
    from fieldloom.llm import bpe

    tok = bpe.Tokenizer()
    text = dict(zip(stages[4].doc_id, stages[4].text))
    assert set(stages[5].doc_id) == set(text)
    assert all("".join(tok.decode(r.token_ids)) == text[r.doc_id] for r in stages[5].itertuples())


def test_no_rows(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, f in cp.STAGES[:-1]:
        docs = f(spark, docs, d)
        assert docs.count() == 0


def test_nulls_repeats_and_clashing_names(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    first = docs.orderBy("doc_id").limit(3).collect()
    long = " ".join(f"word{i}" for i in range(30_000))
    more = [(None, "A clean text of its own that nobody else has, with more than ten words in it.", None, None, None), (None, None, None, None, None), (7_000_001, "", "en", "s", 0), (7_000_002, "\n \t", "en", "s", 3), (7_000_003, None, "en", None, None), (7_000_004, long, "en", "s", len(long)), (None, first[1].text, "en", "s", 1)]
    extra = spark.createDataFrame(more + [tuple(first[0])], docs.schema)
    rows = docs.unionByName(extra).withColumn("th", cp.F.lit("x")).withColumn("node", cp.F.lit(1)).withColumn("key", cp.F.lit(2.5)).withColumn("row", cp.F.lit("r"))
    found = cp.common.checkpoint(rows.repartition(3))
    for _, f in cp.STAGES[:-1]:
        found = cp.common.checkpoint(f(spark, found, d))
        assert found.columns == rows.columns
    kept = found.collect()
    assert [r.text for r in kept if r.doc_id is None] == [more[0][1]]
    assert all(r.text.strip() and (r.th, r.node, r.key, r.row) == ("x", 1, 2.5, "r") for r in kept)
    assert len({r.text for r in kept}) == len(kept) and 7_000_004 in {r.doc_id for r in kept}
    tokens = cp.STAGES[-1][1](spark, found, d)
    assert tokens.count() == len(kept) and tokens.columns[0] == "doc_id"
    assert cp.STAGES[-1][1](spark, found.limit(0), d).count() == 0
