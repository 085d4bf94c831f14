"""Pieces and texts against the public library, with the model file it comes with."""

import hashlib
import random
import struct

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm import piece_bpe

PARTS = [" ", "  ", "    ", "a", "b", "the", "in", "tion", "é", "日本", "語", "😀", "ﷺ", "\n", "\t", "▁", "<0x0A>", "<s>", "\0", "12", "---", "====", "aaaa", "\r", "ß", "к", "́", "‍"]


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.MODEL)


@pytest.fixture(scope="module")
def tok():
    return piece_bpe.PieceTokenizer()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=5)), max_size=40))
def test_encode_equals_the_library(lib, tok, parts):
    text = "".join(parts)
    ids = tok.encode_texts([text, "", text * 2])
    assert [x.tolist() for x in ids] == [lib.encode(text), [], lib.encode(text * 2)]
    assert tok.decode(ids[0]) == lib.decode(lib.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.sampled_from([0, 1, 2, 28705, 259]), st.integers(3, 258)), max_size=12))
def test_decode_any_ids(lib, tok, ids):
    assert tok.decode(ids) == lib.decode(ids)


@pytest.mark.parametrize("name,value", [("LONG", 4), ("PORTION", 7), ("LONG", 10**9)])
def test_long_words_and_portions(lib, tok, monkeypatch, name, value):
    monkeypatch.setattr(piece_bpe, name, value)
    rnd = random.Random(value)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 60))) for _ in range(200)] + [" " * 999, "a" * 3000, "=" * 500]
    assert [x.tolist() for x in tok.encode_texts(texts)] == [lib.encode(t) for t in texts]


def test_words_of_one_hash_are_told_apart(lib, tok, monkeypatch):
    monkeypatch.setattr(piece_bpe.common.WORDS_1, "spans", lambda values, s, e: (e - s).astype("uint64") % 3)
    texts = ["the quick brown fox jumps", "over the lazy dog and dig", "dag dug"]
    assert [x.tolist() for x in tok.encode_texts(texts)] == [lib.encode(t) for t in texts]


def test_other_models_are_refused(tmp_path):
    field = lambda k, b: bytes([k << 3 | 2, len(b)]) + b
    piece = field(1, field(1, b"a") + bytes([2 << 3 | 5]) + struct.pack("<f", -1.0))
    unigram = tmp_path / "u.model"
    unigram.write_bytes(piece + field(2, bytes([3 << 3, 1])))
    with pytest.raises(ValueError, match="not a BPE model"):
        piece_bpe.PieceTokenizer(str(unigram))


def test_operator_and_columns(spark, lib):
    rows = [(1, None, "x"), (2, "", "y"), (3, "  Hello  world\n", "z"), (3, "  Hello  world\n", "z"), (None, "naïve 😀ﷺ " * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_ids string")
    got = piece_bpe.decode(piece_bpe.encode(df))
    assert got.columns == ["doc_id", "text", "piece_ids", "decoded"]
    found = got.collect()
    assert sorted((str(r.doc_id), r.piece_ids, r.decoded) for r in found) == sorted((str(i), lib.encode(t or ""), t or "") for i, t, _ in rows)
    assert piece_bpe.encode(df.limit(0)).count() == 0
    nothing = spark.createDataFrame([(None,), ([],)], "piece_ids array<int>")
    assert [r.decoded for r in piece_bpe.decode(nothing).collect()] == ["", ""]


def test_query_over_the_table(spark, lib):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_bpe.op13_sentencepiece(spark, d).collect()}
    want = {i: lib.encode(t) for i, t in texts.items()}
    assert got == {i: (len(x), sha(",".join(map(str, x))), sha(lib.decode(x))) for i, x in want.items()}
