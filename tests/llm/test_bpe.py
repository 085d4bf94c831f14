import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from fieldloom.llm import bpe


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.RANKS), special_tokens={})


@pytest.fixture(scope="module")
def ours():
    return bpe.tokenizer(bpe.RANKS, public_tokenizers.PATTERN)


CASES = ["", " ", "a", "Hello, world's end", "x" * 3000, " " * 500, "\n\n\n\t ", "ééé😀👩‍👩‍👧 <|endoftext|>", "0123456789" * 50, "The" + "quick" * 200, "😀" * 300, "\x00\x01\x7f"]


def test_same_ids_as_the_library(ours, theirs):
    rnd = random.Random(7)
    alphabet = "abcdefghijkl mnopqrst uvwxyz  \n.,;'éßñ中文字😀0123AB#$"
    texts = CASES + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 400))) for _ in range(400)]
    texts += ["".join(rnd.choice("etaoinsr") for _ in range(60)) for _ in range(400)]
    for t in texts:
        assert ours.encode(t) == theirs.encode_ordinary(t), t[:80]
        assert "".join(ours.decode(ours.encode(t), 3)) == t


def test_few_states(theirs):
    small = bpe.Encoder(bpe.read_ranks(bpe.RANKS), max_states=20)
    for t in ["internationalization" * 20, "zzzzyyyxxqwertyasdf" * 9]:
        assert small.encode(t.encode()) == theirs.encode_ordinary(t)


def test_few_states_in_step(theirs, monkeypatch):
    rnd = random.Random(11)
    pieces = ["".join(rnd.choice("aeioustrnqué中😀ß") for _ in range(rnd.randint(1, 15))).encode() for _ in range(3000)]
    want = [theirs.encode_ordinary(p.decode()) for p in pieces]
    small = bpe.Encoder(bpe.read_ranks(bpe.RANKS), max_states=50)
    monkeypatch.setattr(bpe, "GROUP_BYTES", 500)
    assert [np.frombuffer(x, "<u4").tolist() for x in small.encode_many(pieces)] == want


def test_long_pieces_in_portions(theirs, monkeypatch):
    monkeypatch.setattr(bpe, "HOLD", 7)
    rnd = random.Random(12)
    small = bpe.Encoder(bpe.read_ranks(bpe.RANKS), max_states=30)
    for n in (1, 6, 7, 8, 65, 500):
        for alphabet in ("a", "etaoin", "zq", "é中"):
            p = "".join(rnd.choice(alphabet) for _ in range(n))
            portions = list(small.stream(p.encode()))
            assert len(portions) == -(-len(p.encode()) // 7)
            assert np.frombuffer(b"".join(portions), "<u4").tolist() == theirs.encode_ordinary(p)


def test_table():
    rnd = np.random.default_rng(3)
    keys = np.unique(rnd.integers(0, 1 << 40, 30_000))
    table = bpe._Table()
    for part in np.array_split(keys, 50):
        table.add(part, (part % 1000).astype(np.int32))
    assert (table.find(keys) == keys % 1000).all()
    assert (table.find(keys + (1 << 41)) == -1).all()


def test_states_that_share_a_hash(theirs, monkeypatch):
    monkeypatch.setattr(bpe.common, "mix", lambda h: h & np.uint64(0xFFF))
    small = bpe.Encoder(bpe.read_ranks(bpe.RANKS))
    pieces = [b"internationally", b"quicksort", b"zzyxabcde", b"misunderstandable"] + [bytes([97 + k % 26, 98 + k % 23, 100 + k % 7, 104 + k % 5, 97 + k % 11]) for k in range(500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in small.encode_many(pieces)] == [theirs.encode_ordinary(p.decode()) for p in pieces]


def test_columns_that_have_the_output_names(spark):
    df = spark.createDataFrame([(1, "abc", "x", 5), (2, None, "y", 6)], "id long, text string, token_ids string, decoded int")
    got = bpe.decode(bpe.encode(df))
    assert got.columns == ["id", "text", "token_ids", "decoded"]
    assert [r.decoded for r in got.orderBy("id").collect()] == ["abc", ""]
    assert bpe.encode(df, out="text").columns == ["id", "token_ids", "decoded", "text"]


def test_decoder_holds_back_unfinished_characters():
    d = bpe.StreamDecoder({i: bytes([i]) for i in range(256)})
    b = "aé中😀z".encode()
    assert "".join(d.give([x]) for x in b) + d.end() == "aé中😀z"
    assert d.give([0xE4, 0xB8]) == "" and d.end() == "�"
    for bad in (b"\xff", b"\xc3(", b"\xf0\x9f\x98", b"\x80\x80", b"\xed\xa0\x80"):
        assert d.give(bad) + d.end() == bad.decode("utf-8", "replace")


def test_query(spark, theirs):
    rows = [(1, None), (2, ""), (2, ""), (3, "Hello wörld"), (4, "long " * 30_000), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r for r in bpe.digests(df).collect()), key=str)
    want = []
    for i, t in rows:
        ids = theirs.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=lambda x: str(bpe_row(x)))
    assert bpe.digests(df.limit(0)).count() == 0
    back = bpe.decode(bpe.encode(df.withColumn("token", df.text)))
    assert all(r.decoded == (r.text or "") for r in back.collect())


def bpe_row(x):
    from pyspark.sql import Row

    return Row("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")(*x)
