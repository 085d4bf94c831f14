"""SentencePiece BPE encoding in vectorised merge rounds, and decoding.

A batch of texts is one flat array of symbols. It is cut into words wherever no piece of the vocabulary holds the two
characters side by side: no merge can ever cross such a place. Equal words are found by hash, verified character by
character, and encoded once. A round takes each word's least pair rank (a segmented minimum), merges all its
leftmost, not overlapping occurrences at once and closes the gaps; words without a pair left leave the arrays. Ranks
are those of the scores, so equal scores go from left to right.

Merging all occurrences at once equals one merge after the other, unless a merged piece can at once be part of a
pair of no higher rank (runs of spaces, whose pieces share one score). Of such a rank a word merges the leftmost occurrence
only. Words over `LONG` symbols are merged one pair after the other from a heap, as a round costs the word's length.

Texts are encoded whole: long ones in portions that end where a word ends, and a text of one endless word is one
portion. There is no shuffle; a lost task is run again on its own rows.

Models: BPE with byte fallback and without character map, white-space removal, own symbols or unused pieces; others
raise ValueError. Cases: a null or empty text has no ids; null ids decode to an empty text; repeated rows stay; extra
columns are kept and one named like the result gives way; empty tables give empty results. Ids decode as the public library
decodes them: one leading space goes, control pieces are silent, bytes that no character holds become U+FFFD.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm import common

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Characters of one portion of a text, and of the portions that are encoded together.
PORTION = 1 << 20
#: Bytes of texts, or ids, of one batch.
CHUNK_BYTES = 2 << 20
#: Words with more symbols than this are merged from a heap.
LONG = 128
NONE = np.iinfo(np.int32).max
# Fixed: piece types and field numbers of the model's format, and its sign for a space.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SPACE = "▁"


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message in protocol-buffer wire format."""

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            c = b[at]
            at += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    at = 0
    while at < len(b):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, b[at : at + n]
        at += n


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of each id; ValueError for a model of another kind."""
    pieces, trainer, normal = [], {}, {}
    with open(path, "rb") as f:
        for k, v in _fields(f.read()):
            if k == 1:
                x = dict(_fields(v))
                pieces.append((x[1].decode(), struct.unpack("<f", x.get(2, bytes(4)))[0], x.get(3, NORMAL)))
            elif k == 2:
                trainer = dict(_fields(v))
            elif k == 3:
                normal = dict(_fields(v))
    plain = not normal.get(2) and normal.get(3, 1) and not normal.get(4, 1) and normal.get(5, 1) and not trainer.get(24)
    if trainer.get(3) != 2 or not trainer.get(35) or not plain or {t for _, _, t in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError(f"{path}: not a BPE model with byte fallback, plain white space and plain pieces")
    return pieces


class PieceTokenizer:
    """encode_texts(texts) to arrays of ids, decode(ids) to text."""

    def __init__(self, path: str = MODEL):
        pieces = read_model(path)
        self.size = len(pieces)
        id_of = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        chars = sorted({c for p in id_of for c in p})
        # Characters that are no piece get numbers after the pieces'.
        self.symbols = [*(p for p, _, _ in pieces), *(c for c in chars if c not in id_of)]
        number = id_of | {c: self.size + i for i, c in enumerate(self.symbols[self.size :])}
        byte_ids = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.byte_ids = np.array([byte_ids[k] for k in range(256)], np.int32)
        # Characters, from 1; 0 is one that no piece has.
        self.place = np.zeros(0x110000, np.int32)
        self.place[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.symbol_at = np.array([-1, *(number[c] for c in chars)], np.int32)
        self.together = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        scores = sorted({pieces[i][1] for i in id_of.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        pairs, lowest = {}, {}
        for p, i in id_of.items():
            at = self.place[[ord(c) for c in p]]
            self.together[at[:-1], at[1:]] = True
            r = rank_of[pieces[i][1]]
            for k in range(1, len(p)):
                x, y = number.get(p[:k]), number.get(p[k:])
                if x is not None and y is not None:
                    pairs[x << 32 | y] = (r, i)
                    for z in (x, y):
                        lowest[z] = min(r, lowest.get(z, NONE))
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [NONE], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()] + [-1], np.int32)
        #: Ranks with a piece that a pair of no higher rank can hold.
        self.one_by_one = np.zeros(len(scores) + 1, bool)
        self.one_by_one[[rank_of[pieces[i][1]] for i in id_of.values() if lowest.get(i, NONE) <= rank_of[pieces[i][1]]]] = True
        self.text_of = [p.replace(SPACE, " ") for p, _, _ in pieces]
        self.bytes_of = [bytes([int(p[1:-1], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else s.encode() for (p, _, t), s in zip(pieces, self.text_of, strict=True)]
        self.kinds = np.array([t for _, _, t in pieces])
        self.leads = np.array([t == NORMAL and p.startswith(SPACE) for p, _, t in pieces])

    # --- encoding ---

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NONE without one."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[self.keys[np.minimum(at, self.keys.size - 1)] != key] = self.keys.size
        return self.ranks[at], self.merged[at]

    def rounds(self, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left of each word when no pair is: symbols in order of the words, and their numbers."""
        word = np.repeat(np.arange(lens.size, dtype=np.int32), lens)
        rank, into = np.full(sym.size, NONE, np.int32), np.full(sym.size, -1, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], into[inner] = self.pairs(sym[inner], sym[inner + 1])
        done = []
        while sym.size:
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            size = np.diff(np.append(starts, sym.size))
            least = np.minimum.reduceat(rank, starts)
            ended = least == NONE
            if ended.any():
                out = np.repeat(ended, size)
                done.append((word[out], sym[out]))
                sym, word, rank, into = (x[~out] for x in (sym, word, rank, into))
                size, least = size[~ended], least[~ended]
            least = np.repeat(least, size)
            at = np.flatnonzero(rank == least)
            again = word[at[1:]] == word[at[:-1]]
            at = at[np.concatenate([[True], ~(again & self.one_by_one[least[at[1:]]])])] if at.size else at
            # Of places in a row, every other one.
            run = np.diff(at, prepend=-2) != 1
            k = np.arange(at.size)
            at = at[(k - np.maximum.accumulate(np.where(run, k, 0))) % 2 == 0]
            sym[at] = into[at]
            kept = np.ones(sym.size, bool)
            kept[at + 1] = False
            moved = np.cumsum(kept) - 1
            sym, word, rank, into = (x[kept] for x in (sym, word, rank, into))
            at = moved[at]
            changed = np.unique(np.concatenate([at, at[at > 0] - 1]))
            ends = np.append(word[1:] != word[:-1], True)[changed] if word.size else np.zeros(0, bool)
            rank[changed[ends]] = NONE
            changed = changed[~ends]
            rank[changed], into[changed] = self.pairs(sym[changed], sym[changed + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(lens.size, np.int64)
        words, syms = (np.concatenate(x) for x in zip(*done, strict=True))
        return syms[np.argsort(words, kind="stable")], np.bincount(words, minlength=lens.size)

    def from_heap(self, sym: np.ndarray) -> np.ndarray:
        """One word, one merge after the other: the least rank, of those the leftmost."""
        s, n = sym.tolist(), sym.size
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, into = self.pairs(sym[:-1], sym[1:])
        todo = [(r, i, s[i], s[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), into.tolist(), strict=True)) if r != NONE]
        heapq.heapify(todo)
        known = {}
        while todo:
            _, i, x, y, m = heapq.heappop(todo)
            j = after[i]
            if s[i] != x or j < 0 or s[j] != y:
                continue
            s[i], s[j], after[i] = m, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else -1
                if b >= 0:
                    found = known.get((s[a], s[b]))
                    if found is None:
                        r, z = self.pairs(np.array([s[a]]), np.array([s[b]]))
                        found = known[s[a], s[b]] = int(r[0]), int(z[0])
                    if found[0] != NONE:
                        heapq.heappush(todo, (found[0], a, s[a], s[b], found[1]))
        return np.array([x for x in s if x >= 0], np.int32)

    def _words(self, code: np.ndarray, place: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words one after the other, and how many each has."""
        lens = ends - starts
        unknown = place[starts] == 0  # alone in its word
        long = np.flatnonzero(lens > LONG)
        short = np.flatnonzero((lens <= LONG) & ~unknown)
        sym, n = self.rounds(self.symbol_at[place[_spread(starts[short], lens[short])]], lens[short])
        order, ids, counts = [np.repeat(short, n)], [sym], np.zeros(starts.size, np.int64)
        for w in long.tolist():
            ids.append(self.from_heap(self.symbol_at[place[starts[w] : ends[w]]]))
            order.append(np.full(ids[-1].size, w))
        order, ids = np.concatenate(order), np.concatenate(ids)
        odd = np.flatnonzero(ids >= self.size)  # characters within pieces that are no pieces
        spelt = np.concatenate([code[starts[unknown]], np.array([ord(self.symbols[i]) for i in ids[odd].tolist()], code.dtype)])
        by_byte = [chr(c).encode() for c in spelt.tolist()]
        n = np.fromiter(map(len, by_byte), np.int64, len(by_byte))
        more = self.byte_ids[np.frombuffer(b"".join(by_byte), np.uint8)]
        at = np.arange(ids.size, dtype=np.float64)
        here = np.concatenate([np.full(int(unknown.sum()), -1.0), at[odd]])
        kept = ids < self.size
        order = np.concatenate([order[kept], np.repeat(np.concatenate([np.flatnonzero(unknown), order[odd]]), n)])
        at = np.concatenate([at[kept], np.repeat(here, n)])
        ids = np.concatenate([ids[kept], more])
        ids = ids[np.lexsort((at, order))]
        np.add.at(counts, order, 1)
        return ids.astype(np.int32), counts

    def _encode(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of texts whose spaces are escaped already; none is empty."""
        code = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        ends_of = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        place = self.place[code]
        first = np.ones(code.size, bool)
        first[1:] = ~self.together[place[:-1], place[1:]]
        first[ends_of[:-1]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], code.size)
        lens = ends - starts
        # The first of equal words stands for them, if it is equal in truth and not by hash alone.
        same, _ = pd.factorize(common.mix(common.WORDS_1.spans(code.astype(np.uint64) + np.uint64(1), starts, ends)))
        known = np.zeros(int(same.max()) + 1, np.int64)
        known[same[::-1]] = np.arange(starts.size)[::-1]
        model = known[same]
        other = lens != lens[model]
        model[other] = np.flatnonzero(other)
        unlike = code != code[_spread(starts[model], lens)]
        if unlike.any():
            wrong = np.unique(np.repeat(np.arange(starts.size), lens)[unlike])
            model[wrong] = wrong
        chosen, which = np.unique(model, return_inverse=True)
        ids, counts = self._words(code, place, starts[chosen], ends[chosen])
        at = np.concatenate([[0], np.cumsum(counts)])
        flat = ids[_spread(at[which], counts[which])]
        total = np.concatenate([[0], np.cumsum(counts[which])])
        return np.split(flat, total[np.searchsorted(starts, ends_of[:-1])])

    def portions(self, text: str) -> Iterator[str]:
        """The text with its escapes, cut where a word ends."""
        text = SPACE + text.replace(" ", SPACE)
        at = 0
        while len(text) - at > PORTION:
            k = at + PORTION
            while k < len(text) and self.together[self.place[ord(text[k - 1])], self.place[ord(text[k])]]:
                k += 1
            yield text[at:k]
            at = k
        if at < len(text):
            yield text[at:]

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        parts, owner, have = [], [], 0

        def flush():
            for k, ids in zip(owner, self._encode(parts) if parts else [], strict=True):
                out[k].append(ids)
            parts.clear()
            owner.clear()

        for k, t in enumerate(texts):
            for p in self.portions(t) if t else ():
                if have + len(p) > PORTION:
                    flush()
                    have = 0
                parts.append(p)
                owner.append(k)
                have += len(p)
        flush()
        return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]

    # --- decoding ---

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        if not ids.size:
            return ""
        if ids.min() < 0 or ids.max() >= self.size:
            raise ValueError("no such id")
        heard = np.flatnonzero(self.kinds[ids] != CONTROL)
        strip = bool(heard.size and self.leads[ids[heard[0]]])
        try:  # control pieces part the bytes around them
            text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode() if heard.size == ids.size else "".join(self._spelt(ids))
        except UnicodeDecodeError:
            text = "".join(self._spelt(ids))
        return text[1:] if strip else text

    def _spelt(self, ids: np.ndarray) -> Iterator[str]:
        """Runs of bytes apart: each byte that begins no whole character becomes U+FFFD."""
        kinds, i = self.kinds[ids] == BYTE, 0
        while i < ids.size:
            if not kinds[i]:
                yield self.bytes_of[ids[i]].decode()
                i += 1
                continue
            b = b""
            while i < ids.size and kinds[i]:
                b += self.bytes_of[ids[i]]
                i += 1
            while b:
                n = 1 if b[0] < 0x80 else 2 if b[0] < 0xE0 else 3 if b[0] < 0xF0 else 4
                try:
                    yield b[:n].decode()
                    b = b[n:]
                except UnicodeDecodeError:
                    yield "�"
                    b = b[1:]


def _spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places of the spans, one after the other."""
    total = np.cumsum(lens)
    return np.repeat(starts - total + lens, lens) + np.arange(total[-1] if lens.size else 0)


def resident(path: str):
    """A worker's tokenizer, in a with statement."""
    return common.resident(("piece_bpe", path), lambda: PieceTokenizer(path))


def _with_column(df: DataFrame, source: str, out: str, kind: T.DataType, arrow: pa.DataType, path: str, work) -> DataFrame:
    names = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(out, kind)])

    def run(it):
        with resident(path) as tok:
            for b in it:
                for c in common.chunks(_sizes(b.column(source)), CHUNK_BYTES):
                    part = b.slice(c.start, c.stop - c.start)
                    yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), pa.array(work(tok, part.column(source)), arrow)], [*names, out])

    return df.mapInArrow(run, schema)


def _sizes(column: pa.Array) -> np.ndarray:
    """About the bytes of each value."""
    n = pc.binary_length(column) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pc.list_value_length(column)
    return pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16


def encode(df: DataFrame, text: str = "text", path: str = MODEL, out: str = "piece_ids") -> DataFrame:
    """df with an array<int> column of ids; a null text gives an empty array."""
    work = lambda tok, column: tok.encode_texts(column.fill_null("").to_pylist())
    return _with_column(df, text, out, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), path, work)


def decode(df: DataFrame, ids: str = "piece_ids", path: str = MODEL, out: str = "decoded") -> DataFrame:
    """df with the text of an array<int> column of ids; null gives an empty text."""

    def work(tok, column):
        return [tok.decode(x.values.to_numpy()) if x.is_valid else "" for x in column]

    return _with_column(df, ids, out, T.StringType(), pa.string(), path, work)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decode(encode(docs).drop("text"))
    ids = F.array_join(F.col("piece_ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("piece_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op13_sentencepiece": op13_sentencepiece}
#: SQL has no merges; tests compare with the public library.
ORACLE_SQL: dict[str, str] = {}
