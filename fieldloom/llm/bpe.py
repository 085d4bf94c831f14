"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly if each of its tokens
encodes to itself and each neighbouring pair encodes to itself. So the merges compile to a
non-deterministic transducer: its places are (last token, place in the trie of tokens); reading a
whole token b after a is allowed if the pair (a, b) encodes to itself. Every prefix of the input
has one encoding, so the places that are alive after a prefix are one for each split of it into
an encoded part and a proper prefix of some token: as many as the longest token has bytes, at
most. `Encoder` determinises these sets of places when an input first reaches them. A state's
output is the last token of the prefix read; as a token's length is known, these outputs give the
encoding back from the end. Where all living places agree, tokens are certain and emitted: in a long piece after
each `HOLD` bytes, back to the look-ahead that the vocabulary needs.

Transitions are arrays (`_Table`, by state and byte). The short pieces of a batch that are not in the table of
pieces run in step, a few array operations a byte for all of them, and so do the transitions that they
are the first to need. The arrays are dropped and begun anew when they hold `max_states`, so memory is bounded
whatever the input. A piece of more than `_SHORT` bytes runs alone, with states of its own.

Text is first split by the vocabulary's pattern, and the pieces are encoded separately; pieces seen
before come from a bounded table.

Decoding. `StreamDecoder` takes tokens in any portions and gives text as soon as it is certain; an
incremental UTF-8 state machine holds back the bytes of an unfinished character.

Cases: null and empty texts give no tokens and the hash of nothing; texts of any length are read
whole; rows are independent, so ties, repeated rows and empty tables change nothing; extra columns are kept, one that
has the name of an output gives way to it. Special tokens' strings inside texts are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm import common

#: Bytes of text, and rows, that are worked on at once.
CHUNK_BYTES, ROWS = 1 << 20, 256
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The bytes that may follow an incomplete character are few: three at most are held back.
_HELD = 3
#: Pieces up to this many bytes run in step, in groups of so many bytes; longer ones run alone.
_SHORT, GROUP_BYTES = 64, 1 << 18
#: Bytes of a long piece between two emissions.
HOLD = 4096
#: A text of more characters is split and encoded in portions.
_LONG = 1 << 18


_NEVER = 1 << 60
_NODE = (1 << 24) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """The merge rule: join the neighbours whose joined bytes have the lowest rank, leftmost first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.self_encoding: dict[bytes, int] = {}
        # The ranks of the two parts that make a token; -1 for single bytes.
        self.left = array("i", [-1]) * (max(ranks.values(), default=0) + 1)
        self.right = array("i", self.left)
        self.rising = True
        for t, r in sorted(ranks.items(), key=lambda x: x[1]):
            parts = [t] if len(t) == 1 else self.merge(t, 2)
            if len(parts) == 2 and all(p in self.self_encoding for p in parts):
                self.left[r], self.right[r] = a, b = [ranks[p] for p in parts]
                self.rising &= a < r and b < r
            elif len(t) > 1:
                continue  # no merges lead to it
            self.self_encoding[t] = r
        self._right_ends: dict[int, tuple] = {}
        self._left_ends: dict[int, tuple] = {}

    def merge(self, piece: bytes, least: int = 1) -> list[bytes]:
        """By the definition, until `least` parts are left; quadratic, for tokens and pairs of them only."""
        parts, get = [piece[i : i + 1] for i in range(len(piece))], self.ranks.get
        while len(parts) > least:
            pairs = [get(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            i = pairs.index(best := min(pairs))
            if best == _NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def encode(self, piece: bytes) -> list[int]:
        return [self.ranks[p] for p in self.merge(piece)]

    def fits(self, a: int, b: int) -> bool:
        """Does b after a keep the border between them?

        If every token's rank is above its parts' (as in trained vocabularies), ranks are times, and
        the border falls exactly if an end part of a and a first part of b, both present at one time,
        join at a rank below that which ends the left part and not above that which ends the right.
        """
        return self._keeps(a, b) if self.rising else self.encode(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def _ends(self, r: int, part: array) -> tuple[tuple[bytes, int], ...]:
        """The parts that a token grows through at one end, each with the rank that ends it."""
        out, upto = [], _NEVER
        while r >= 0:
            out.append((self.bytes_of[r], upto))
            upto, r = r, part[r]
        return tuple(out[::-1])

    def _keeps(self, a: int, b: int) -> bool:
        xs, ys, get = self._right_ends.get(a), self._left_ends.get(b), self.ranks.get
        if xs is None:
            xs = self._right_ends[a] = self._ends(a, self.right)
        if ys is None:
            ys = self._left_ends[b] = self._ends(b, self.left)
        i = j = 0
        (x, x_ends), (y, y_ends) = xs[0], ys[0]
        while True:
            r = get(x + y)
            if r is not None and r < x_ends and r <= y_ends:
                return False
            if x_ends <= y_ends:  # at one rank the left one goes first
                if x_ends == _NEVER:
                    return True
                i += 1
                x, x_ends = xs[i]
            else:
                j += 1
                y, y_ends = ys[j]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """a, or a copy with room for n values at least."""
    return a if n <= a.size else np.concatenate([a, np.zeros(max(n, 2 * a.size) - a.size, a.dtype)])


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of ranges that are not empty, one after the other, and the range of each."""
    n = ends - starts
    own = np.repeat(np.arange(n.size), n)
    return own, np.arange(own.size) + (starts - np.cumsum(n) + n)[own]


class _Table:
    """From non-negative longs to non-negative numbers, whole arrays at once: open addressing, half full at most."""

    def __init__(self, keys: np.ndarray = np.zeros(0, np.int64), values: np.ndarray = np.zeros(0, np.int32)):
        self.bits, self.n = 10, 0
        self._empty()
        self.add(keys, values)

    def _empty(self) -> None:
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 for a key that is not there."""
        slot = self._slot(keys)
        have = self.keys[slot]
        out = np.where(have == keys, self.values[slot], -1)
        open_ = np.flatnonzero((have != keys) & (have >= 0))
        while open_.size:
            slot = (slot if slot.size == open_.size else slot[open_]) + 1 & (1 << self.bits) - 1
            have, want = self.keys[slot], keys[open_]
            hit = have == want
            out[open_[hit]] = self.values[slot[hit]]
            go = ~hit & (have >= 0)
            slot, open_ = slot[go], open_[go]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New keys, each once."""
        self.n += keys.size
        if 2 * self.n > 1 << self.bits:
            old = np.flatnonzero(self.keys >= 0)
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.bits = int(2 * self.n - 1).bit_length()
            self._empty()
        slot = self._slot(keys)
        while keys.size:
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several the last
            won = free & (self.keys[slot] == keys)
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], slot[~won] + 1 & (1 << self.bits) - 1


class Encoder:
    """ids of single pieces, by the transducer."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 400_000):
        self.merges, self.max_states = Merges(ranks), max_states
        # The trie: edge[node << 8 | byte] is a node; node 0 is the root; token[node] is a token or -1.
        edge: dict[int, int] = {}
        token, depth = array("i", [-1]), array("i", [0])
        self.size = np.zeros(len(self.merges.left), np.int64)
        for t, r in self.merges.self_encoding.items():
            n = 0
            for c in t:
                m = edge.setdefault(n << 8 | c, len(token))
                if m == len(token):
                    token.append(-1)
                    depth.append(depth[n] + 1)
                n = m
            token[n], self.size[r] = r, len(t)
        self.edge, self.token, self.depth = edge, np.array(token, np.int32), depth
        self.edges = _Table(np.fromiter(edge, np.int64, len(edge)), np.fromiter(edge.values(), np.int32, len(edge)))
        self.inner = np.zeros(len(token), bool)
        self.inner[np.fromiter(edge, np.int64, len(edge)) >> 8] = True
        self.fitting = _Table()
        self.reset()

    def reset(self) -> None:
        """Begin the states anew.

        State q has the living places at[q] to at[q + 1], from the earliest begun to the trie's root, each a last token
        (-1 before the first) and a trie node. The last token of the last place is that of the prefix read.
        """
        self.n_states, self.at = 1, np.array([0, 1], np.int64)
        self.tokens, self.nodes = np.array([-1], np.int32), np.zeros(1, np.int32)
        self.moves, self.number = _Table(), _Table()

    def _new_states(self, counts: np.ndarray, tokens: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Numbers of states of so many places each."""
        q = self.n_states + np.arange(counts.size)
        first, n = int(self.at[self.n_states]), self.n_states + counts.size
        self.at = _room(self.at, n + 1)
        self.at[self.n_states + 1 : n + 1] = first + np.cumsum(counts)
        self.tokens, self.nodes = _room(self.tokens, first + tokens.size), _room(self.nodes, first + tokens.size)
        self.tokens[first : first + tokens.size], self.nodes[first : first + tokens.size] = tokens, nodes
        self.n_states = n
        return q

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merges.fits of pairs; any b fits a text's start."""
        out = a < 0
        pair = np.flatnonzero(~out)
        key = a[pair].astype(np.int64) << 24 | b[pair]
        known = self.fitting.find(key)
        if (new := key[known < 0]).size:
            new = np.unique(new)
            if self.fitting.n > 2_000_000:
                self.fitting = _Table()
                new = np.unique(key)
            fits = self.merges.fits
            self.fitting.add(new, np.fromiter((fits(k >> 24, k & _NODE) for k in new.tolist()), np.int32, new.size))
            known = self.fitting.find(key)
        out[pair] = known > 0
        return out

    def _determinise(self, keys: np.ndarray) -> None:
        """The states after each state and byte, by state << 8 | byte, that has not been met before."""
        q, c, m = keys >> 8, keys & 255, keys.size
        own, i = _ranges(self.at[q], self.at[q + 1])
        a, n = self.tokens[i], self.edges.find(self.nodes[i].astype(np.int64) << 8 | c[own])
        own, a, n = own[n >= 0], a[n >= 0], n[n >= 0]
        t, found = self.token[n], np.full(m, -1, np.int32)
        k = np.flatnonzero(t >= 0)
        while k.size:  # the first place of each that ends a token and is not yet tried
            first = np.concatenate([[True], own[k[1:]] != own[k[:-1]]])
            f = k[first]
            f = f[self._fit(a[f], t[f])]
            found[own[f]] = t[f]
            k = k[~first]
            k = k[found[own[k]] < 0]
        if (found < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        on = self.inner[n]
        own, a, n = own[on], a[on], n[on]
        counts = np.bincount(own, minlength=m) + 1
        begin = np.cumsum(counts) - counts
        place = begin[own] + np.arange(own.size) - (begin - np.arange(m))[own]
        tokens, nodes = np.empty(int(counts.sum()), np.int32), np.zeros(int(counts.sum()), np.int32)
        tokens[place], nodes[place], tokens[begin + counts - 1] = a, n, found
        which = np.arange(tokens.size) - np.repeat(begin, counts) + 1
        h = common.mix((tokens.astype(np.int64) + 1 << 24 | nodes).view(np.uint64) + which.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        h = (common.mix(np.add.reduceat(h, begin)) >> np.uint64(1)).astype(np.int64)
        h, first, back = np.unique(h, return_index=True, return_inverse=True)
        to = self.number.find(h).astype(np.int64)
        new = np.flatnonzero(to < 0)
        to[new] = self._new_states(counts[first[new]], *(x[_ranges(begin[first[new]], (begin + counts)[first[new]])[1]] for x in (tokens, nodes)))
        self.number.add(h[new], to[new].astype(np.int32))
        to = to[back]
        # Equal hashes are checked by the places; what only shares a hash becomes a state that is met no more.
        unlike = (self.at[to + 1] - self.at[to]) != counts
        own, i = _ranges(begin[~unlike], (begin + counts)[~unlike])
        same = np.flatnonzero(~unlike)
        _, j = _ranges(self.at[to[same]], self.at[to[same] + 1])
        unlike[same[own[(tokens[i] != self.tokens[j]) | (nodes[i] != self.nodes[j])]]] = True
        for x in np.flatnonzero(unlike):
            to[x] = self._new_states(counts[x : x + 1], *(v[begin[x] : begin[x] + counts[x]] for v in (tokens, nodes)))[0]
        self.moves.add(keys, to.astype(np.int32))

    def _in_step(self, group: list[bytes], lens: np.ndarray) -> list[bytes]:
        """Pieces from the longest to the shortest."""
        n, most = len(group), int(lens[0])
        text = np.ascontiguousarray(np.frombuffer(b"".join([p.ljust(most) for p in group]), np.uint8).reshape(n, most).T)
        last, q = np.empty((most, n), np.int32), np.zeros(n, np.int64)
        living = np.searchsorted(-lens, -np.arange(most))  # pieces with a byte at each place
        for j, k in enumerate(living.tolist()):
            key = q[:k] << 8 | text[j, :k]
            q = self.moves.find(key).astype(np.int64)
            if (new := key[q < 0]).size:
                self._determinise(np.unique(new))
                q = self.moves.find(key).astype(np.int64)
            last[j, :k] = self.tokens[self.at[q + 1] - 1]
        # Back from the ends: each round takes the last token of what is left of every piece.
        at, left, own, ids = np.arange(n), lens.copy(), [], []
        while at.size:
            t = last[left[at] - 1, at]
            own.append(at)
            ids.append(t)
            left[at] -= self.size[t]
            at = at[left[at] > 0]
        own, ids = np.concatenate(own[::-1]), np.concatenate(ids[::-1])
        flat = ids[np.argsort(own, kind="stable")].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(own, minlength=n))).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """ids of every piece as little-endian unsigned 32-bit integers."""
        out = [b""] * len(pieces)
        rest, get = [], self.merges.ranks.get
        for i, p in enumerate(pieces):
            whole = get(p)  # a piece that is a token is that token, even if no merges lead to it
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > _SHORT:
                out[i] = b"".join(self.stream(p))
            elif p:
                rest.append(i)
        rest.sort(key=lambda i: -len(pieces[i]))
        lens = np.fromiter((len(pieces[i]) for i in rest), np.int64, len(rest))
        for c in common.chunks(lens, GROUP_BYTES):
            if self.n_states >= self.max_states:
                self.reset()
            for i, ids in zip(rest[c], self._in_step([pieces[i] for i in rest[c]], lens[c]), strict=True):
                out[i] = ids
        return out

    def stream(self, piece: bytes) -> Iterator[bytes]:
        """ids of a piece of any length in portions, each as soon as it is certain. Its states are its own: (last token, node) of each place."""
        states, number, moves = [((-1, 0),)], {}, {}
        q, last, size, edge, token = 0, [], self.size, self.edge, self.token
        for i in range(0, len(piece), HOLD):
            if len(states) > self.max_states:
                states, number, moves, q = [states[q]], {}, {}, 0
            for c in piece[i : i + HOLD]:
                to = moves.get(q << 8 | c)
                if to is None:
                    places, found = [], None
                    for a, n in states[q]:
                        n = edge.get(n << 8 | c)
                        if n is None:
                            continue
                        if found is None and (t := int(token[n])) >= 0 and (a < 0 or self.merges.fits(a, t)):
                            found = t
                        if self.inner[n]:
                            places.append((a, n))
                    if found is None:
                        raise ValueError("the vocabulary lacks a byte")
                    places = (*places, (found, 0))
                    to = moves[q << 8 | c] = number.setdefault(places, len(states))
                    if to == len(states):
                        states.append(places)
                q = to
                last.append(states[q][-1][0])
            # Every living place began at the end of an encoded prefix: go back from these until they meet.
            ends = {len(last) - self.depth[n] for _, n in states[q]} if i + HOLD < len(piece) else {len(last)}
            while len(ends) > 1:
                e = max(ends)
                ends.remove(e)
                ends.add(e - int(size[last[e - 1]]))
            (e,) = ends
            kept, ids = last[e:], []
            while e > 0:
                ids.append(last[e - 1])
                e -= int(size[ids[-1]])
            last = kept
            yield np.array(ids[::-1], "<u4").tobytes()

    def encode(self, piece: bytes) -> list[int]:
        return np.frombuffer(self.encode_many([piece])[0], "<u4").tolist()


class _Pieces(dict):
    """Piece to its ids as little-endian 32-bit integers; two generations, so what is in use stays."""

    def __init__(self, encoder: Encoder, most: int):
        super().__init__()
        self.encoder, self.most, self.older, self.long = encoder, most, {}, []

    def learn(self, pieces: Iterable[str]) -> None:
        """From here to forget_long() the ids of these pieces are here."""
        pieces = list(dict.fromkeys(pieces))
        new = [p for p in pieces if p not in self]
        if len(self) + len(new) > self.most:
            self.older = dict(self)
            self.clear()
            new = pieces
        missing = []
        for p in new:
            ids = self.older.get(p)
            if ids is None:
                missing.append(p)
            else:
                self[p] = ids
        self.update(zip(missing, self.encoder.encode_many([p.encode() for p in missing]), strict=True))
        self.long = [p for p in missing if len(p) > _SHORT]

    def forget_long(self) -> None:
        for p in self.long:
            del self[p]
        self.long = []


class StreamDecoder:
    """Tokens in, text out: give(ids) returns what is certain; end() returns the rest.

    Bytes that no character can hold become U+FFFD, as bytes.decode(errors="replace") has it.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.held = bytes_of, b""

    @staticmethod
    def unfinished(b: bytes) -> int:
        """How many bytes at the end begin a character that is not whole."""
        for back in range(1, min(_HELD, len(b)) + 1):
            c = b[-back]
            if c < 0x80:
                return 0
            if c >= 0xC0:
                need = 2 if c < 0xE0 else 3 if c < 0xF0 else 4
                return back if back < need else 0
        return 0

    def give(self, ids: Iterable[int]) -> str:
        b = self.held + b"".join(map(self.bytes_of.__getitem__, ids))
        n = self.unfinished(b)
        self.held = b[len(b) - n :]
        return b[: len(b) - n].decode("utf-8", "replace")

    def end(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


class Tokenizer:
    """encode(text) to ids and decode(ids) to text, for one vocabulary file."""

    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, cache: int = 100_000):
        self.pattern = regex.compile(pattern)
        ranks = read_ranks(path)
        self.encoder = Encoder(ranks)
        self.bytes_of = self.encoder.merges.bytes_of
        self.pieces = _Pieces(self.encoder, cache)

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(t) if len(t) <= _LONG else None for t in texts]
        get = self.pieces.__getitem__
        self.pieces.learn(itertools.chain.from_iterable(filter(None, split)))
        out = [b"" if x is None else b"".join(map(get, x)) for x in split]
        self.pieces.forget_long()
        for k, x in enumerate(split):
            if x is None:
                out[k] = b"".join(self._portions(texts[k]))
        return out

    def _portions(self, text: str) -> Iterator[bytes]:
        found = (m[0] for m in self.pattern.finditer(text))
        while part := list(itertools.islice(found, _LONG)):
            self.pieces.learn(part)
            yield b"".join(map(self.pieces.__getitem__, part))
            self.pieces.forget_long()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_texts([text])[0], "<u4").tolist()

    def decode(self, ids: Iterable[int], portion: int = 65_536) -> Iterator[str]:
        """Text in portions."""
        decoder, ids = StreamDecoder(self.bytes_of), iter(ids)
        while part := list(itertools.islice(ids, portion)):
            yield decoder.give(part)
        yield decoder.end()


@functools.lru_cache(2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """For a process that keeps it."""
    return Tokenizer(path, pattern)


def resident(path: str, pattern: str):
    """A worker's tokenizer, in a with statement."""
    return common.resident(("bpe", path, pattern), lambda: Tokenizer(path, pattern))


def _with_column(df: DataFrame, source: str, out: str, kind: T.DataType, arrow: pa.DataType, work) -> DataFrame:
    """df with a column out; work(rows of source) in batches of bounded size. A column of that name gives way."""
    names = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(out, kind)])

    def run(it):
        for b in it:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(work(part.column(source).to_pylist()), arrow)], [*names, out])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", path: str = RANKS, pattern: str = public_tokenizers.PATTERN, out: str = "token_ids") -> DataFrame:
    """df with an array<int> column of token ids; a null text gives an empty array. No shuffle."""

    def work(texts):
        with resident(path, pattern) as tok:
            return [np.frombuffer(x, "<i4") for x in tok.encode_texts([t or "" for t in texts])]

    return _with_column(df, text, out, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), work)


def decode(df: DataFrame, ids: str = "token_ids", path: str = RANKS, pattern: str = public_tokenizers.PATTERN, out: str = "decoded") -> DataFrame:
    """df with the text of an array<int> column of token ids; null gives an empty text. No shuffle."""

    def work(rows):
        with resident(path, pattern) as tok:
            return ["".join(tok.decode(x or [])) for x in rows]

    return _with_column(df, ids, out, T.StringType(), pa.string(), work)


def digests(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """Encode and decode each whole text; return counts and hashes, and token_ids only if wanted."""

    def run(it):
        with resident(path, pattern) as tok:
            sha = hashlib.sha256
            for b in common.batches(it, CHUNK_BYTES):
                ids_of = tok.encode_texts([t or "" for t in b.column("text").to_pylist()])
                n, ids_sha, text_sha = [], [], []
                for ids in ids_of:
                    n.append(len(ids) // 4)
                    ids_sha.append(sha(ids).hexdigest())
                    got = sha()
                    for part in tok.decode(memoryview(ids).cast("I")):
                        got.update(part.encode())
                    text_sha.append(got.hexdigest())
                more = [pa.array([np.frombuffer(x, "<i4") for x in ids_of], pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([b.column("doc_id").combine_chunks(), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), *more], [*columns, "token_ids"][: 4 + with_ids])
                common.release()

    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return common.map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
#: SQL has no merges; tests compare with the public library and decode back.
ORACLE_SQL: dict[str, str] = {}
