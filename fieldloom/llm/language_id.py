"""Language identification by prediction by partial matching.

Each language has a variable-order context tree over bytes. A byte costs -log2 of its share after the
longest context the language has seen, or an escape to the next shorter context (method C: as many
escapes as different bytes were seen there), down to a uniform byte. The statistics are frozen, so
a text's code length under a language is exact and does not depend on other texts. The language of
the shortest code is predicted; the score is its share among all, each weighted 2**-bits.

The trees of `GROUP` languages at a time are compiled into one automaton over the union of their contexts: a state is the
longest known context, and a table gives the next state and every language's cost. (Costs do not depend on the grouping; a
worker's tables take some 20 MB a language.) Texts are cut into
pieces that run in step, each warmed up over the `order` bytes before it, which fix the state; so whole
texts are scored whatever their length.

Training takes a bounded sample: of every language the rows of the least hashes of doc_id, about
`sample_rows` of them, whole texts, up to `sample_bytes`; of a first text that is longer, that many bytes. A language is any non-null value
of the label that has a text.

Cases: null texts and texts without a letter are `und` with score 0; without any labelled row all are;
a language without a text that has bytes is not learned; ties go to the first language in order; repeated
rows get equal results; a null doc_id is held out; extra columns are returned, but those named like an output (lang_pred, score,
bits_per_byte) give way to it; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm import common

ORDER = 4
SAMPLE_ROWS, SAMPLE_BYTES = 150, 250_000
GROUP = 4
PIECE = 256
CHUNK_BYTES = 2 << 20
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}").search


OUTPUTS = ["lang_pred", "score", "bits_per_byte"]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


class Model:
    """Frozen counts of contexts of each language; tables are compiled where they are used."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        self.order, self.key = order, uuid.uuid4().hex
        self.languages = sorted(k for k, v in samples.items() if any(v))
        seen = sorted({b for k in self.languages for t in samples[k] for b in set(t)})
        self.seen = np.array(seen, np.uint8)
        # A gram is context and byte as base-256 digits, after a 1 that tells lengths apart.
        self.counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for k in self.languages:
            own = []
            for n in range(1, order + 2):
                keys = []
                for t in samples[k]:
                    b = np.frombuffer(t, np.uint8).astype(np.int64)
                    if b.size >= n:
                        g = np.ones(b.size - n + 1, np.int64)
                        for i in range(n):
                            g = g * 256 + b[i : b.size - n + 1 + i]
                        keys.append(g)
                own.append(np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            self.counts.append(own)

    def compile(self) -> Machine:
        return Machine([Automaton(self, slice(i, i + GROUP)) for i in range(0, len(self.languages), GROUP)])


class Machine:
    """The automata of all groups of languages."""

    def __init__(self, groups: list[Automaton]):
        self.groups = groups

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths [text, language]."""
        return np.concatenate([g.bits(texts) for g in self.groups], axis=1)


class Automaton:
    """next[state, class] and cost[state, class, language] in bits, for some of a model's languages."""

    def __init__(self, model: Model, some: slice = slice(None)):
        all_counts = model.counts[some]
        n_lang, n_sym = len(all_counts), model.seen.size
        self.order, self.pad = model.order, n_sym + 1
        self.class_of = np.full(256, n_sym, np.int32)  # bytes never seen share a class
        self.class_of[model.seen] = np.arange(n_sym)
        levels = [np.ones(1, np.int64)]
        for n in range(1, model.order + 1):
            levels.append(np.unique(np.concatenate([c[n - 1][0] for c in all_counts] or [np.zeros(0, np.int64)])))
        first = np.concatenate([[0], np.cumsum([x.size for x in levels])])
        n_states = int(first[-1])
        self.next = np.zeros((n_states, n_sym + 2), np.int32)
        self.cost = np.zeros((n_states, n_sym + 2, n_lang), np.float32)
        uniform = np.full((n_sym + 2, n_lang), 8.0, np.float32)
        for n, own in enumerate(levels):
            # In place: a copy of the longest contexts' rows would take more than half of the table once again.
            cost, to = self.cost[first[n] : first[n + 1]], self.next[first[n] : first[n + 1]]
            if n:
                high, before = 1 << 8 * (n - 1), slice(first[n - 1], first[n])
                shorter = np.searchsorted(levels[n - 1], own % high + high)
                np.take(self.cost[before], shorter, axis=0, out=cost, mode="clip")
                np.take(self.next[before], shorter, axis=0, out=to, mode="clip")
            else:
                cost[:] = uniform
            for k in range(n_lang):
                grams, counts = all_counts[k][n]
                at = np.searchsorted(own, grams >> 8)
                sym = self.class_of[grams & 255]
                total = np.bincount(at, counts, own.size)
                kinds = np.bincount(at, minlength=own.size)
                known, escape = total > 0, np.zeros(own.size)
                escape[known] = np.log2((total + kinds)[known] / kinds[known])
                cost[:, :, k] += escape[:, None]
                cost[at, sym, k] = np.log2((total + kinds)[at] / counts)
            if n < model.order:
                longer = levels[n + 1]
                to[np.searchsorted(own, longer >> 8), self.class_of[longer & 255]] = first[n + 1] + np.arange(longer.size)
        self.cost[:, self.pad] = 0
        self.next[:, self.pad] = 0

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths [text, language]."""
        n_lang = self.cost.shape[2]
        out = np.zeros((len(texts), n_lang))
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        pieces = -(-lens // PIECE)
        n = int(pieces.sum())
        if not n:
            return out
        doc = np.repeat(np.arange(len(texts)), pieces)
        number = np.arange(n) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.cumsum(lens) - lens
        codes = np.concatenate([np.full(self.order, self.pad, np.int32), self.class_of[np.frombuffer(b"".join(texts), np.uint8)], np.full(PIECE, self.pad, np.int32)])
        begin = start[doc] + number * PIECE
        end = (start + lens)[doc]
        state, total = np.zeros(n, np.int32), np.zeros((n, n_lang), np.float32)
        width = self.next.shape[1]
        follow, cost = self.next.reshape(-1), self.cost.reshape(-1, n_lang)
        for i in range(-self.order, PIECE):
            p = begin + i
            inside = (p < end) & (p >= start[doc])
            c = np.where(inside, codes[p + self.order], self.pad)
            at = state * width + c
            if i >= 0:
                total += cost[at]
            state = follow[at]
        np.add.at(out, doc, total)
        return out


def train(docs: DataFrame, label: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, order: int = ORDER) -> Model:
    """Learn from (doc_id, text, label); see the module's bounds."""
    rows = docs.select(F.col(label).cast("string").alias("label"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("r"), "text").where("label IS NOT NULL AND text <> ''")
    counted = common.checkpoint(rows.groupBy("label").agg(F.count("*").alias("n"), F.min("r").alias("first"), F.count("*").alias("all")))
    share = F.greatest(F.col("first"), F.ceil(F.lit(float((1 << 30) * sample_rows)) / F.col("all")))  # one row at least
    some = common.split_join(rows, counted, ["label"]).where(F.col("r") <= share).select("label", "r", "text")
    samples: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for r in some.orderBy("r", "text").toLocalIterator():
        t, have = r["text"].encode(), size.get(r["label"], 0)
        if not have or have + len(t) <= sample_bytes:
            samples.setdefault(r["label"], []).append(t[:sample_bytes])
            size[r["label"]] = have + min(len(t), sample_bytes)
    return Model(samples, order)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns with lang_pred, score and bits_per_byte (null where there is nothing to score). No shuffle."""
    docs = docs.drop(*OUTPUTS)
    sent, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    key, languages = model.key, model.languages

    def run(it):
        with common.resident(("language_id", key), lambda: sent.value.compile()) as machine:
            yield from scored(it, machine)

    def scored(it, machine):
        for t in common.batches(it, CHUNK_BYTES):
            texts = common.texts_of(t.column("text"))
            usable = [bool(languages and x and _LETTER(x.decode("utf-8", "replace"))) for x in texts]
            some = [x for x, u in zip(texts, usable, strict=True) if u]
            lang, score, rate = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if some:
                bits = machine.bits(some)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1)[:, None], 1000)).sum(axis=1)
                for i, b, s, x, n in zip(np.flatnonzero(usable).tolist(), best.tolist(), share.tolist(), bits.min(axis=1).tolist(), map(len, some), strict=True):
                    lang[i], score[i], rate[i] = languages[b], s, x / n
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], [*names, *OUTPUTS])

    schema = T.StructType(list(docs.schema)).add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    return common.map_texts(docs, run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language_id": op3_language_id}
#: A trained model is not SQL; tests check exact code lengths and held-out accuracy.
ORACLE_SQL: dict[str, str] = {}
