"""What several text operators share: table reading, checkpoints, packed arrays, word hashes.

The operators that move one value per word or byte do not move one Spark row for each. They pack
the values of a batch of documents into one binary cell per (batch, bucket), so a shuffled value
costs about its own bytes, and give the answer back per batch. A batch is a run of rows of one
input partition, so the input must give the same rows in the same order when a lost task is run
again: a table scan or a checkpoint does; anything else should be checkpointed first.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import threading
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.plans.checkpoints import checkpoint, ensure_checkpoint_dir  # noqa: F401

U64 = np.uint64
MASK64 = (1 << 64) - 1
ASCII_SPACE = bytes([9, 10, 11, 12, 13, 32])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tidy(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files (and, where the session says so, the checkpoints) that nothing refers to any more.

    It does so when the driver collects its garbage, which a driver with a free heap seldom does; until then, files of steps that are over fill the disk.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: The optimizer's size of what it knows nothing about is beyond this.
UNKNOWN_BYTES = 1 << 55


def size_in_bytes(docs: DataFrame) -> int:
    """The optimizer's estimate of the input (for a Parquet scan, the size of its files), or the bytes of all texts where it has none."""
    stated = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if stated < UNKNOWN_BYTES:
        return stated
    return int(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)


#: Input for each task of an exchange whose number of tasks follows the input.
TASK_BYTES, LEAST_TASKS = 16 << 20, 32


def spread(df: DataFrame, key: str, size: int) -> DataFrame:
    """df dealt by key to as many tasks as an input of so many bytes needs, whatever the session's number is."""
    return df.repartition(max(LEAST_TASKS, -(-size // TASK_BYTES)), key)


#: A key with more than this part of all rows is hot.
HOT_PART = 1024


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left ⋈ right with hot keys apart; right has every key of left once, n rows of left each, and is checkpointed. n is left out.

    Fewer than `HOT_PART` keys can have more than that part of the rows: this bounds what is broadcast, and rows of
    hot keys are not dealt by key at all. The rest is an ordinary join. Rows with a null key match nothing.
    """
    total, top = right.agg(F.sum("n"), F.max("n")).first()
    values = right.drop("n")
    if not total or top <= total / HOT_PART:
        return left.join(values, on, how)
    hot = F.broadcast(right.where(F.col("n") > total / HOT_PART).drop("n"))
    known = left.dropna(subset=on)
    rest = known.join(hot.select(on), on, "left_anti").join(right.where(F.col("n") <= total / HOT_PART).drop("n"), on, how)
    out = known.join(hot, on).unionByName(rest)
    if how == "inner":
        return out
    some_null = F.lit(False)
    for c in on:
        some_null = some_null | F.col(c).isNull()
    return out.unionByName(left.where(some_null), allowMissingColumns=True)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): th tells rows of the same doc_id and different text apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text"))


#: Bytes of rows that go to a worker at once.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_texts(df: DataFrame, work: Callable, schema) -> DataFrame:
    """df.mapInArrow(work, schema) for rows with texts, in batches of `BATCH_BYTES` or less.

    Spark's own bound is 64 MB, which the JVM and the worker of every running task hold more than once, whatever the worker does with it.
    The session keeps the setting, as plans read it when they run; one that the user has made stays.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


# --- a worker's memory -------------------------------------------------------------------------

#: A worker without a task for so long gives its tables up.
IDLE_SECONDS = 3.0
_RESIDENT: dict = {}
_IN_USE: list[tuple] = []
_WAITING: list[threading.Timer] = []
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


@contextlib.contextmanager
def resident(key: tuple, build: Callable):
    """What build() makes, for one task, and for the next one of this worker that asks for the same.

    Spark keeps Python workers between tasks and hands them to whatever operator comes next. So a worker
    holds the tables of one operator at a time, and none once it has been idle for `IDLE_SECONDS` or reads `batches` for an operator without tables.
    """
    while _WAITING:
        _WAITING.pop().cancel()
    held = _RESIDENT.get(key)  # a timer already running may empty the table at any point
    if held is None:
        forget()
        held = _RESIDENT[key] = build()
    _IN_USE.append(key)
    try:
        yield held
    finally:
        _IN_USE.remove(key)
        forget_when_idle()


def forget_when_idle() -> None:
    _WAITING.append(threading.Timer(IDLE_SECONDS, forget))
    _WAITING[-1].daemon = True
    _WAITING[-1].start()


def forget() -> None:
    _RESIDENT.clear()
    for x in (BYTES_1, BYTES_2, WORDS_1, WORDS_2):
        x.clear()
    gc.collect()
    release()


def release() -> None:
    """Give what Arrow's pool and the C allocator hold without use back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


# --- packed arrays -----------------------------------------------------------------------------

_KINDS = (np.uint8, np.uint16, np.uint32, np.uint64)


def pack(a: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest width that holds them."""
    a = np.asarray(a)
    top = int(a.max()) if a.size else 0
    k = 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2 if top < 1 << 32 else 3
    return bytes([k]) + a.astype(_KINDS[k]).tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, _KINDS[b[0]], offset=1).astype(np.int64)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending integers, as a first value and gaps."""
    a = np.asarray(a, np.int64)
    return (a[:1].tobytes() + pack(np.diff(a))) if a.size else b""


def unpack_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum(unpack(b[8:]))]) + np.frombuffer(b[:8], np.int64)[0]


# --- hashes ------------------------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (shift, multiply, shift)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand and given up with a worker's tables."""

    STEP = 1 << 18

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.clear()

    def clear(self) -> None:
        self.tables = np.ones(1, U64), np.ones(1, U64)

    def grown(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.tables
        most = -(-n // self.STEP) * self.STEP
        while up.size < n:
            m = up.size
            more = min(m, most - m)
            up = np.concatenate([up, up[:more] * U64(pow(self.base, m, 1 << 64))])
            down = np.concatenate([down, down[:more] * U64(pow(self.inverse, m, 1 << 64))])
        self.tables = up, down
        return up, down

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Polynomial hash of values[s:e] for each span: it depends on the values only, not on s."""
        n = values.size
        up, down = self.grown(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum(values * up[:n], out=sums[1:])
        return (sums[ends] - sums[starts]) * down[starts]


BYTES_1, BYTES_2 = Powers(0x9E3779B97F4A7C15), Powers(0xD1B54A32D192ED03)
WORDS_1, WORDS_2 = Powers(0xA0761D6478BD642F), Powers(0xE7037ED1A0B428DB)

#: Word bytes of `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(ASCII_SPACE)] = False
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[65:91] += 32


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a newline after each, and where each starts (one more for the end)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return buf, np.concatenate([[0], np.cumsum(lens)])


def word_spans(buf: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that `inside` allows; buf ends with none."""
    m = inside[buf]
    edge = np.flatnonzero(m[1:] != m[:-1]) + 1
    if m.size and m[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def word_hashes(texts: list[bytes], inside: np.ndarray = NOT_SPACE, fold: np.ndarray = IDENTITY, both: bool = True):
    """Two independent 64-bit hashes of every word, and the number of words of each text."""
    buf, at = joined(texts)
    s, e = word_spans(buf, inside)
    values = fold[buf].astype(U64) + U64(1)
    h1 = mix(BYTES_1.spans(values, s, e))
    h2 = mix(BYTES_2.spans(values, s, e)) if both else None
    return h1, h2, np.diff(np.searchsorted(s, at))


def chunks(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of neighbours with about `most` in all, one at least."""
    i = 0
    total = np.concatenate([[0], np.cumsum(sizes)])
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        yield slice(i, j)
        i = j


def batches(it: Iterator[pa.RecordBatch], most: int, text: str = "text") -> Iterator[pa.Table]:
    """Rows of a partition in runs of about `most` bytes of text."""
    if _RESIDENT and not _IN_USE:
        forget()
    kept, have = [], 0
    for b in it:
        if not b.num_rows:
            continue
        lens = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
        for c in chunks(lens, most):
            kept.append(b.slice(c.start, c.stop - c.start))
            have += int(lens[c].sum())
            if have >= most:
                yield pa.Table.from_batches(kept)
                kept, have = [], 0
    if kept:
        yield pa.Table.from_batches(kept)
    kept = None
    release()
    forget_when_idle()


def texts_of(column) -> list[bytes]:
    """UTF-8 of every text; null counts as empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def split_by(keys: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """values in runs of equal keys, which are in order."""
    return np.split(values, np.flatnonzero(np.diff(keys)) + 1) if keys.size else []


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    d = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places some [start, end) covers."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0
