"""Substring dedup over bytes, by suffix arrays.

A byte goes if a `LENGTH`-byte string that covers it starts anywhere else too. Matches stay inside one
document and are judged on the input.

Candidates. The least hashed gram (`GRAM` bytes) of a string is its anchor, so equal strings have
equal anchors; neighbouring starts with one anchor form a segment. Anchors and whole segments are hashed,
packed by (batch, bucket) and counted: a segment that occurs twice as a whole is repeated; of such
copies one stands for all from here on. An anchor that occurs once has nothing repeated. What
is left, different segments of one anchor, is decided by suffix arrays.

Suffix arrays. Segments are dealt to shards by anchor. A shard sorts the suffixes of its segments by
their first eight bytes and refines the groups that are still equal by doubling (Larsson and Sadakane),
gets common prefixes by Kasai's rule, many blocks of the text in step, and so the classes of starts
that share `LENGTH` bytes. An anchor of very many different segments (`HOT`) is dealt to shards by
document instead; each sorts its own, and shards are merged by hashes of their classes: every shard's
sorted hashes are looked up in the others' by binary search, in buckets. So no task gets one anchor's
documents, and everything sent is one value per batch for equal things.

Two different segments are taken for one if 128 bits of hash agree; classes of different shards if 64
bits and the bucket do.

Cases: null, empty and short texts lose nothing; a null doc_id is a value like any other; rows of equal
doc_id and text get equal results, and each is elsewhere to the other, so their whole text goes; texts are read whole; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import common
from fieldloom.llm.common import U64, pack, pack_sorted, unpack, unpack_sorted
from fieldloom.llm.decontaminate import least
from fieldloom.llm.substring_dedup import LAST_ID, _ids, _join, _split, batch_bytes, buckets_for

LENGTH, GRAM = 200, 100
CHUNK_BYTES = 1 << 20
#: Text of a batch of documents whose segments are to be decided.
BATCH_BYTES = 4 << 20
#: Different segments of one anchor in one batch, and among all batches, from which on it is dealt by document.
LOCAL_HOT, HOT = 16, 256
LANE = 256
_MULTI, _MARK = 1, 2
_FULL, _FINE, _HOT = 1, 2, 4

_EXCHANGE = "bucket long, batch long, kind int, a binary, b binary, places binary, flags binary"
_CODES = "batch long, kind int, bucket long, a binary, b binary, places binary, flags binary"
_FOUND = "doc_id long, th long, starts binary, ends binary, fine binary"
_SPANS = "doc_id long, th long, starts binary, ends binary"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


# --- candidates ----------------------------------------------------------------------------------


def segments(texts: list[bytes]):
    """doc, lo, width, anchor - lo, anchor hash, segment hash of every segment; starts lo to lo + width - 1, from the text's start."""
    buf, at = common.joined(texts)
    n = buf.size
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U64),) * 2
    values = buf.astype(U64) + U64(1)
    i = np.arange(n - GRAM + 1)
    gram = common.mix(common.BYTES_1.spans(values, i, i + GRAM))
    # 32 bits of hash, then the place: at equal bits the leftmost, wherever the string stands.
    first = (least((gram & U64(0xFFFFFFFF00000000)) | i.astype(U64), LENGTH - GRAM + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    own = np.repeat(at[1:] - 1, np.diff(at))[: first.size]
    fits = i[: first.size] + LENGTH <= own
    p = np.flatnonzero(fits)
    if not p.size:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U64),) * 2
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 1) | (np.diff(first[p]) != 0)]))
    lo, hi = p[cut], p[np.append(cut[1:], p.size) - 1]
    anchor = first[lo]
    whole = common.mix(common.BYTES_2.spans(values, lo, hi + LENGTH) ^ (hi - lo).astype(U64))
    doc = np.searchsorted(at, lo, "right") - 1
    return doc, lo - at[doc], hi - lo + 1, anchor - lo, gram[anchor], whole


def segments_by_bucket(docs: DataFrame, n_buckets: int, local_hot: int = LOCAL_HOT) -> DataFrame:
    """kind 0: the anchors of one bucket; kind 1: the batch's documents and segments, and what is decided."""

    narrow = np.uint16 if n_buckets <= 1 << 16 else np.uint32

    def run(it):
        part, n = TaskContext.get().partitionId(), 0
        for t in common.batches(it, batch_bytes(n_buckets)):
            batch, n = (part << 24) + n, n + 1
            texts = common.texts_of(t.column("text"))
            got, base = [], 0
            for c in common.chunks(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, CHUNK_BYTES):
                doc, *rest = segments(texts[c])
                got.append((doc + base, *rest))
                base = c.stop
            doc, lo, width, anchor, mh, sh = (np.concatenate(x) for x in zip(*got, strict=True))
            by = np.lexsort((sh, mh))
            m, s = mh[by], sh[by]
            new_m = np.concatenate([[True], m[1:] != m[:-1]])[: m.size]
            new = new_m | np.concatenate([[True], s[1:] != s[:-1]])[: m.size]
            head = np.flatnonzero(new)
            copies = np.diff(np.append(head, m.size))
            group = (np.cumsum(new_m) - 1)[head]
            many = (np.bincount(group) > local_hot)[group] if head.size else np.zeros(0, bool)
            opens = new_m[head]
            place = by[head]
            flag = np.where(copies > 1, _MULTI, 0) | np.where(many, _MARK, 0)
            sent = np.flatnonzero(~many | opens)
            sent = sent[np.argsort(place[sent], kind="stable")]
            bucket = (mh[place[sent]] % U64(n_buckets)).astype(narrow)
            order = np.argsort(bucket, kind="stable")
            rows = []
            for k in common.split_by(bucket[order], order):
                x = sent[k]
                rows.append((int(bucket[k[0]]), batch, 0, mh[place[x]].tobytes(), sh[place[x]].tobytes(), pack_sorted(place[x]), flag[x].astype(np.uint8).tobytes()))
            state = np.zeros(doc.size, np.uint8)
            state[by[~new]] = _FULL
            state[place[many]] |= np.where(copies[many] > 1, _FULL, 0).astype(np.uint8) | np.uint8(_FINE | _HOT)
            ids, th = _ids(t.column("doc_id").combine_chunks()), t.column("th").to_numpy().astype(np.int64)
            known = _join([ids.tobytes(), th.tobytes(), pack(np.bincount(doc, minlength=ids.size)), pack(lo), pack(width), pack(anchor)])
            rows.append((batch % n_buckets, batch, 1, known, None, None, state.tobytes()))
            yield _table(rows, _EXCHANGE)

    return docs.mapInArrow(run, _EXCHANGE)


def count_segments(exchange: DataFrame, size: int, most: int = HOT) -> DataFrame:
    """By batch: which segments are repeated as a whole, and which need a suffix array."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        out = [(r["batch"], 1, None, r["a"], None, None, r["flags"]) for r in rows if r["kind"] == 1]
        rows = [r for r in rows if r["kind"] == 0]
        if rows:
            mh, sh = (np.concatenate([np.frombuffer(r[k], U64) for r in rows]) for k in "ab")
            flag = np.concatenate([np.frombuffer(r["flags"], np.uint8) for r in rows])
            by = np.lexsort((sh, mh))
            m, s, f = mh[by], sh[by], flag[by]
            new_m = np.concatenate([[True], m[1:] != m[:-1]])
            new = new_m | np.concatenate([[True], s[1:] != s[:-1]])
            head, top = np.flatnonzero(new), np.flatnonzero(new_m)
            cls, grp = np.cumsum(new) - 1, np.cumsum(new_m) - 1
            full = (np.add.reduceat(np.ones(m.size, np.int64), head) > 1) | (np.bitwise_or.reduceat(f, head) & _MULTI > 0)
            marked = np.bitwise_or.reduceat(f, top) & _MARK > 0
            kinds = np.bincount(grp[head])
            fine, hot = marked | (kinds > 1), marked | (kinds >= most)
            code = np.where(full[cls], _FULL, 0) | np.where(fine[grp] & (~full[cls] | new), _FINE, 0) | np.where(hot[grp], _HOT, 0)
            codes = np.zeros(m.size, np.uint8)
            codes[by] = np.where(code & (_FULL | _FINE), code, 0)
            i = 0
            for r in rows:
                n = len(r["flags"])
                x = np.flatnonzero(codes[i : i + n])
                if x.size:
                    out.append((r["batch"], 0, r["bucket"], None, None, pack_sorted(unpack_sorted(r["places"])[x]), codes[i : i + n][x].tobytes()))
                i += n
        return pa.Table.from_batches([_table(out, _CODES)])

    return common.spread(exchange, "bucket", size).groupBy("bucket").applyInArrow(run, _CODES)


def gather(codes: DataFrame, size: int) -> DataFrame:
    """Per document: starts known to be repeated, and the segments (lo, width, anchor, bucket, hot) to be decided."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        whole = next(r for r in rows if r["kind"] == 1)
        ids, th, counts, lo, width, anchor = _split(whole["a"], 6)
        ids, th = np.frombuffer(ids, np.int64), np.frombuffer(th, np.int64)
        lo, width, anchor = unpack(lo), unpack(width), unpack(anchor)
        state = np.frombuffer(whole["flags"], np.uint8).copy()
        bucket = np.zeros(state.size, np.int64)
        for r in rows:
            if r["kind"] == 0:
                p = unpack_sorted(r["places"])
                state[p] |= np.frombuffer(r["flags"], np.uint8)
                bucket[p] = r["bucket"]
        at = np.concatenate([[0], np.cumsum(unpack(counts))])
        out = []
        for d in np.flatnonzero(np.add.reduceat(np.append(state > 0, False).astype(np.int64), at[:-1]) * (np.diff(at) > 0)) if ids.size else ():
            x = slice(at[d], at[d + 1])
            full, fine = state[x] & _FULL > 0, state[x] & _FINE > 0
            starts, ends = lo[x][full], (lo + width)[x][full]
            sent = None
            if fine.any():
                sent = _join([pack(v[x][fine]) for v in (lo, width, anchor, bucket, state & _HOT)])
            out.append((int(ids[d]), int(th[d]), pack_sorted(starts), pack(ends), sent))
        return pa.Table.from_batches([_table(out, _FOUND)])

    return common.spread(codes, "batch", size).groupBy("batch").applyInArrow(run, _FOUND)


# --- suffix arrays ---------------------------------------------------------------------------------


def suffix_array(s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `depth` bytes at least, and every suffix's place (equal ones share the first)."""
    n = s.size
    padded = np.concatenate([s, np.zeros(8, np.uint8)])
    key = np.zeros(n, U64)
    for i in range(8):
        key = (key << U64(8)) | padded[i : i + n].astype(U64)
    # The end of the text is below every byte: it shortens the key where zeros would do.
    order = np.lexsort((np.minimum(n - np.arange(n), 8), key)) if n < 8 or (s == 0).any() else np.argsort(key, kind="stable")
    k, tail = key[order], np.minimum(n - order, 8)
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (tail[1:] != tail[:-1])])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    h = 8
    while h < depth:
        tied = ~(new & np.append(new[1:], True))  # places whose group has company
        at = np.flatnonzero(tied)
        if not at.size:
            break
        i = order[at]
        beyond = np.where(i + h < n, rank[np.minimum(i + h, n - 1)], -1)
        r = rank[i]
        by = np.lexsort((beyond, r))
        i, r, beyond = i[by], r[by], beyond[by]
        order[at] = i
        new[at] = np.concatenate([[True], (r[1:] != r[:-1]) | (beyond[1:] != beyond[:-1])])
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[at]] = start[at]
        h *= 2
    return order, rank


def common_prefixes(s: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """lcp[j] of the suffixes at places j - 1 and j, up to `most`: Kasai's rule, blocks of the text in step."""
    n = s.size
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    lcp = np.zeros(n, np.int64)
    padded = np.concatenate([s, np.zeros(8, np.uint8)])
    eight = np.ndarray((n,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    lanes = np.arange(0, n, LANE)
    have = np.zeros(lanes.size, np.int64)
    for step in range(LANE):
        i = lanes + step
        live = i < n
        i, p = i[live], before[np.minimum(i[live], n - 1)]
        l = np.where(p >= 0, np.maximum(have[live] - 1, 0), 0)  # noqa: E741
        go = np.flatnonzero(p >= 0)
        while go.size:
            x, y = i[go] + l[go], p[go] + l[go]
            ok = (l[go] + 8 <= most) & (np.maximum(x, y) + 8 <= n)
            ok &= eight[np.minimum(x, n - 1)] == eight[np.minimum(y, n - 1)]
            go = go[ok]
            l[go] += 8
        go = np.flatnonzero(p >= 0)
        while go.size:
            x, y = i[go] + l[go], p[go] + l[go]
            ok = (l[go] < most) & (x < n) & (y < n)
            ok &= padded[np.minimum(x, n)] == padded[np.minimum(y, n)]
            go = go[ok]
            l[go] += 1
        have[live] = l
        lcp[i] = l
    return lcp[order]


def classes(texts: list[bytes], widths: np.ndarray):
    """For every start of every segment: its class of equal LENGTH-byte strings. Returns (segment, start, class)."""
    s = np.frombuffer(b"".join(texts), np.uint8)
    order, _ = suffix_array(s, s.size)  # to the end: Kasai's rule needs suffixes in full order
    cls = np.empty(s.size, np.int64)
    cls[order] = np.cumsum(common_prefixes(s, order, LENGTH) < LENGTH)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    seg = np.repeat(np.arange(len(texts)), widths)
    start = np.arange(int(widths.sum())) - np.repeat(np.cumsum(widths) - widths, widths)
    at = (np.cumsum(size) - size)[seg] + start
    return seg, start, cls[at], s, at


def _by_document(ids, th, lo, seg, start) -> list[tuple]:
    """Rows of _SPANS for the flagged starts."""
    if not seg.size:
        return []
    out = []
    key = np.lexsort((th[seg], ids[seg]))
    seg, place = seg[key], (lo[seg] + start)[key]
    i, t = ids[seg], th[seg]
    cut = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])]))
    for a, b in zip(cut, np.append(cut[1:], seg.size), strict=True):
        p = np.unique(place[a:b])
        first = np.flatnonzero(np.concatenate([[True], np.diff(p) > 1]))
        out.append((int(i[a]), int(t[a]), pack_sorted(p[first]), pack(p[np.append(first[1:], p.size) - 1] + 1)))
    return out


def _pick(t: pa.Table, hot: bool):
    """The segments that are to be decided: arrays doc_id, th, lo, width, bucket and their texts."""
    got = []
    for i, th, text, fine in zip(_ids(t.column("doc_id").combine_chunks()).tolist(), t.column("th").to_pylist(), common.texts_of(t.column("text")), t.column("fine").to_pylist(), strict=True):
        lo, width, _, bucket, is_hot = (np.concatenate(x) for x in zip(*([unpack(v) for v in _split(f, 5)] for f in fine), strict=True))
        _, one = np.unique(lo, return_index=True)
        lo, width, bucket, is_hot = lo[one], width[one], bucket[one], is_hot[one]
        for a, w, b, h in zip(lo.tolist(), width.tolist(), bucket.tolist(), is_hot.tolist(), strict=True):
            if bool(h) == hot:
                got.append((i, th, a, w, b, text[a : a + w - 1 + LENGTH]))
    cols = list(zip(*got, strict=True)) or [[]] * 6
    return (*(np.array(c, np.int64) for c in cols[:5]), list(cols[5]))


def sharded(todo: DataFrame) -> DataFrame:
    """Repeated starts by one suffix array for each bucket of anchors."""

    def send(it):
        for t in common.batches(it, BATCH_BYTES):
            ids, th, lo, width, bucket, texts = _pick(t, False)
            by = np.argsort(bucket, kind="stable")
            rows = []
            for x in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if by.size else ():
                own = [texts[k] for k in x]
                rows.append((int(bucket[x[0]]), _join([ids[x].tobytes(), th[x].tobytes(), pack(lo[x]), pack(width[x])]), b"".join(own)))
            yield _table(rows, "bucket long, a binary, b binary")

    def run(t: pa.Table) -> pa.Table:
        parts, texts = [], []
        for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True):
            ids, th, lo, width = _split(a, 4)
            width = unpack(width)
            end = np.cumsum(width - 1 + LENGTH)
            texts += [b[i:j] for i, j in zip(np.append(0, end[:-1]).tolist(), end.tolist(), strict=True)]
            parts.append((np.frombuffer(ids, np.int64), np.frombuffer(th, np.int64), unpack(lo), width))
        ids, th, lo, width = (np.concatenate(x) for x in zip(*parts, strict=True))
        seg, start, cls, _, _ = classes(texts, width)
        again = np.bincount(cls)[cls] > 1
        return pa.Table.from_batches([_table(_by_document(ids, th, lo, seg[again], start[again]), _SPANS)])

    return todo.mapInArrow(send, "bucket long, a binary, b binary").groupBy("bucket").applyInArrow(run, _SPANS)


def merged(todo: DataFrame, n_buckets: int) -> DataFrame:
    """Repeated starts of hot anchors: a suffix array for each batch of documents, merged by their classes' hashes."""

    def send(it):
        part, n = TaskContext.get().partitionId(), 0
        for t in common.batches(it, BATCH_BYTES):
            ids, th, lo, width, _, texts = _pick(t, True)
            if not ids.size:
                continue
            shard, n = (part << 24) + n, n + 1
            seg, start, cls, s, at = classes(texts, width)
            _, first, cls, count = np.unique(cls, return_index=True, return_inverse=True, return_counts=True)
            values = s.astype(U64) + U64(1)
            h = common.mix(common.BYTES_1.spans(values, at[first], at[first] + LENGTH))
            bucket = (common.mix(common.BYTES_2.spans(values, at[first], at[first] + LENGTH)) % U64(n_buckets)).astype(np.int64)
            by = np.lexsort((h, bucket))
            rows = [(int(bucket[x[0]]), shard, 0, h[x].tobytes(), None, pack(x), None) for x in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1)]
            known = _join([ids.tobytes(), th.tobytes(), pack(lo), pack(seg), pack(start), pack(cls)])
            rows.append((shard % n_buckets, shard, 1, known, None, None, (count > 1).tobytes()))
            yield _table(rows, _EXCHANGE)

    def meet(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        out = [(r["batch"], 1, None, r["a"], None, None, r["flags"]) for r in rows if r["kind"] == 1]
        shards = [(r, np.frombuffer(r["a"], U64)) for r in rows if r["kind"] == 0]
        everything = np.sort(np.concatenate([h for _, h in shards])) if shards else None
        for r, h in shards:
            # Each shard has a class once: more than one place in the merged order is another shard.
            x = np.searchsorted(everything, h, "right") - np.searchsorted(everything, h, "left") > 1
            if x.any():
                out.append((r["batch"], 0, None, None, None, pack(unpack(r["places"])[x]), None))
        return pa.Table.from_batches([_table(out, _CODES)])

    def back(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        whole = next(r for r in rows if r["kind"] == 1)
        ids, th, lo, seg, start, cls = _split(whole["a"], 6)
        again = np.frombuffer(whole["flags"], bool).copy()
        for r in rows:
            if r["kind"] == 0:
                again[unpack(r["places"])] = True
        seg, start = unpack(seg), unpack(start)
        x = again[unpack(cls)]
        return pa.Table.from_batches([_table(_by_document(np.frombuffer(ids, np.int64), np.frombuffer(th, np.int64), unpack(lo), seg[x], start[x]), _SPANS)])

    # A task that is run again must make the same batches: (doc_id, th) is unique here and gives their order.
    return todo.sortWithinPartitions("doc_id", "th").mapInArrow(send, _EXCHANGE).groupBy("bucket").applyInArrow(meet, _CODES).groupBy("batch").applyInArrow(back, _SPANS)


# --- the operator ----------------------------------------------------------------------------------


def repeated_starts(docs: DataFrame, local_hot: int = LOCAL_HOT, most: int = HOT) -> DataFrame:
    """(doc_id, th, starts, ends): per document, ranges of starts whose LENGTH-byte string also starts elsewhere; several rows at times. A null doc_id is LAST_ID."""
    keyed, size = common.keyed(docs), common.size_in_bytes(docs)
    n_buckets = buckets_for(size)
    found = common.checkpoint(gather(count_segments(segments_by_bucket(keyed, n_buckets, local_hot), size, most), size))
    # Repeated rows can have different segments to decide; one of them stands for all in the suffix arrays, so a row that has company is whole elsewhere.
    todo = found.where("fine IS NOT NULL").groupBy("doc_id", "th").agg(F.collect_list("fine").alias("fine"))
    text = keyed.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), "th", "text")
    todo = todo.join(text, ["doc_id", "th"]).groupBy("doc_id", "th").agg(F.first("text").alias("text"), F.first("fine").alias("fine"), F.count("*").alias("n"))
    spans = found.select("doc_id", "th", "starts", "ends").unionByName(whole(todo.where("n > 1")))
    return spans.unionByName(sharded(todo)).unionByName(merged(todo, n_buckets))


def whole(rows: DataFrame) -> DataFrame:
    """All starts of rows(doc_id, th, text)."""

    def run(it):
        for b in it:
            first, size = pack_sorted(np.zeros(1, np.int64)), b.column("n").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array([first] * b.num_rows, pa.binary()), pa.array([pack(np.array([n - LENGTH + 1])) for n in size], pa.binary())], ["doc_id", "th", "starts", "ends"])

    return rows.select("doc_id", "th", F.octet_length("text").cast("long").alias("n")).mapInArrow(run, _SPANS)


def removal(docs: DataFrame, local_hot: int = LOCAL_HOT, most: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (binary: what is left may break a character), kept_sha256."""
    starts = repeated_starts(docs, local_hot, most).groupBy("doc_id", "th").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    d = common.keyed(docs)
    key = d.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("key"), "doc_id", "th", "text")
    both = key.join(starts.withColumnRenamed("doc_id", "key"), ["key", "th"], "left").select("doc_id", "text", "starts", "ends")

    def run(it):
        for b in it:
            out = []
            for t, s, e in zip(common.texts_of(b.column("text")), b.column("starts").to_pylist(), b.column("ends").to_pylist(), strict=True):
                n, spans, kept = 0, 0, t
                if s:
                    s, e = np.concatenate([unpack_sorted(x) for x in s]), np.concatenate([unpack(x) for x in e])
                    if s.size:
                        gone = common.covered(len(t), s, e - 1 + LENGTH)
                        n, spans = int(gone.sum()), common.runs(gone)[0].size
                        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
                out.append((len(t), n, spans, kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(common.table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
#: A row for every byte is too slow in SQL; tests compare with brute force.
ORACLE_SQL: dict[str, str] = {}
