"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts in a document of smaller doc_id.

Documents are dealt into shards by a hash of doc_id. Two passes bring together what can match, wherever it stands:

1. Every shard selects fingerprints of its windows (the least hash of the pieces of ``PIECE`` bytes in a window, so equal
   windows select alike). Buckets of fingerprints find those that more than one document has, and heavy ones: pieces that stand in
   so many different surroundings that their stretches would overload one bucket.
2. Stretches of windows under such a fingerprint go to its bucket, each distinct one once a shard. A stretch that several
   shards send counts as one of the first. The bucket builds the Burrows-Wheeler transform of each shard's stretches, merges the
   transforms by interleave refinement to a depth of ``LENGTH`` bytes, and finds the least doc_id of every repeated interval.
   A shard hears which windows have a smaller doc_id elsewhere, and cuts the bytes.

Windows under a heavy fingerprint go one by one, each to the bucket of its own hash, so no fingerprint fills a bucket however common it is.

A bucket gets one copy of a stretch from a shard however many documents hold it, so common passages and large groups of
copies stay small. The shuffled documents are used by three steps of one query; the exchange is reused.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.bwt import repeated_windows

LENGTH = 50
PIECE = 25
SHARD_BYTES = 6 << 20
BUCKET_BYTES = 8 << 20
TASK_BYTES = 32 << 20  # of text; a task takes shard after shard, so its memory is that of one
EXPAND = 1 << 20
MANY_PLACES = 16  # a shard tells how many bytes stand under a fingerprint from so many places on
KEY_BYTES = 6
NO_ID = (1 << 63) - 1
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_B = np.uint64(0x100000001B3)
_M = np.uint64(0x9E3779B97F4A7C15)


def _least_hashes(b: np.ndarray, piece: int, length: int) -> np.ndarray:
    """For each start of a window of ``length`` bytes, the least mixed hash of its pieces."""
    with np.errstate(over="ignore"):
        parts, h, width, base = [], b.astype(np.uint64) + np.uint64(1), 1, _B
        todo, total = piece, None
        while todo:
            if todo & 1:
                parts.append((h, width, base))
            todo >>= 1
            if todo:
                h, width, base = h[:-width] * base + h[width:], 2 * width, base * base
        n, at = len(b) - piece + 1, 0
        for h, width, base in parts:
            total = h[at : at + n].copy() if total is None else total * base + h[at : at + n]
            at += width
        total ^= total >> np.uint64(29)
        total *= _M
        total ^= total >> np.uint64(32)
        span, low = length - piece + 1, total
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        return np.minimum(low[: len(low) - (span - width)], low[span - width :]) if span > width else low


def stretches(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int = LENGTH, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """(document, start, number of windows, fingerprint) of maximal runs of windows with one fingerprint; none crosses documents."""
    n = len(flat) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edge = np.zeros(len(flat) + 1, bool)
    edge[begin] = True
    edge[np.maximum(begin + size - length + 1, begin)] = True
    starts, values, before = [], [], None
    for at in range(0, n, 1 << 16):
        low = _least_hashes(flat[at : min(at + (1 << 16), n) + length - 1], piece, length)
        new = edge[at : at + len(low)].copy()
        new[1:] |= low[1:] != low[:-1]
        new[0] |= before is None or low[0] != before
        before = low[-1]
        hit = np.flatnonzero(new)
        starts.append(at + hit), values.append(low[hit])
    start, value = np.concatenate(starts), np.concatenate(values)
    count = np.diff(np.append(start, n))
    doc = np.searchsorted(begin, start, "right") - 1
    inside = start + length <= begin[doc] + size[doc]
    return doc[inside], start[inside], count[inside], value[inside]


def _pack(keys: np.ndarray) -> bytes:
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // KEY_BYTES, 8), np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, KEY_BYTES)
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def _trim(values: np.ndarray) -> np.ndarray:
    return values & ~np.uint64((1 << 8 * (8 - KEY_BYTES)) - 1)


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((_trim(values) * _M) >> np.uint64(33)) % np.uint64(buckets)


def _whole_hashes(flat: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hashes of whole windows."""
    out = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = out * _B + flat[start + k] + np.uint64(1)
        out ^= out >> np.uint64(29)
        out *= _M
        return out ^ (out >> np.uint64(32))


def one_by_one(flat: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray, value: np.ndarray, heavy: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Stretches with those under a fingerprint of ``heavy`` taken apart: each window alone, its hash in place of the fingerprint."""
    apart = np.isin(_trim(value), heavy)
    n = np.where(apart, count, 1)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    doc, start, count, value, apart = (np.repeat(x, n) for x in (doc, start, count, value, apart))
    start, count = start + at, np.where(apart, 1, count)
    value[apart] = _whole_hashes(flat, start[apart], length)
    return doc, start, count, value


def _squeeze(*parts: np.ndarray | bytes) -> bytes:
    """Several arrays packed as one blob, their lengths and that of the whole in front."""
    parts = [x if isinstance(x, bytes) else x.tobytes() for x in parts]
    raw = b"".join([np.array([len(parts), *map(len, parts)], "<u4").tobytes(), *parts])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _spread(blob: bytes) -> list[memoryview]:
    raw = memoryview(pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd"))
    n = int(np.frombuffer(raw[:4], "<u4")[0])
    at = 4 + 4 * n + np.append(0, np.cumsum(np.frombuffer(raw[4 : 4 + 4 * n], "<u4").astype(np.int64)))
    return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _steps(rising: np.ndarray) -> np.ndarray:
    return np.diff(rising.astype(np.int64), prepend=0).astype("<i4")


def _sums(part: memoryview) -> np.ndarray:
    return np.cumsum(np.frombuffer(part, "<i4"), dtype=np.int64)


class Shard:
    """The documents of a shard, in order of doc_id (equal ids in order of text), as one run of bytes."""

    def __init__(self, batches):
        found = pa.Table.from_batches(list(batches)) if not isinstance(batches, pa.Table) else batches
        null = np.array(found.column("doc_id").is_null().to_numpy(), bool)
        ids = np.array(found.column("doc_id").fill_null(NO_ID).to_numpy(), np.int64)
        texts = found.column("body").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids, self.null = ids[order], null[order]
        self.flat_bytes = b"".join(texts[i] for i in order)
        self.flat = np.frombuffer(self.flat_bytes, np.uint8)
        self.size = np.array([len(texts[i]) for i in order], np.int64)
        self.begin = np.cumsum(self.size) - self.size


def _rows(columns: list[tuple[str, pa.DataType, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for _, t, v in columns], names=[n for n, _, _ in columns])


def deduplicate(
    docs: DataFrame, length: int = LENGTH, piece: int = PIECE, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES, text_out: bool = False, heavy_bytes: int | None = None,
) -> DataFrame:
    """One row per document, see ``SCHEMA``; with ``text_out`` also ``kept``, the bytes left.

    Texts are UTF-8 bytes; null is empty; texts shorter than ``length`` lose nothing. Rows of equal doc_id don't
    count against each other; a null doc_id counts as the largest there can be. Fingerprints over ``heavy_bytes`` (that of a bucket)
    of stretches are split. Extra columns are ignored; an empty table gives an empty result. Whole texts are read.
    """
    heavy_bytes = bucket_bytes if heavy_bytes is None else heavy_bytes
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, buckets, tasks = (max(1, math.ceil(total / x)) for x in (shard_bytes, bucket_bytes, TASK_BYTES))
    tasks = max(tasks, min(shards, docs.sparkSession.sparkContext.defaultParallelism))  # small tables use all cores too
    ids = F.col("doc_id").cast("long")
    deal = F.pmod(F.xxhash64(F.coalesce(ids, F.lit(NO_ID)), F.col("text")), F.lit(shards)).cast("int")  # rows that share an id, or have none, are spread too
    dealt = docs.select(ids.alias("doc_id"), body.alias("body"), deal.alias("shard"))
    dealt = dealt.repartition(tasks, "shard")

    def fingerprints(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shard(batches)
        doc, start, count, value = stretches(s.flat, s.begin, s.size, length, piece)
        value, owner = _trim(value), s.ids[doc]
        order = np.argsort(value, kind="stable")  # documents stay in order of id
        start, end = start[order], (start + count + length - 1)[order]
        value, owner = value[order], owner[order]
        first = np.ones(len(value), bool)
        first[1:] = value[1:] != value[:-1]
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(value)) - 1 if len(at) else at
        many = owner[at] != owner[last]
        size = np.zeros(len(at), np.uint32)  # of different stretches, where there are many
        for k in np.flatnonzero(last - at >= MANY_PLACES - 1).tolist():
            size[k] = sum(map(len, {s.flat_bytes[a:b] for a, b in zip(start[at[k] : last[k] + 1].tolist(), end[at[k] : last[k] + 1].tolist(), strict=True)}))
        value = value[at]
        bucket = _bucket(value, buckets)
        order = np.argsort(bucket, kind="stable")
        value, many, size, bucket = value[order], many[order], size[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        some = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
        yield _rows([
            ("bucket", pa.int32(), some), ("shard", pa.int32(), [key[0].as_py()] * len(some)),
            ("keys", pa.binary(), [_pack(value[cuts[b] : cuts[b + 1]]) for b in some]),
            ("many", pa.binary(), [np.packbits(many[cuts[b] : cuts[b + 1]]).tobytes() for b in some]),
            ("sized", pa.binary(), [_pack(value[cuts[b] : cuts[b + 1]][size[cuts[b] : cuts[b + 1]] > 0]) for b in some]),
            ("sizes", pa.binary(), [size[cuts[b] : cuts[b + 1]][size[cuts[b] : cuts[b + 1]] > 0].astype("<u4").tobytes() for b in some]),
        ])

    def shared(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(batches))
        keys = [_unpack(k) for k in found.column("keys").to_pylist()]
        many = [np.unpackbits(np.frombuffer(m, np.uint8))[: len(k)].astype(bool) for m, k in zip(found.column("many").to_pylist(), keys, strict=True)]
        every = np.sort(np.concatenate(keys))
        repeated = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *(k[m] for k, m in zip(keys, many, strict=True))]))
        sized = np.concatenate([_unpack(k) for k in found.column("sized").to_pylist()])
        sizes = np.concatenate([np.frombuffer(x, "<u4") for x in found.column("sizes").to_pylist()])
        sized, place = np.unique(sized, return_inverse=True)
        shards_over = heavy_bytes // (2 * length)  # each sends one stretch at least
        heavy = [sized[np.bincount(place, sizes, len(sized)) > heavy_bytes], np.unique(every[shards_over:][every[shards_over:] == every[: len(every) - shards_over]])]
        heavy = np.intersect1d(np.unique(np.concatenate(heavy)), repeated, assume_unique=True)
        keys = [k[np.isin(k, repeated, assume_unique=True)] for k in keys]
        own = [_pack(k[np.isin(k, heavy, assume_unique=True)]) for k in keys]
        yield _rows([("shard", pa.int32(), found.column("shard").to_pylist()), ("keys", pa.binary(), [_pack(k) for k in keys]), ("heavy", pa.binary(), own)])

    marks = dealt.groupBy("shard").applyInArrow(fingerprints, "bucket int, shard int, keys binary, many binary, sized binary, sizes binary")
    marks = marks.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(shared, "shard int, keys binary, heavy binary")

    kinds = [("target", pa.string()), ("shard", pa.int32()), ("blob", pa.binary())]

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        """Distinct stretches for each bucket; the shard's own plan (document, start, stretch) goes along to itself."""
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for _, t in kinds], names=[n for n, _ in kinds])
        s, own = Shard(left), left.column("shard")[0].as_py()
        doc, start, count, value = stretches(s.flat, s.begin, s.size, length, piece)
        keys = [_unpack(k) for k in right.column("keys").to_pylist()] if right.num_rows else []
        take = np.isin(_trim(value), np.concatenate(keys)) if keys else np.zeros(len(value), bool)
        doc, start, count, value = doc[take], start[take], count[take], value[take]
        heavy = np.concatenate([_unpack(k) for k in right.column("heavy").to_pylist()]) if keys else np.zeros(0, np.uint64)
        if len(heavy):
            doc, start, count, value = one_by_one(s.flat, doc, start, count, value, heavy, length)
        seen: dict[bytes, int] = {}
        flat, stretch = s.flat_bytes, np.empty(len(start), np.int64)
        first = []
        for i, (a, b) in enumerate(zip(start.tolist(), (start + count + length - 1).tolist(), strict=True)):
            k = seen.setdefault(flat[a:b], len(seen))
            if k == len(first):
                first.append(i)
            stretch[i] = k
        first = np.array(first, np.int64)
        texts, bucket = list(seen), _bucket(value[first], buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        rows = []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            at = order[cuts[b] : cuts[b + 1]]
            mine = [texts[i] for i in at.tolist()]
            rows.append((f"b{b}", own, _squeeze(b"".join(mine), np.array([len(x) for x in mine], "<u4"), s.ids[doc[first[at]]].astype("<i8"), _steps(at))))
        low = s.ids[doc[first]] if len(first) else np.zeros(0, np.int64)
        later = s.ids[doc] > low[stretch] if len(first) else np.zeros(0, bool)
        rows.append((f"s{own}", own, _squeeze(_steps(start), count.astype("<u4"), later, _steps(stretch))))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    sent = dealt.groupBy("shard").cogroup(marks.groupBy("shard")).applyInArrow(cut, "target string, shard int, blob binary")

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a bucket: for each shard, the windows (stretch, from, to) whose least doc_id is below the shard's own."""
        found = pa.Table.from_batches(list(batches))
        if key[0].as_py()[0] == "s":  # a shard's plan passes through
            yield from found.append_column("plan", pa.array([True] * found.num_rows)).select(["shard", "plan", "blob"]).to_batches()
            return
        distinct: dict[bytes, int] = {}
        number, low, local, sender = [], [], [], []
        for i, blob in enumerate(found.column("blob")):
            flat, sizes, ids, places = _spread(blob.as_py())
            flat, ends = bytes(flat), np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64)
            mine = [distinct.setdefault(flat[a:b], len(distinct)) for a, b in itertools.pairwise([0, *ends.tolist()])]
            sender += [i] * (len(distinct) - len(sender))
            number.append(np.array(mine, np.int32)), low.append(np.frombuffer(ids, "<i8")), local.append(_sums(places).astype(np.int32))
        rows_end = np.cumsum([len(x) for x in number])
        number, low, local = (np.concatenate(x) for x in (number, low, local))
        texts = list(distinct)
        del distinct
        least = np.full(len(texts), NO_ID)
        np.minimum.at(least, number, low)
        windows = np.array([len(x) - length + 1 for x in texts], np.int64)
        begin = np.cumsum(windows) - windows
        best = np.empty(int(windows.sum()), np.int64)  # least doc_id of every window
        text, offset, interval = repeated_windows(texts, np.minimum(sender, 65_535), length)  # shards beyond that are taken together
        edge = np.flatnonzero(np.append(True, interval[1:] != interval[:-1]))
        best[begin[text] + offset] = np.repeat(np.minimum.reduceat(least[text], edge), np.diff(np.append(edge, len(text))))
        del text, offset, interval
        all_hit = low > np.maximum.reduceat(best, begin)[number]
        some_hit = np.flatnonzero(~all_hit & (low > np.minimum.reduceat(best, begin)[number]))
        spans = [(np.flatnonzero(all_hit), np.zeros(int(all_hit.sum()), np.int64), windows[number[all_hit]] - 1)]
        held = np.cumsum(windows[number[some_hit]])
        for part in np.split(some_hit, np.searchsorted(held, np.arange(EXPAND, held[-1] if len(held) else 0, EXPAND))):
            n = windows[number[part]]
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            copy = np.repeat(part, n)
            hit = best[np.repeat(begin[number[part]], n) + at] < low[copy]
            copy, at = copy[hit], at[hit]
            new = np.ones(len(copy), bool)
            new[1:] = (copy[1:] != copy[:-1]) | (at[1:] != at[:-1] + 1)
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(copy)) - 1 if len(a) else a
            spans.append((copy[a], at[a], at[b]))
        copy, a, b = (np.concatenate(x) for x in zip(*spans, strict=True))
        order = np.argsort(copy, kind="stable")
        copy, a, b = copy[order], a[order], b[order]
        cuts = np.searchsorted(copy, np.append(0, rows_end))
        some = np.flatnonzero(np.diff(cuts)).tolist()
        blobs = [_squeeze(*(x[cuts[i] : cuts[i + 1]].astype("<u4") for x in (local[copy], a, b))) for i in some]
        shard = found.column("shard").to_pylist()
        yield _rows([("shard", pa.int32(), [shard[i] for i in some]), ("plan", pa.bool_(), [False] * len(some)), ("blob", pa.binary(), blobs)])

    told = sent.repartition(2 * tasks, "target").groupBy("target").applyInArrow(merged, "shard int, plan boolean, blob binary")
    schema = SCHEMA + (", kept binary" if text_out else "")
    out_kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * text_out

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for _, t in out_kinds], names=[n for n, _ in out_kinds])
        s = Shard(left)
        plan, elsewhere = None, []
        for is_plan, blob in zip(right.column("plan").to_pylist(), right.column("blob"), strict=True):
            parts = _spread(blob.as_py())
            if is_plan:
                plan = [_sums(parts[0]), np.frombuffer(parts[1], "<u4").astype(np.int64), np.frombuffer(parts[2], "?"), _sums(parts[3])]
            else:
                elsewhere.append([np.frombuffer(x, "<u4").astype(np.int64) for x in parts])
        change = np.zeros(len(s.flat) + 1, np.int32)
        if plan is not None and len(plan[0]):
            start, count, later, stretch = plan
            np.add.at(change, start[later], 1)
            np.add.at(change, (start + count + length - 1)[later], -1)
            start, stretch = start[~later], stretch[~later]
            if elsewhere and len(start):
                which, a, b = (np.concatenate(x) for x in zip(*elsewhere, strict=True))
                order = np.argsort(which, kind="stable")
                which, a, b = which[order], a[order], b[order]
                lo, hi = np.searchsorted(which, stretch), np.searchsorted(which, stretch, "right")
                n = hi - lo
                pick = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                base = np.repeat(start, n)
                np.add.at(change, base + a[pick], 1)
                np.add.at(change, base + b[pick] + length, -1)
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        rise[s.begin[s.size > 0]] = gone[s.begin[s.size > 0]]
        total_gone, total_rise = (np.append(np.int32(0), np.cumsum(x, dtype=np.int32)) for x in (gone, rise))
        end = s.begin + s.size
        removed = total_gone[end] - total_gone[s.begin]
        spans = total_rise[end] - total_rise[s.begin]
        kept = [s.flat_bytes[a:b] if not r else (s.flat[a:b][~gone[a:b]].tobytes() if r < b - a else b"") for a, b, r in zip(s.begin.tolist(), end.tolist(), removed.tolist(), strict=True)]
        columns = [pa.array(s.ids, pa.int64(), mask=s.null), s.size, removed, spans, [hashlib.sha256(k).hexdigest() for k in kept]] + [kept] * text_out
        return pa.Table.from_arrays([columns[0], *[pa.array(c, t) for c, (_, t) in zip(columns[1:], out_kinds[1:], strict=True)]], names=[n for n, _ in out_kinds])

    found = dealt.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(apply, schema)
    # Rows of digests are small: adaptive execution puts those of many tasks in few files.
    return found if text_out else found.repartition("doc_id", "kept_sha256")
