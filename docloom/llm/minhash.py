"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF word shingles.

Texts of equal content are one class from the start. The rest of the work is on different texts:

1. Document frequencies of five-word shingles, over all documents, in a sketch of fixed width. What a counter holds on
   average is taken off, and what is left below the spread of the counters counts as that spread: the spread's share of the documents
   falls as the corpus grows, so frequencies stay told apart at any size. Weights go up to that of ``RARE``: text that a group of copies
   shares stands in as many documents as the group has, and without that bound an edit would weigh the more against it the larger
   corpus and group are.
2. ``HASHES`` consistent weighted samples a document; ``ROWS`` of them make a band, equal bands make a bucket.
3. In a bucket each text is verified against the bucket's smallest doc_id by weighted Jaccard similarity.
4. Texts that failed are joined with their whole bucket (the others hang together already): failed texts and texts of the bucket
   are dealt into chunks of bounded size, each pair of chunks is a group that compares its failed texts with all through
   posting lists and gives out a spanning forest of the links. So no class is torn and no pairs are listed.
5. Components of the verified links are the classes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BUSY, LIGHT, WIDE, components, discard, gathered, settle, unused
from docloom.llm.hashing import run_hashes, runs

WORDS = 5
SIMILARITY = 0.8
SKETCH_BITS = 20
RARE = 1 / 250  # of the documents; what stands in fewer weighs the same, so copies don't make each other's text light
BANDS, ROWS = 8, 2
CHUNK = 512
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True


class Shingles:
    """Distinct hashed shingles of a text and how often each stands in it."""

    def __init__(self, words: int = WORDS):
        self.words = words

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Words are maximal runs of letters and digits (and of characters beyond ASCII) in lower case.

        A text of fewer words than a shingle takes is one shingle; a text without words has none.
        """
        b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
        ids = run_hashes(b, *runs(_INSIDE[b]))
        if not len(ids):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            n = min(self.words, len(ids))
            h = ids[: len(ids) - n + 1].copy()
            for k in range(1, n):
                h ^= h >> np.uint64(29)
                h *= _M2
                h += ids[k : len(ids) - n + 1 + k]
            h ^= h >> np.uint64(32)
            h *= _M3
            h ^= h >> np.uint64(29)
        return np.unique(h, return_counts=True)


def _cells(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def document_frequencies(docs: DataFrame, bits: int = SKETCH_BITS) -> tuple[np.ndarray, int]:
    """Counters of 2**bits cells over all documents, and the number of documents. Size is independent of the corpus.

    Tasks count their rows and send runs of cells as zlib-packed arrays; runs are summed in groups of one row a task.
    """
    block = 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n, of = np.zeros(1 << bits, np.int64), 0, Shingles().of
        for batch in batches:
            for t in batch.column(0):
                h, _ = of(t.as_py() or "")
                c = _cells(h, bits)
                np.add.at(cells, c, 1)
                n += 1
        at = [k for k in range(0, 1 << bits, block) if cells[k : k + block].any()]
        rows = [(k, zlib.compress(cells[k : k + block].tobytes(), 1)) for k in at] + [(-1, zlib.compress(np.array([n]).tobytes()))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["k", "cells"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for part in parts:
            for c in part.column("cells"):
                total = total + np.frombuffer(zlib.decompress(c.as_py()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["k", "cells"])

    kind = "k long, cells binary"
    out, n = np.zeros(1 << bits, np.int64), 0
    for row in docs.select("text").mapInArrow(count, kind).groupBy("k").applyInArrow(add, kind).collect():
        cells = np.frombuffer(zlib.decompress(row.cells), np.int64)
        if row.k < 0:
            n = int(cells[0])
        else:
            out[row.k : row.k + block] = cells
    return out, n


def inverse_frequencies(counts: np.ndarray, n: int) -> np.ndarray:
    """log((n + 1) / (df + 1/2)), where df is a counter less the median load, and three deviations of the load at least."""
    load = np.median(counts)
    df = np.maximum(counts - load, 4.45 * np.median(np.abs(counts - load)))
    return np.log((n + 1) / (df + 0.5)).clip(0.05).astype(np.float64)


def shingle_weights(counts: np.ndarray, n: int) -> np.ndarray:
    """Inverse frequencies, none above that of a shingle in a share of ``RARE`` of the documents."""
    return np.minimum(inverse_frequencies(counts, n), -math.log(RARE))


class Sampler:
    """Improved consistent weighted sampling. Gamma(2,1) and log-gamma variates come from tables of quantiles."""

    def __init__(self, hashes: int, levels: int = 16):
        self.hashes, self.levels = hashes, levels
        u = (np.arange(1 << levels) + 0.5) / (1 << levels)
        lo, hi = np.zeros_like(u), np.full_like(u, 60.0)
        for _ in range(60):  # the gamma(2,1) distribution function is 1 - (1 + x) exp(-x)
            mid = (lo + hi) / 2
            below = 1 - (1 + mid) * np.exp(-mid) < u
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        self.gamma, self.log_gamma = lo.astype(np.float32), np.log(lo).astype(np.float32)

    def of(self, h: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Samples of documents that begin at ``starts`` in one run of shingles: array (documents, hashes) of 64 bits."""
        mask, lw = np.uint64((1 << self.levels) - 1), np.log(weight).astype(np.float32)
        size = np.diff(np.append(starts, len(h)))
        out = np.zeros((len(starts), self.hashes), np.uint64)
        index = np.arange(len(h))
        with np.errstate(over="ignore"):
            for k in range(self.hashes):
                x = (h ^ np.uint64(0x1000193 * (k + 1))) * _M1
                x ^= x >> np.uint64(32)
                x *= _M2
                x ^= x >> np.uint64(29)
                r = self.gamma[(x & mask).view(np.int64)]
                log_c = self.log_gamma[((x >> np.uint64(16)) & mask).view(np.int64)]
                beta = ((x >> np.uint64(40)).astype(np.float32)) / np.float32(1 << 24)
                t = np.floor(lw / r + beta)
                a = log_c - r * (t - beta + np.float32(1))
                low = np.minimum.reduceat(a, starts)
                hit = index[a == np.repeat(low, size)]
                doc = np.searchsorted(starts, hit, "right") - 1
                first = np.ones(len(hit), bool)
                first[1:] = doc[1:] != doc[:-1]
                pick = hit[first]
                out[:, k] = (h[pick] ^ (t[pick].astype(np.int64).view(np.uint64) * _M3)) * _M1
        return out


def _bands(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(samples), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(samples), b + 1, np.uint64)
            for r in range(rows):
                key = (key ^ (key >> np.uint64(31))) * _M2 + samples[:, b * rows + r]
            out[:, b] = (key ^ (key >> np.uint64(32))) * _M3
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> float:
    """Weighted Jaccard similarity: sum of minima over sum of maxima of tf x idf. Two texts without shingles: 0."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    bits = int(len(idf)).bit_length() - 1
    one, two = float((a[1] * idf[_cells(a[0], bits)]).sum()), float((b[1] * idf[_cells(b[0], bits)]).sum())
    low = float((np.minimum(a[1][i], b[1][j]) * idf[_cells(both, bits)]).sum())
    return low / (one + two - low) if one + two - low > 0 else 0.0


def sketch_bands(docs: DataFrame, idf, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_key, bands array) of every row; bands are null without shingles. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sampler, weights = Shingles().of, Sampler(bands * rows), idf.value
        bits = int(len(weights)).bit_length() - 1
        for batch in batches:
            ids, keys, texts = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            k = 0
            while k < len(ids):
                found, n, begin = [], 0, k
                while k < len(ids) and n < 50_000:
                    found.append(of(texts[k].as_py() or ""))
                    n += len(found[-1][0])
                    k += 1
                full = [i for i, f in enumerate(found) if len(f[0])]
                out: list = [None] * len(found)
                if full:
                    h, tf = (np.concatenate([found[i][c] for i in full]) for c in (0, 1))
                    starts = np.cumsum([0] + [len(found[i][0]) for i in full[:-1]])
                    made = _bands(sampler.of(h, tf * weights[_cells(h, bits)], starts), bands, rows)
                    for i, row in zip(full, made, strict=True):
                        out[i] = row
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[begin:k], pa.int64()), keys.slice(begin, k - begin), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "text_key", "bands"]
                )

    return docs.select(F.col("doc_id").cast("long"), text_digest().alias("text_key"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, text_key string, bands array<long>"
    )


def _verify(pairs: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """Pairs (a, b) of doc_ids whose texts reach ``least``. Rows of the same a tend to meet, its shingles are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, weights, kept = Shingles().of, idf.value, {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = []
            for i, x in enumerate(a):
                if x not in kept:
                    if len(kept) >= 64:
                        kept.clear()
                    kept[x] = of(batch.column(2)[i].as_py())
                ok.append(similarity(kept[x], of(batch.column(3)[i].as_py()), weights) >= least)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    wide = (
        pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    )
    return wide.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def linked(found: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, least: float, first: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest (lower, higher number) of the links among texts given as shingles and counts.

    A shingle that stands k times is k tokens, so the sum of minima is the weight of common tokens. Each text is compared
    through the posting lists of its tokens with all texts before it; with ``first``, only the texts from there on with those
    before.
    """
    bits = int(len(idf)).bit_length() - 1
    tokens, owner = [], []
    with np.errstate(over="ignore"):
        for i, (h, tf) in enumerate(found):
            nth = np.arange(int(tf.sum())) - np.repeat(np.cumsum(tf) - tf, tf)
            tokens.append(np.repeat(h, tf) + nth.astype(np.uint64) * _M1)
            owner.append(np.full(len(nth), i))
    weight = np.concatenate([np.repeat(idf[_cells(h, bits)], tf) for h, tf in found])
    size = np.array([len(t) for t in tokens])
    total = np.bincount(np.concatenate(owner), weight, len(found))
    _, token = np.unique(np.concatenate(tokens), return_inverse=True)
    owner = np.concatenate(owner)
    order = np.argsort(token, kind="stable")  # postings: texts of a token in order
    place = np.empty(len(token), np.int64)
    place[order] = np.arange(len(token))
    head = np.searchsorted(token[order], token)
    before = place - head  # postings ahead of this one
    if first is not None:
        before = np.minimum(before, np.bincount(token[owner < first], minlength=int(token.max(initial=-1)) + 1)[token])
    begin = np.cumsum(size) - size
    parent = list(range(len(found)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for x in range(first or 0, len(found)):
        mine = slice(begin[x], begin[x] + size[x])
        n = before[mine]
        if not n.any():
            continue
        at = np.repeat(head[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        low = np.bincount(owner[order[at]], np.repeat(weight[mine], n), x + 1)
        for y in np.flatnonzero(low[:x] >= least * (total[x] + total[:x] - low[:x]) - 1e-9):
            if low[y] > 0 and low[y] / (total[x] + total[y] - low[y]) >= least:
                a, b = sorted((root(int(y)), root(x)))
                if a != b:
                    parent[b] = a
                    out.append((int(y), x))
    return out


def _within(members: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """Links (a, b) of failed texts in the buckets of ``members(band, key, doc, n, failed, fails)``.

    Failed texts (``fails`` of the ``n`` in a bucket) and the others are dealt into chunks of about ``CHUNK``. A group is a pair
    of chunks of failed texts, or one of failed texts and one of others; each pair of texts meets in one group.
    """

    def join(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sides = Shingles().of, ({}, {})  # by document and text: a doc_id can have several
        for batch in batches:
            for doc, side, text in zip(batch.column("doc").to_pylist(), batch.column("side").to_pylist(), batch.column("text").to_pylist(), strict=True):
                sides[side][doc, text] = None
        keys = [*sides[0], *(k for k in sides[1] if k not in sides[0])]
        edges = linked([of(text) for _, text in keys], idf.value, least, len(sides[0]) or None)
        yield pa.RecordBatch.from_arrays([pa.array([keys[e[k]][0] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    chunks = lambda n: F.greatest(F.ceil(n / CHUNK), F.lit(1)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asking, others = chunks(F.col("fails")), chunks(F.col("n") - F.col("fails"))
    own = F.pmod(F.xxhash64("doc", F.lit(23)), F.when(F.col("failed"), F.col("asking")).otherwise(F.col("others"))).cast("int")
    base = members.select("band", "key", "doc", "failed", asking.alias("asking"), others.alias("others")).withColumn("own", own)
    failed = base.where("failed")
    pairs = failed.withColumn("other", every(F.col("asking"))).select(
        "band", "key", "doc", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), F.lit(0).alias("kind")
    )
    # Both chunks of a pair are compared with each other; a chunk alone (i = j) with itself, as all its texts are on one side.
    alone = F.when(F.col("i") == F.col("j"), 1).otherwise(F.col("side"))
    left = failed.withColumn("j", every(F.col("others"))).select("band", "key", "doc", F.col("own").alias("i"), "j", F.lit(0).alias("side"), F.lit(1).alias("kind"))
    right = base.where("not failed").withColumn("i", every(F.col("asking"))).select("band", "key", "doc", "i", F.col("own").alias("j"), F.lit(1).alias("side"), F.lit(1).alias("kind"))
    dealt = pairs.withColumn("side", alone).union(left).union(right)
    wide = dealt.join(texts.select(F.col("doc_id").alias("doc"), "text"), "doc")
    return wide.groupBy("band", "key", "kind", "i", "j").applyInArrow(join, "a long, b long").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), kept, text_key (``text_digest`` of its text).

    A document is a doc_id and a text: rows equal in both come back once, different texts under one doc_id are documents of
    their own. Of each class one is kept, that of the smallest doc_id (then text_key). Null texts count as empty; equal texts,
    empty ones too, are one class. Texts of fewer than five words match only equal word sequences. Rows without a doc_id
    are kept and link with nothing. Extra columns are ignored. An empty table gives an empty result. Texts are read whole.
    """
    counts, n = document_frequencies(docs)
    idf = docs.sparkSession.sparkContext.broadcast(shingle_weights(counts, n))  # 2**SKETCH_BITS numbers, whatever the corpus
    light = settle(sketch_bands(docs, idf, bands, rows), "bands")
    exact = light.where("doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    reps = settle(exact.withColumn("node", F.monotonically_increasing_id()), "texts", LIGHT)  # numbers are fixed by being written

    entries = reps.where("bands is not null").select(F.col("node").alias("doc"), F.posexplode("bands").alias("band", "key"))
    buckets = entries.groupBy("band", "key").agg(F.min("doc").alias("lead"), F.count("*").alias("n")).where("n > 1")
    buckets = settle(buckets, "buckets", LIGHT)
    member = settle(entries.join(buckets.drop("n"), ["band", "key"]), "members", LIGHT)
    pairs = settle(member.where("doc <> lead").select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct(), "pairs", LIGHT)
    wanted = reps.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node").select("node", F.col("rep").alias("_id"), F.col("text_key").alias("_key"))
    # One row a text: that of its smallest doc_id, however many copies there are.
    chosen = docs.select(F.col("doc_id").cast("long").alias("_id"), text_digest().alias("_key"), F.coalesce("text", F.lit("")).alias("text")).join(wanted.hint("merge"), ["_id", "_key"])
    texts = settle(chosen.select(F.col("node").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "candidates")
    links = settle(_verify(pairs, texts, idf, least), "links", BUSY)

    failed = pairs.join(links, ["a", "b"], "left_anti").select(F.col("a").alias("lead"), F.col("b").alias("doc"), F.lit(True).alias("failed"))
    failed = settle(member.join(failed, ["lead", "doc"]).select("band", "key", "doc", "failed"), "failed", LIGHT)
    open_ = failed.groupBy("band", "key").agg(F.count("*").alias("fails")).join(buckets.select("band", "key", "n"), ["band", "key"]).where("n > 2")
    wider = member.join(open_, ["band", "key"]).join(failed, ["band", "key", "doc"], "left")
    more = settle(_within(wider.withColumn("failed", F.col("failed").isNotNull()), texts, idf, least), "links", BUSY)

    parts = components(links.union(more)).withColumnRenamed("id", "node")
    parts = settle(reps.select("node", "rep", "text_key").join(parts, "node"), "parts", LIGHT)
    discard(buckets, member, pairs, texts, links, failed, more)
    parts = parts.join(parts.groupBy("component").agg(F.min(F.struct("rep", "text_key")).alias("first")), "component").select("node", "first")
    first = F.coalesce(F.col("first"), F.struct("rep", "text_key"))
    classes = reps.select("node", "rep", "text_key").join(parts, "node", "left").select("text_key", first.alias("first"))
    rows_ = light.select("doc_id", "text_key").distinct()
    known = rows_.where("doc_id is not null").join(classes, "text_key").select(
        "doc_id", F.col("first.rep").alias("class_id"), (F.struct("doc_id", "text_key") == F.struct(F.col("first.rep").alias("doc_id"), F.col("first.text_key").alias("text_key"))).alias("kept"), "text_key"
    )
    return known.union(rows_.where("doc_id is null").select("doc_id", "doc_id", F.lit(True), "text_key"))


def text_digest(column: str = "text"):
    """The digest that tells texts apart; null is as empty."""
    return F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate class, with all its columns; rows without a doc_id all stay."""
    own, key = unused(docs, "own", "key")
    kept = near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias(own), F.col("text_key").alias(key))
    named = docs.where("doc_id is not null").withColumns({own: F.col("doc_id").cast("long"), key: text_digest()})
    found = gathered(named.join(kept.hint("merge"), [own, key]).dropDuplicates([own, key]), WIDE)
    return found.select(*docs.columns).union(gathered(docs.where("doc_id is null"), LIGHT))
