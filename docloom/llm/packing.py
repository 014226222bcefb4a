"""Packing: best-fit decreasing over a segment tree of remaining capacities.

Documents become token ids; whole windows are cut off first, the tails are packed largest first into the open
window with the least room that still fits. Work is done in pools of bounded size inside each input partition,
so nothing is shuffled and memory does not grow with the partition. At the end of a pool the windows that stayed
far from full are emptied into the gaps of fuller ones, and the last remainder is laid out in power-of-two
sequences, which need no padding.
"""

from __future__ import annotations

import itertools
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _byte_signs() -> list[str]:
    """The signs that stand for the 256 bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_BYTE_SIGNS = _byte_signs()


class WordTokenizer:
    """Ids of whole texts for a lower-casing tokenizer whose matches never contain blanks.

    The text is cut at spaces, tabs and newlines, each distinct piece is encoded once by the library, and the ids are put
    together by gathering. Pieces are kept up to ``cache_size``; then the ``keep`` first met stay, which are the common ones.
    """

    def __init__(self, path: str, cache_size: int = 1_500_000, keep: int = 400_000, longest: int = 48):
        from tokenizers import Tokenizer

        self.model, self.cache_size, self.keep, self.longest = Tokenizer.from_file(path), cache_size, keep, longest
        self.bpe = self.model.model
        self.index: dict[str, int] = {"": 0}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _trim(self) -> None:
        self.index = dict(itertools.islice(self.index.items(), self.keep))
        self.used = int(self.begin[self.keep])

    def _put(self, word: str, ids) -> None:
        at, end = len(self.index), self.used + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        if at >= len(self.begin) - 1:
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : end] = ids
        self.begin[at], self.size[at], self.begin[at + 1] = self.used, len(ids), end
        self.used = end
        self.index[word] = at

    def _ids(self, word: str) -> np.ndarray:
        at = self.index[word]
        return self.flat[self.begin[at] : self.begin[at] + self.size[at]]

    def _learn(self, words: list[str], lowered: bool) -> None:
        """Add the pieces that are new. A word with signs behind it is the word's ids and the signs' ids."""
        new = list(dict.fromkeys(w for w in words if w not in self.index))
        tails, stems = [], dict.fromkeys(())
        for w in new:
            stem = w.rstrip(".,!?;:")
            if stem and len(stem) < len(w) and stem.isalpha() and unicodedata.is_normalized("NFC", stem):  # else it may end in a mark, which joins the signs
                tails.append((w, stem, w[len(stem) :]))
                stems[stem] = stems[w[len(stem) :]] = None
            else:
                stems[w] = None
        rest = []
        for w in stems:
            if w in self.index:
                continue
            if lowered and w.isalpha() and unicodedata.is_normalized("NFC", w):  # one match as it stands: the model alone decides
                spelt = w if w.isascii() else "".join(map(_BYTE_SIGNS.__getitem__, w.encode()))
                self._put(w, [t.id for t in self.bpe.tokenize(spelt)])
            else:
                rest.append(w)
        for word, found in zip(rest, self.model.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self._put(word, found.ids)
        for word, stem, signs in tails:
            self._put(word, np.concatenate([self._ids(stem), self._ids(signs)]))

    def encode(self, text: str) -> np.ndarray:
        if lowered := "\u03a3" not in text and "<|" not in text:  # else case could matter: sigma at a word's end, special tokens
            text = text.lower()
        words = text.replace("\n", " ").replace("\t", " ").split(" ")
        try:
            return self._gather(words)
        except KeyError:
            pass
        if len(self.index) > self.cache_size:
            self._trim()
        self._learn([w for w in words if len(w) <= self.longest], lowered)
        try:
            return self._gather(words)
        except KeyError:  # pieces too long to be worth keeping
            out, run = [], []
            for w in words:
                if len(w) <= self.longest:
                    run.append(w)
                else:
                    out += [self._gather(run), np.array(self.model.encode(w, add_special_tokens=False).ids, np.uint32)]
                    run = []
            return np.concatenate([*out, self._gather(run)])

    def _gather(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        size = self.size[at]
        shift = np.cumsum(size) - size
        return self.flat[np.repeat(self.begin[at] - shift, size) + np.arange(int(size.sum()))]


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process; later tasks find its pieces learnt."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


class CapacityTree:
    """Segment tree over remaining capacities 0..top; finds the least capacity of at least ``need`` with an open window."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(top + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        k = room + self.leaves
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the tightest fit, removed from the tree; None if no window has the room."""
        k, count = need + self.leaves, self.count
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - self.leaves
        while k:
            count[k] -= 1
            k >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows as lists of item numbers; ties go to the earlier item, every length lies in 1..capacity."""
    tree, windows = CapacityTree(capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[item])
        if found is None:
            windows.append([])
            found = capacity, len(windows) - 1
        room, window = found
        windows[window].append(item)
        if room > lengths[item]:
            tree.add(room - lengths[item], window)
    return windows


def lay_out(lengths: list[int], capacity: int, least_gap: int = 32) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length) that cover every item exactly.

    Gaps under ``least_gap`` stay as padding; larger ones are filled by cutting up the emptiest windows. What is
    left of the last window is cut into powers of two.
    """
    bins = [[(i, 0, lengths[i]) for i in w] for w in best_fit_decreasing(lengths, capacity)]
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-fill[b], b))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        to, of = order[lo], order[hi]
        gap = capacity - fill[to]
        if gap < least_gap:
            lo += 1
            continue
        if not fill[of]:
            hi -= 1
            continue
        item, start, n = bins[of].pop()
        cut = min(gap, n)
        bins[to].append((item, start + n - cut, cut))
        if cut < n:
            bins[of].append((item, start, n - cut))
        fill[to], fill[of] = fill[to] + cut, fill[of] - cut
    done = []
    for b, pieces in enumerate(bins):
        left = fill[b]
        if not left:
            continue
        if capacity - left < least_gap:
            done.append(pieces)
            continue
        pieces = pieces[::-1]
        while left:
            size, row = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                item, start, n = pieces.pop()
                cut = min(size, n)
                row.append((item, start, cut))
                if cut < n:
                    pieces.append((item, start + cut, n - cut))
                size -= cut
            done.append(row)
    return done


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, pool_tokens: int = 4_000_000,
    id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None,
) -> DataFrame:
    """One row per piece, see ``SCHEMA``. ``tokenizer_path`` names a vocabulary file every executor can read.

    A null or empty text is the end id alone; very long texts are cut into whole windows first. Repeated rows are
    separate documents. Columns other than id and text are ignored. An empty table gives an empty result. Sequence
    ids are unique: partition number times 2**32 plus a running number. Offsets run from 0 without gaps.

    With ``order_col`` documents are packed in its order over the whole table, wherever they lie (one shuffle): pools
    are consecutive stretches of it, and sequence ids follow it, within a pool by the first document of a sequence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path).encode
        serial = TaskContext.get().partitionId() << 32
        out: list[list] = [[] for _ in range(7)]
        tails: list[tuple[int, int, int, np.ndarray, int]] = []  # doc, ids before, ids of the document, ids, place
        firsts: list[int] = []  # place of the first document of each sequence of the pool
        held = place = 0

        def put(doc: int, start: int, ids: np.ndarray, total: int, offset: int) -> None:
            for column, value in zip(out, (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, serial, offset), strict=True):
                column.append(value)

        def close() -> pa.RecordBatch:
            nonlocal serial, held
            for row in lay_out([len(t[3]) for t in tails], capacity):
                at = 0
                for item, start, n in row:
                    doc, before, total, ids, _ = tails[item]
                    put(doc, before + start, ids[start : start + n], total, at)
                    at += n
                firsts.append(min(tails[item][4] for item, _, _ in row))
                serial += 1
            if order_col:
                begin = serial - len(firsts)
                rank = np.empty(len(firsts), np.int64)
                rank[np.argsort(firsts, kind="stable")] = np.arange(len(firsts))
                out[5][:] = [begin + int(rank[x - begin]) for x in out[5]]
            tails.clear()
            firsts.clear()
            held = 0
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[f.split()[0] for f in SCHEMA.split(", ")])
            for column in out:
                column.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                whole = len(ids) // capacity * capacity
                for at in range(0, whole, capacity):
                    put(doc, at, ids[at : at + capacity], len(ids), 0)
                    firsts.append(place)
                    serial += 1
                if whole < len(ids):
                    tails.append((doc, whole, len(ids), ids[whole:].copy(), place))
                    held += len(ids) - whole
                place += 1
                if held >= pool_tokens or len(out[0]) >= 100_000:
                    yield close()
        if tails or out[0]:
            yield close()

    if order_col:
        by = [F.col(order_col), F.col(id_col), F.xxhash64(text_col)]
        docs = docs.select(order_col, id_col, text_col).repartitionByRange(*by).sortWithinPartitions(*by)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)
