"""Merging Burrows-Wheeler transforms by interleave refinement.

The strings are windows of ``depth`` bytes, read in blocks of a few bytes. The alphabet is of the blocks that occur, numbered
in the order of their bytes by a table; blocks are as wide as keeps their numbers within 16 bits, so dealing by a symbol is
one counting sort. A window's suffixes begin at its block boundaries. All suffixes of one length form a level, as in
transforms of reads of equal length; the last level is that of the empty suffixes.

1. Every shard builds its own transform from its own windows: for each level its suffixes in sorted order, and the block
   before each. Shards don't see each other's blocks.
2. The transforms are merged. The interleave says, for every merged rank, which shard the suffix comes from; at the level of
   the empty suffixes it is shard after shard. A round reads the shards' transforms in the order of the interleave and
   deals the entries stably by symbol. That gives the interleave of the suffixes one block longer. No suffix is compared
   or looked at again.
3. Ranks whose entries agree in the symbol and were in one interval before are in one interval after: after round h an interval has
   a common prefix of h blocks. What is together after the last round shares the whole depth.
"""

from __future__ import annotations

import numpy as np

MOST_SYMBOLS = 1 << 16
WIDEST = 8


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of 16-bit keys by counting."""
    return np.argsort(keys, kind="stable")


def blocks(flat: np.ndarray, depth: int, most: int = MOST_SYMBOLS) -> tuple[np.ndarray, int]:
    """(number of the block at each position, width of blocks); numbers are in the order of the bytes.

    Blocks widen, at first to double, while there are at most ``most`` different ones. Positions within a block's
    width of the end have no block.
    """
    n, letters = len(flat), np.zeros(256, bool)
    letters[flat] = True
    signs = int(letters.sum())
    letter = (np.cumsum(letters) - 1).astype(np.int32)[flat]
    symbol, width, count = letter, 1, signs

    def widen(after: np.ndarray, step: int, others: int) -> tuple[np.ndarray, int, int] | None:
        end = n - width - step + 1
        if width + step > min(WIDEST, depth, n) or count * others > 1 << 24:
            return None
        code = symbol[:end] * np.int32(others) + after[width : width + end]
        there = np.zeros(count * others, bool)
        there[code] = True
        found = int(np.count_nonzero(there))
        return None if found > most else ((np.cumsum(there, dtype=np.int32) - 1)[code], width + step, found)

    while wider := widen(symbol, width, count) or widen(letter, 1, signs):
        symbol, width, count = wider
    return symbol.astype(np.uint16), width


def steps(depth: int, width: int) -> list[int]:
    """Where a window's blocks begin. The last one ends with the window and may overlap the one before, which changes no order."""
    return [*range(0, depth - width, width), depth - width]


class Transforms:
    """The transforms of several shards, laid end to end: built for each shard from its own windows alone.

    ``blocks_before[k]`` lists, shard after shard, the block before each suffix of level k + 1 in the shard's order;
    ``order`` lists the windows themselves in the shard's order.
    """

    def __init__(self, symbol: np.ndarray, place: np.ndarray, shard: np.ndarray, offsets: list[int]):
        """``place`` is where each window begins, ``shard`` whose it is."""
        order, found = stable_order(shard), []
        for offset in reversed(offsets):
            before = symbol[place[order] + offset]
            found.append(before)
            order = order[stable_order(before)]
            order = order[stable_order(shard[order])]  # each shard's suffixes by themselves
        self.order, self.blocks_before = order, found[::-1]


def merge(own: Transforms, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows in merged order, number of the interval of each)."""
    source, interval = np.sort(shard), np.zeros(len(shard), np.int32)
    new = np.zeros(len(shard), bool)
    for before in reversed(own.blocks_before):
        symbol = before[_read(source)]
        dealt = stable_order(symbol)
        symbol, interval, source = symbol[dealt], interval[dealt], source[dealt]
        new[1:] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        interval = np.cumsum(new, dtype=np.int32)
    return own.order[_read(source)], interval


def _read(source: np.ndarray) -> np.ndarray:
    """Where the entry of each merged rank stands in the shards' lists laid end to end."""
    out = np.empty(len(source), np.int32)
    out[stable_order(source)] = np.arange(len(source), dtype=np.int32)
    return out


def repeated_windows(texts: list[bytes], shard: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, offset, interval) of every window of ``depth`` bytes; equal windows have equal interval numbers.

    Texts are at least ``depth`` bytes long; ``shard`` gives the shard of each, in 0..65535. Intervals come in the order of
    the bytes of the windows.
    """
    flat = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    count = size - depth + 1
    text = np.repeat(np.arange(len(texts), dtype=np.int32), count)
    offset = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
    if not len(text):
        return text, offset, np.zeros(0, np.int32)
    place = (np.cumsum(size) - size)[text] + offset
    symbol, width = blocks(flat, depth)
    of = shard.astype(np.uint8 if shard.max() < 256 else np.uint16)[text]
    window, interval = merge(Transforms(symbol, place, of, steps(depth, width)), of)
    return text[window], offset[window], interval
