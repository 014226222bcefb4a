"""Token counts by a compiled finite-state transducer over bytes.

The tokenizer (normalisation, splitting into words, byte-pair merges with word ends) becomes a deterministic transducer:
each transition on a byte carries the change of the number of tokens. States are made when a text first needs them. What a
state knows of the word so far is bounded by the vocabulary: which ends of it can still begin a token, and for each of them
the last token before it and the count there. (Two facts make that enough: the tokens of a text up to a token's end are the
tokens of that part alone, and a row of tokens is right if each pair of neighbours is.)

Texts are cut into chunks that run side by side, a byte of every chunk at a time. A chunk begins in the state that the bytes
before it suggest; that gives its state map (entry state to exit state and count). A prefix scan composes the maps of a text's
chunks; in a text where the state at a chunk's entry isn't in the chunk's map, such chunks are walked through once more.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.packing import _BYTE_SIGNS

END, SPECIAL = 0xFE, 0xFF  # bytes that UTF-8 never has: a text's end, a special token
START = 0
_DELTA, _ZERO = 12, 1 << 11  # bits of a transition for the change of the count, and its offset
_CONTRACTIONS = ("'s", "'t", "'m", "'d", "'re", "'ve", "'ll")
_NEVER = 1 << 30  # a rank that no merge has
_SPACES = re.compile(r"([ \t\n\r\x0b\x0c]+)")


class Full(Exception):
    """More states than the table may hold."""


class Transducer:
    def __init__(self, path: str, most_states: int = 100_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self._check(made)
        byte = {c: bytes([b]) for b, c in enumerate(_BYTE_SIGNS)}
        self.rank = {tuple(m): r for r, m in enumerate(m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"])}
        self.inner, self.last, self.begins = set(), set(), {b""}
        for token in made["model"]["vocab"]:
            stem = token.removesuffix("</w>")
            raw = b"".join(map(byte.__getitem__, stem))
            (self.last if stem != token else self.inner).add(raw)
            self.begins.update(raw[:k] for k in range(1, len(raw)))
        self.begins |= self.last  # what can go on or close a word
        self.special = re.compile("|".join(re.escape(t["content"]) for t in made["added_tokens"]) or "(?!)")
        self.most_states, self.fits, self.halves, self.forms, self.kinds = most_states, {}, {}, {}, {}
        self.safe: set[str] = set(map(chr, range(0x300)))
        self.reset()

    @staticmethod
    def _check(made: dict) -> None:
        """The parts of a vocabulary file that the transducer follows; another kind of tokenizer is refused, not counted wrongly."""
        kinds = [x["type"] for x in made["normalizer"]["normalizers"]] + [x["type"] for x in made["pre_tokenizer"]["pretokenizers"]]
        pattern = made["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex")
        model = made["model"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        added = all(not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in made["added_tokens"])
        if kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or pattern != "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" or model.get("end_of_word_suffix") != "</w>" or not plain or not added:
            raise ValueError("not a lower-casing vocabulary with word ends")

    def reset(self) -> None:
        self.states: list[tuple] = [("S", b"", None)]
        self.number, self.memo = {self.states[0]: START}, {}
        self._lay(12)

    # ---- the table of transitions: open addressing, state << 8 | byte to state << 12 | change + 2048 ----

    def _lay(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.bits)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the keys, and the places of keys that the table lacks."""
        slot = self._slots(keys)
        there = self.keys[slot]
        out = self.values[slot]
        off = np.flatnonzero(there != keys)
        lacks = []
        while len(off):
            lacks.append(off[there[off] < 0])
            off = off[there[off] >= 0]
            slot[off] = (slot[off] + 1) & ((1 << self.bits) - 1)
            there[off] = self.keys[slot[off]]
            out[off] = self.values[slot[off]]
            off = off[there[off] != keys[off]]
        return out, np.concatenate(lacks) if lacks else off

    def _put(self, keys: list[int], values: list[int]) -> None:
        if (self.used + len(keys)) * 3 > 1 << self.bits:
            old = self.keys >= 0
            known = self.keys[old].tolist(), self.values[old].tolist()
            self._lay(max(self.bits + 1, (6 * (len(known[0]) + len(keys))).bit_length()))
            self._put(*known)
        last = (1 << self.bits) - 1
        for key, value, slot in zip(keys, values, self._slots(np.array(keys, np.int64)).tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & last
            self.keys[slot], self.values[slot] = key, value
        self.used += len(keys)

    # ---- merges ----

    def _merged(self, parts: list[str]) -> tuple[list[str], tuple | None]:
        """What merging leaves of the parts, and the last merge: its rank, what it joined."""
        last = None
        while len(parts) > 1:
            r, k = min((self.rank.get(p, _NEVER), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if r == _NEVER:
                break
            last = (r, parts[k], parts[k + 1])
            parts[k : k + 2] = ["".join(parts[k : k + 2])]
        return parts, last

    def _made_of(self, token: str) -> tuple | None:
        """The merge that makes a token of its signs: rank and both parts; rank -1 for a single sign, None if merging makes something else of them."""
        if token not in self.halves:
            ends = token.endswith("</w>")
            parts = list(token.removesuffix("</w>"))
            parts[-1] += "</w>" * ends
            parts, last = self._merged(parts)
            self.halves[token] = None if len(parts) > 1 else last or (-1, None, None)
        return self.halves[token]

    def _fits(self, before: bytes | None, token: bytes, ends: bool) -> bool:
        """Whether merging gives just these two tokens (just this one after None).

        It does unless a merge across their border comes first. Going back from the finished tokens, the later of both last
        merges is undone, which shows who stood at the border before; a pair there that merges earlier than that would have been
        joined. Of equal ranks the left one comes first.
        """
        key = (before, token, ends)
        if key not in self.fits:
            if len(self.fits) > 300_000:
                self.fits.clear()
            right = "".join([_BYTE_SIGNS[x] for x in token]) + "</w>" * ends
            self.fits[key] = self._made_of(right) is not None and (before is None or self._apart("".join([_BYTE_SIGNS[x] for x in before]), right))
        return self.fits[key]

    def _apart(self, left: str, right: str) -> bool:
        sooner, a, b = _NEVER, self._made_of(left), self._made_of(right)
        while self.rank.get((left, right), _NEVER) >= sooner:
            if a[0] > b[0]:
                sooner, left = a[0], a[2]
                a = self._made_of(left)
            elif b[0] >= 0:
                sooner, right = b[0] + 1, b[1]
                b = self._made_of(right)
            else:
                return True
        return False

    def _step(self, word: tuple, b: bytes) -> tuple[int, tuple]:
        """One more byte of a word. A word is (the longest end that begins a token, for each such end, by length: its length, the
        last token before it, the count there less the count now)."""
        tail, ends = word
        grown = tail + b
        for n, before, count in ends:
            token = grown[len(grown) - n - 1 :]
            if token in self.inner and self._fits(before, token, False):
                delta = count + 1
                break
        else:
            raise ValueError(f"no token ends in {grown!r}")
        live = [(0, token, 0)] + [(n + 1, before, count - delta) for n, before, count in ends if grown[len(grown) - n - 1 :] in self.begins]
        return delta, (grown[len(grown) - live[-1][0] :], tuple(live))

    def _close(self, word: tuple) -> int:
        """What the word's end changes of the count."""
        tail, ends = word
        for n, before, count in ends:
            token = tail[len(tail) - n :]
            if n and token in self.last and self._fits(before, token, True):
                return count + 1
        raise ValueError(f"no token ends a word in {tail!r}")

    _EMPTY = (b"", ((0, None, 0),))

    def _grow(self, word: tuple, sign: str) -> tuple[int, tuple]:
        total = 0
        for b in sign.encode():
            delta, word = self._step(word, bytes([b]))
            total += delta
        return total, word

    def _whole(self, sign: str) -> int:
        count, word = self._grow(self._EMPTY, sign)
        return count + self._close(word)

    # ---- signs ----

    def _form(self, sign: str) -> str:
        """The sign after normalisation by the library, alone."""
        if sign not in self.forms:
            self.forms[sign] = self.library.normalizer.normalize_str(sign)
        return self.forms[sign]

    def _kind(self, sign: str) -> str:
        """L, N, S or O, as the library's pattern has it."""
        if sign not in self.kinds:
            split = self.library.pre_tokenizer.pre_tokenize_str
            self.kinds[sign] = "S" if not split(sign) else "L" if len(split(sign + "a")) == 1 else "O" if len(split(sign + "!")) == 1 else "N"
        return self.kinds[sign]

    # ---- transitions ----

    def _pending(self, kind: str, word) -> int:
        """What closing the word of a state changes of the count. Of kind A: an apostrophe that began a word, and a letter after it."""
        if kind == "S":
            return 0
        if kind == "A":
            return self._whole("'") + (self._whole(word) if word else 0)
        return self._close(word)

    def _read(self, kind: str, word, sign: str) -> tuple[int, str, object]:
        of = self._kind(sign)
        if kind == "A":
            if "'" + word + sign in _CONTRACTIONS:
                return self._whole("'" + word + sign), "S", None
            if not word and sign in ("r", "v", "l"):
                return 0, "A", sign
            if word:
                first, begun = self._grow(self._EMPTY, word)
                delta, kind, word = self._read("L", begun, sign)
                return self._whole("'") + first + delta, kind, word
            if of == "O":
                return *self._begin("'" + sign, "O"),
        if of == kind and kind in "LO":
            delta, word = self._grow(word, sign)
            return delta, kind, word
        closed = self._pending(kind, word)
        if of == "S":
            return closed, "S", None
        if of == "N":
            return closed + self._whole(sign), "S", None
        if sign == "'":
            return closed, "A", ""
        delta, kind, word = self._begin(sign, of)
        return closed + delta, kind, word

    def _begin(self, signs: str, kind: str) -> tuple[int, str, tuple]:
        delta, word = self._grow(self._EMPTY, signs)
        return delta, kind, word

    def _next(self, state: tuple, b: int) -> tuple[int, tuple]:
        kind, part, word = state
        if b >= END:
            return self._pending(kind, word) + (b == SPECIAL), ("S", b"", None)
        if not part and 0x80 <= b < 0xC0:  # a chunk's guess began within a sign
            return 0, state
        part += bytes([b])
        if len(part) < (1 if part[0] < 0x80 else 2 if part[0] < 0xE0 else 3 if part[0] < 0xF0 else 4):
            return 0, (kind, part, word)
        total = 0
        for sign in self._form(part.decode("utf-8", "replace")):
            delta, kind, word = self._read(kind, word, sign)
            total += delta
        return total, (kind, b"", word)

    def _made(self, key: int) -> int:
        delta, state = self._next(self.states[key >> 8], key & 255)
        if state not in self.number:
            if len(self.states) >= self.most_states:
                raise Full
            self.number[state] = len(self.states)
            self.states.append(state)
        return self.number[state] << _DELTA | delta + _ZERO

    # ---- runs ----

    def run(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and count of each chunk, from its entry state."""
        if not len(lengths):
            return entry, entry
        order = np.argsort(-lengths, kind="stable")
        at, size = starts[order], lengths[order]
        state, total = entry[order].astype(np.int64), np.zeros(len(order), np.int64)
        many = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # chunks longer than so much
        for t, k in enumerate(many):
            key = (state[:k] << 8) + raw[at[:k] + t]
            found, lacks = self._find(key)
            if len(lacks):
                missing = np.unique(key[lacks]).tolist()
                self._put(missing, [self._made(x) for x in missing])
                found = self._find(key)[0]
            state[:k] = found >> _DELTA
            total[:k] += found & ((1 << _DELTA) - 1)
        exits, counts = np.empty_like(state), np.empty_like(total)
        exits[order], counts[order] = state, total - size * _ZERO
        return exits, counts

    def walk(self, raw: bytes, state: int) -> tuple[int, int]:
        """Exit state and count of one chunk, a byte after the other."""
        total, memo = 0, self.memo
        for b in raw:
            key = state << 8 | b
            found = memo.get(key)
            if found is None:
                value, lacks = self._find(np.array([key], np.int64))
                if len(lacks):
                    value = [self._made(key)]
                    self._put([key], value)
                found = memo[key] = int(value[0])
            state, total = found >> _DELTA, total + (found & ((1 << _DELTA) - 1)) - _ZERO
        return state, total


def composed(entries: np.ndarray, exits: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive prefix scan of state maps: exit state and count at each chunk's end, from the entry of its text's first chunk.

    Maps are rows of entries with their exits and counts; -1 stands for no entry, and for an exit that no map gives. ``first``
    is the number of the first chunk of each chunk's text. Composition is associative, so the scan takes log2 rounds.
    """
    exits, counts = exits.copy(), counts.copy()
    here, step = np.arange(len(first)), 1
    while step <= (here - first).max(initial=0):
        later = np.flatnonzero(here - step >= first)
        left_exit, left_count, right_entry, right_exit, right_count = exits[later - step], counts[later - step], entries[later], exits[later], counts[later]
        # what each entry of the left map becomes; its entries replace the right map's
        hit = (left_exit[:, :, None] == right_entry[:, None, :]) & (left_exit[:, :, None] >= 0)
        pick = hit.argmax(axis=2)
        some = hit.any(axis=2)
        exits[later] = np.where(some, np.take_along_axis(right_exit, pick, 1), -1)
        counts[later] = np.where(some, left_count + np.take_along_axis(right_count, pick, 1), 0)
        entries = entries.copy()
        entries[later] = entries[later - step]
        step *= 2
    return exits[:, 0], counts[:, 0]


class Counter:
    """Tokens of whole texts, as the library gives them without added special tokens."""

    def __init__(self, path: str, chunk: int = 1024, behind: int = 64, most_states: int = 300_000, piece: int = 1 << 16):
        self.machine, self.chunk, self.behind = Transducer(path, most_states), chunk, behind
        self.piece = min(piece, most_states - 2)  # a fresh table has room for the states of so many bytes

    def prepared(self, text: str) -> bytes:
        """The bytes to run over, without the end: special tokens are one byte; what the table of single signs can't normalise
        (signs that combine or come apart, or that this Python doesn't know) is normalised by the library, between blanks."""
        m = self.machine
        if "<" in text and m.special.search(text):
            return bytes([SPECIAL]).join(self.prepared(p) for p in m.special.split(text))
        if not text.isascii():
            new = set(text) - m.safe
            m.safe.update(c for c in new if unicodedata.category(c) != "Cn")
            if not new <= m.safe or not unicodedata.is_normalized("NFC", text):
                plain = lambda s: s.isascii() or unicodedata.is_normalized("NFC", s) and set(s) <= m.safe
                text = "".join(s if plain(s) else m.library.normalizer.normalize_str(s) for s in _SPACES.split(text))
        return text.encode()

    def _scan(self, raws: list[bytes], entry: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and count of each text, from its entry state."""
        length = np.array([len(r) for r in raws], np.int64)
        start = np.cumsum(length) - length
        raw = np.frombuffer(b"".join(raws), np.uint8)
        pieces = np.maximum(-(-length // self.chunk), 1)
        text = np.repeat(np.arange(len(raws)), pieces)
        first = (np.cumsum(pieces) - pieces)[text]
        k = np.arange(len(text)) - first
        begin, end = start[text] + k * length[text] // pieces[text], start[text] + (k + 1) * length[text] // pieces[text]
        guess = np.array(entry, np.int64)[text]
        later = np.flatnonzero(k > 0)
        if len(later):
            back = np.maximum(begin[later] - self.behind, start[text[later]])
            guess[later] = self.machine.run(raw, back, begin[later] - back, np.full(len(later), START))[0]
        exits, counts = self.machine.run(raw, begin, end - begin, guess)
        last = np.cumsum(pieces) - 1
        reached, total = composed(guess[:, None], exits[:, None], counts[:, None], first)
        ends, sums = reached[last], total[last]
        for t in np.flatnonzero(ends < 0).tolist():  # a map of this text lacks the state that it is entered in
            state, count = entry[t], 0
            for c in range(first[last[t]], last[t] + 1):
                if state == guess[c]:
                    state, count = int(exits[c]), count + int(counts[c])
                else:
                    state, more = self.machine.walk(raws[t][begin[c] - start[t] : end[c] - start[t]], state)
                    count += more
            ends[t], sums[t] = state, count
        return ends, sums

    def _counted(self, raws: list[bytes]) -> list[int]:
        m = self.machine
        try:
            return self._scan(raws, [START] * len(raws))[1].tolist()
        except Full:
            m.reset()
        if len(raws) > 1:
            half = len(raws) // 2
            return self._counted(raws[:half]) + self._counted(raws[half:])
        total, state = 0, m.states[START]
        for at in range(0, len(raws[0]), self.piece):  # one text needs more states than the table holds: a piece at a time
            m.reset()
            if state not in m.number:
                m.number[state] = len(m.states)
                m.states.append(state)
            exits, counts = self._scan([raws[0][at : at + self.piece]], [m.number[state]])
            total, state = total + int(counts[0]), m.states[int(exits[0])]
        return [total]

    def count(self, texts: list[str], most_bytes: int = 1 << 22) -> list[int]:
        out, held, size = [], [], 0
        for text in texts:
            held.append(self.prepared(text) + bytes([END]))
            size += len(held[-1])
            if size >= most_bytes:
                out += self._counted(held)
                held, size = [], 0
        return out + (self._counted(held) if held else [])


_loaded: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    A null text is an empty one, of no bytes and tokens; very long texts are counted whole, in chunks; repeated rows and rows
    that share an id or have none each give a row; an empty table gives an empty result. Columns other than id and text are
    ignored. Narrow: no shuffle. A worker holds at most 300,000 states, then starts its table afresh.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer_path not in _loaded:
            _loaded[tokenizer_path] = Counter(tokenizer_path)
        for batch in batches:
            counts, sizes = [], []
            for at in range(0, batch.num_rows, 2_000):
                texts = [t or "" for t in batch.column(1).slice(at, 2_000).to_pylist()]
                counts += _loaded[tokenizer_path].count(texts)
                sizes += [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
