"""The compiled transducer against the library."""

import random
import unicodedata

import numpy as np
import pyarrow.parquet as pq
import pytest

from docloom.llm import queries, token_counts
from docloom.llm.token_counts import START, Counter, composed

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def counter():
    return Counter(PATH)


def library(counter, texts):
    return [len(e.ids) for e in counter.machine.library.encode_batch(texts, add_special_tokens=False)]


def same(counter, texts):
    got, want = counter.count(texts), library(counter, texts)
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_signs_between_others(counter):
    """Signs up to U+1FFFF that normalisation changes or that aren't plain letters, and some of the others, beside letters, digits, marks, blanks and signs."""
    signs = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    plain = lambda c: unicodedata.category(c) in ("Lo", "So", "Cn", "Co") and unicodedata.is_normalized("NFC", c)
    signs = [c for c in signs if not plain(c) or ord(c) % 61 == 0]
    same(counter, [f"a{c}. {c}\u0301 '{c}s9{c}" for c in signs])


def test_normal_forms_are_stable_by_sign(counter):
    """What the library makes of a sign stays as it is, sign by sign: a normalised piece can be read by the table again."""
    form = counter.machine.library.normalizer.normalize_str
    assert [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 for x in form(c) if form(x) != x] == []


def test_borders_between_tokens_are_those_of_merging(counter):
    m, rng = counter.machine, random.Random(6)
    inner, last = sorted(m.inner), sorted(m.last)
    common = [t for t in inner if t.isascii() and t.isalpha()]
    good = 0
    for k in range(30_000):
        left = rng.choice(common if k % 2 else inner)
        right, ends = rng.choice([(rng.choice(common if k % 2 else inner), False), (rng.choice(last), True)])
        if m._made_of("".join(token_counts._BYTE_SIGNS[x] for x in left)) is None:
            continue
        parts = [token_counts._BYTE_SIGNS[x] for x in left + right]
        parts[-1] += "</w>" * ends
        want = [len(p.removesuffix("</w>")) for p in m._merged(parts)[0]] == [len(left), len(right)]
        assert m._fits(left, right, ends) == want, (left, right, ends)
        good += want
    assert 1_000 < good < 29_000


PIECES = ["the", "Straße", "don't", "'", "''s", "'re", "'rest", "'v", "'ll", " ", "\n", " ", " ", "12", "½", "!?", "...", "$#", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "<|startoftext|>", "é", "é", "क़.", "한국", "가", "漢字", "🙂", "👩‍👩‍👧", "İ", "ΣΣ", "ﬁ", "\U00011382\U000113c9", "\U0001e921", "a" * 90, "\x85", "\x1c", "​", "الله", "ड़", "�", "\U000e0001"]


@pytest.mark.parametrize("chunk, behind", [(1024, 64), (7, 3), (16, 0), (1, 1)])
def test_random_texts_in_chunks_of_any_size(chunk, behind):
    rng = random.Random(chunk)
    counter = Counter(PATH, chunk=chunk, behind=behind)
    same(counter, ["".join(rng.choice(PIECES) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 40))) for _ in range(600)])


def test_small_tables_start_afresh_and_long_runs_go_piece_by_piece():
    rng = random.Random(8)
    counter = Counter(PATH, chunk=64, behind=8, most_states=400)
    same(counter, ["".join(rng.choice("abcdefghijklmnop'é9+/") for _ in range(n)) for n in (2_000, 0, 3, 4_000, 700)] + ["word " * 3_000])
    assert len(counter.machine.states) <= 400


def test_chunks_entered_in_another_state_are_walked_through(counter):
    """Without a look behind, a chunk within a word begins in the wrong state."""
    blind = Counter(PATH, chunk=32, behind=0)
    same(blind, ["pneumonoultramicroscopicsilicovolcanoconiosis" * 40, "x" * 3_000, "ab" * 999 + " c"])


def test_scan_of_state_maps_is_composition():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n, states = int(rng.integers(1, 20)), 4
        first = np.maximum.accumulate(np.where(rng.random(n) < 0.3, np.arange(n), 0))
        entries = np.tile(np.arange(states), (n, 1))
        entries[first == np.arange(n)] = [START, -1, -1, -1]
        exits, counts = rng.integers(0, states, (n, states)), rng.integers(0, 9, (n, states))
        got = composed(entries, exits, counts, first)
        for k in range(n):
            state, total = START, 0
            for j in range(first[k], k + 1):
                e = list(entries[j]).index(state)
                state, total = exits[j, e], total + counts[j, e]
            assert (got[0][k], got[1][k]) == (state, total)


def test_other_kinds_of_tokenizer_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        Counter(queries.tokenizer_path("byte_bpe_50k.json"))


def test_whole_table_against_the_library(spark, counter):
    folder = "/root/testdata/sf0.01"
    docs = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    want = {d["doc_id"]: n for d, n in zip(docs, library(counter, [d["text"] or "" for d in docs]), strict=True)}
    rows = queries.op13_token_counts(spark, folder).collect()
    assert len(rows) == len(docs) and {r.doc_id: r.n_tokens for r in rows} == want
    assert all(r.n_bytes == len((d["text"] or "").encode()) for r, d in zip(sorted(rows, key=lambda r: r.doc_id), sorted(docs, key=lambda d: d["doc_id"]), strict=True))
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)


def test_odd_rows(spark, counter):
    texts = [None, "", " ", "x", "x", "a b " * 40_000, "\x00", "z" * 100_000]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in zip([1, 1, None, None, 2, 2, 3, 4], texts, strict=True)], "doc_id long, text string, n_bytes int, n_tokens string")
    rows = token_counts.count_tokens(df, PATH).collect()
    want = library(counter, [t or "" for t in texts])
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted((len((t or "").encode()), n, n > 2048) for t, n in zip(texts, want, strict=True))
    assert token_counts.count_tokens(df.limit(0), PATH).collect() == []
