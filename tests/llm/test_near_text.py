"""Near-dedup of a whole table against all pairs, with shingles, frequencies and similarities of its own; pieces of the operator."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from docloom.llm import minhash, queries

DATA = "/root/testdata/sf0.01"


def shingles(text):
    found = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    return Counter(tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))) if found else Counter()


def weighted(docs):
    """Pairs of different texts with their weighted Jaccard similarity, where they share a shingle."""
    n, df = len(docs), Counter()
    texts = {t: min(i for i, u in docs if u == t) for _, t in docs}
    sets = {i: shingles(t) for t, i in texts.items()}
    for _, t in docs:
        df.update(set(sets[texts[t]]))
    idf = {s: max(0.05, math.log((n + 1) / (c + 0.5))) for s, c in df.items()}
    total = {i: sum(c * idf[s] for s, c in x.items()) for i, x in sets.items()}
    where, both = defaultdict(list), defaultdict(float)
    for i, x in sets.items():
        for s, c in x.items():
            where[s].append((i, c))
    for s, places in where.items():
        for (i, a), (j, b) in itertools.combinations(places, 2):
            both[i, j] += min(a, b) * idf[s]
    return {(i, j): x / (total[i] + total[j] - x) for (i, j), x in both.items()}, texts


def test_query_against_all_pairs_of_the_whole_table(spark):
    table = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    docs = [(r["doc_id"], r["text"] or "") for r in table]
    pairs, texts = weighted(docs)
    rows = {r.doc_id: r for r in queries.op7_minhash(spark, DATA).collect()}
    assert len(rows) == len(docs)
    assert all(rows[i].class_id == rows[texts[t]].class_id for i, t in docs)  # equal texts
    sure = [p for p, x in pairs.items() if x >= 0.805]
    found = sum(rows[i].class_id == rows[j].class_id for i, j in sure)
    assert sure and found == len(sure)
    part = {i: i for i in texts.values()}  # components of all that might be linked
    for _ in range(50):
        for (i, j), x in pairs.items():
            if x >= 0.795:
                part[i] = part[j] = min(part[i], part[j])
    assert all(part[texts[t]] == part[rows[i].class_id] for i, t in docs)  # nothing else is joined
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows.values())


def test_recall_on_edited_copies(spark):
    """Copies with more and more words changed, against all pairs."""
    rng = random.Random(6)
    docs = []
    for _ in range(60):
        base = [f"w{rng.randrange(3_000)}" for _ in range(rng.randint(60, 300))]
        for edits in (0, 1, 2, 3, 4, 6):
            text = list(base)
            for _ in range(edits):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(text)))
    pairs, _ = weighted(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    sure = [p for p, x in pairs.items() if x >= 0.81]
    assert len(sure) > 200 and sum(rows[i] == rows[j] for i, j in sure) >= 0.99 * len(sure)
    assert all(i // 6 == c // 6 for i, c in rows.items())


@pytest.mark.parametrize("docs, words, share", [(1_000, 50_000, 0.02), (100_000, 400_000, 0.0005)])
def test_frequencies_stay_told_apart_when_counters_are_full(docs, words, share):
    """Counters hold many shingles each; common shingles keep their weight and rare ones the same high one."""
    rng = np.random.default_rng(2)
    bits = 14
    df = np.maximum(1, (docs * 0.2 / (1 + np.arange(words)) ** 1.1)).astype(np.int64)
    cell = rng.integers(0, 1 << bits, words)
    counts = np.bincount(cell, df, 1 << bits)
    got = minhash.inverse_frequencies(counts, docs)[cell]
    exact = np.log((docs + 1) / (df + 0.5))
    common = df > docs * share
    assert np.abs(got - exact)[common].mean() < 0.25
    assert got[~common].std() < 1.0 and got[~common].mean() > got[common].max() - 1.0


def test_failed_texts_are_compared_with_all(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(6)]
    docs = [(k, " ".join(base[k % 6][: 60 - k // 40]), k % 6) for k in range(240)]
    idf = np.ones(1 << 12)
    found = [minhash.Shingles().of(t) for _, t, _ in docs]
    for first in (None, 1, 30, 239):
        edges = minhash.linked(found, idf, 0.8, first)
        assert all(a < b and docs[a][2] == docs[b][2] and (first is None or a < first <= b) for a, b in edges)
        part = {k: k for k in range(240)}
        for _ in range(30):
            for a, b in edges:
                part[a] = part[b] = min(part[a], part[b])
        for b in range(first or 0, 240):
            near = [a for a in range(first or b) if docs[a][2] == docs[b][2] and minhash.similarity(found[a], found[b], idf) >= 0.8]
            assert all(part[a] == part[b] for a in near)


@pytest.mark.parametrize("chunk", [4, 512])
def test_buckets_with_a_bad_lead(spark, monkeypatch, chunk):
    """The text of the smallest id shares a bucket with others and is like none of them."""
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rng = random.Random(8)
    one, two = ([f"{c}{rng.randrange(10**6)}" for _ in range(80)] for c in "ab")
    texts = {0: " ".join(one + two)} | {k: " ".join(one[: 80 - k % 3]) for k in range(1, 20)} | {k: " ".join(two[: 80 - k % 3]) for k in range(20, 40)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").where("doc_id >= 0")
    idf = spark.sparkContext.broadcast(np.ones(1 << 12))
    for failed in (range(1, 40), range(20, 40), [25]):
        members = spark.createDataFrame([(0, 7, k, len(texts), k in failed, len(failed)) for k in texts], "band int, key long, doc long, n long, failed boolean, fails long")
        edges = [tuple(r) for r in minhash._within(members, docs, idf, 0.8).collect()]
        part = {k: k for k in texts}
        for _ in range(40):
            for a, b in edges:
                part[a] = part[b] = min(part[a], part[b])
        for x in (range(1, 20), range(20, 40)):  # what failed is with its like; the others hang together by their lead
            if set(x) & set(failed):
                assert len({part[k] for k in x}) == 1
        assert part[0] == 0 and part[1] != part[20]


def test_copies_in_a_large_group_of_a_large_table(spark):
    """Copies with five words changed, over 0.8 by plain Jaccard; the group is large, so its text is common and the edits are rare."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    docs = [(0, " ".join(base))] + [(k, " ".join(base[: 5 * k] + [f"x{k}y{i}" for i in range(5)] + base[5 * k + 5 :])) for k in range(1, 17)]
    docs += [(k, " ".join(f"v{rng.randrange(10**6)}" for _ in range(30))) for k in range(17, 3_000)]
    rows = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(rows[k] == 0 for k in range(17)) and all(rows[k] == k for k in range(17, 3_000))
