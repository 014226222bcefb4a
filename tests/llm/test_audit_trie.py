"""Filter audit and prefix trie against plain definitions, on odd rows, hot groups and empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docloom.llm import filter_audit, prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- filter audit ----


def plain_audit(docs, labels):
    low, fails = {}, []
    for i, text, _ in docs:
        if i is not None:
            low[text or ""] = min(low.get(text or "", i), i)
    good, toxic = ({i for i, *m in labels if i is not None and m[k] == 1} for k in (0, 1))
    for i, text, source in docs:
        t = text or ""
        words = WORD.findall(t)
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and low[t] < i}
        fails.append((source or "", {x for x in f if f[x]}, i))
    out, shapley = {}, Counter()
    for part in {p for p, _, _ in fails}:
        own = [(f, i) for p, f, i in fails if p == part]
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [i for f, i in own if x in f and not f & before]
                shapley[part, x] += len(gone)
                out[part, "".join(order), step] = [
                    x, sum(not f & (before | {x}) for f, _ in own), len(gone), sum(x in f and bool(f & before) for f, _ in own), sum(f == {x} for f, _ in own), sum(i in good for i in gone), sum(i in toxic for i in gone),
                ]
    return {(*k, *v, shapley[k[0], v[0]]) for k, v in out.items()}


def audit_rows(spark, docs, labels):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, source string, part string, applied int")
    m = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    return [tuple(r) for r in filter_audit.audit(d, m).collect()]


def test_audit_of_odd_rows(spark):
    rng = random.Random(3)
    base = ["", None, "  \t\r\n", "A b c", "tail # x", "%", "é" * 70, " ".join(f"w{k}" for k in range(60)), " ".join(f"W{k}X" for k in range(60)) + " $", " ".join(["same"] * 80), " ".join(f"w{k % 30}\x0b" for k in range(60)), "\xa0".join(map(str, range(60))), "a " * 50_000]
    docs = [(rng.choice([None, *range(40)]), rng.choice(base), rng.choice([None, "", "a", "b"])) for _ in range(150)]
    docs += [(k, "hot copy of a third", "a") for k in range(100, 180)] + [(7, "hot copy of a third", "c")] * 3
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in [None, *range(0, 160), 5, 5, 6]]
    rows = audit_rows(spark, docs, labels)
    assert len(rows) == len(set(rows)) == 600 * 4 and set(rows) == plain_audit(docs, labels)
    assert audit_rows(spark, [], labels) == []
    assert set(audit_rows(spark, docs[:20], [])) == plain_audit(docs[:20], [])


# ---- prefix trie ----


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", (text or "")[:64], hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    convs = {c: [(r, t) for _, _, r, _, _, t in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seq = convs.get(base, [])[:h] + own[h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].add(c)
        ends[tuple(seq)].add(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
        for k, m in members.items()
    )


def trie_rows(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, key int, path string")
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie.build(df, **how).collect())


def conversations(seed):
    rng = random.Random(seed)
    texts, roles = ["", None, "a", "a b", "b\tc d", "long " * 3_000, "é"], ["user", "assistant", None, ""]
    rows = []
    for c in rng.sample(range(-60, 200), 120):
        kind = rng.random()
        if kind < 0.35:  # a hot conversation
            rows += [(c, k, "user", f"hot {k}") for k in range(6)]
        elif kind < 0.6:  # a hot first part
            rows += [(c, k, "user", f"hot {k}") for k in range(5)] + [(c, 5 + k, "user", rng.choice("xyz")) for k in range(rng.randint(0, 3))]
        else:
            rows += [(c, rng.choice([None, 0, 1, 2, 3]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "lost"), (300, 0, "user", "alone")] + [(311, k, None, None) for k in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, how", [(1, {}), (1, {"shard_convs": 1, "shard_turns": 1}), (2, {"shard_convs": 3, "shard_turns": 10}), (3, {"shard_convs": 12})])
def test_trie_of_odd_rows(spark, seed, how):
    rows = conversations(seed)
    assert trie_rows(spark, rows, **how) == plain_trie(rows)


def test_trie_of_little(spark):
    for rows in ([], [(None, 1, "user", "x")], [(5, 0, "user", "x")], [(c, 0, "user", "x") for c in (8, 9, 10, 11, 12, 13)]):
        assert trie_rows(spark, rows) == plain_trie(rows)


def test_bits_are_a_level_order_trie():
    rng = random.Random(5)
    paths = sorted({tuple(rng.randint(0, 2) for _ in range(rng.randint(1, 6))) for _ in range(80)})
    keys, where = [], {}
    for p in paths:  # a key stands for a whole prefix
        for d in range(1, len(p) + 1):
            where.setdefault(p[:d], len(where) + 1)
            keys.append((where[p[:d]], 7))
    lengths = np.array([len(p) for p in paths])
    trie = prefix_trie.Louds(np.array(keys, np.uint64), np.cumsum(lengths) - lengths, lengths)
    n = len(where) + 1
    assert trie.levels[-1] == n and trie.bits.sum() == n - 1 and (~trie.bits).sum() == n
    name = {int(k[0]): p for k, p in zip(np.array(keys)[trie.label[1:]], range(1, n), strict=True)}
    back = {v: k for k, v in where.items()}
    parents = trie.parents()
    for key, node in name.items():
        above = back[key][:-1]
        assert parents[node] == (name[where[above]] if above else 0)
    assert list(trie.degrees()) == [sum(parents[1:] == k) for k in range(n)]
    assert trie.rolled_up(np.ones(n, np.int64))[0] == n
