"""Vector operators, page extraction, components and the pipeline."""

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import html, neighbours
from docloom.llm.common import components
from docloom.llm.hnsw import Graph, audited_search, level_norms


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, 7) for i, v, y in rows], "vec_id long, embedding array<float>, label int, shard int")


def sample(seed=1, n=260, dim=12):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[40:60] = v[40]
    v[100:130] = v[100] + rng.normal(size=(30, dim)).astype(np.float32) * 0.12
    rows = [(i, v[i].tolist(), i % 3) for i in range(n)]
    rows[5] = (5, None, 1)
    rows[6] = (6, [0.0] * dim, 1)
    rows[7] = (7, [math.nan] + [1.0] * (dim - 1), 1)
    rows[8] = (8, [None] + [1.0] * (dim - 1), 1)
    rows[9] = (9, [], 1)
    rows[10] = (10, v[10].tolist(), None)
    rows[20] = (20, [1.0, 2.0], 0)
    rows[21] = (21, [1.0, 2.5], 0)
    return rows


def usable(rows):
    return {i: np.array(v, float) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}


@pytest.mark.parametrize("shard_rows", [64, 8192])
def test_search_equals_brute_force(spark, shard_rows):
    rows = sample()
    good = {i: np.array(v, np.float32).astype(float) for i, v in usable(rows).items()}
    got = {}
    for r in neighbours.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, shard_rows=shard_rows, query_rows=5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = total = 0
    for q in (i for i in good if i % 20 == 0):
        want = sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:20]
        mine = got.get(q, {})
        assert sorted(mine) == list(range(1, len(want) + 1))
        pairs = [mine[k] for k in sorted(mine)]
        assert pairs == sorted(pairs, key=lambda p: (-p[1], p[0])) and all(abs(float(good[q] @ good[i]) - s) < 1e-9 for i, s in pairs)
        hits += len({i for i, _ in pairs} & {i for _, i in want})
        total += len(want)
    assert hits >= 0.97 * total


@pytest.mark.parametrize("shard_rows", [16, 8192])
def test_near_duplicates_equal_brute_force(spark, shard_rows):
    rows = sample(2)
    good, label = {i: np.array(v, np.float32).astype(float) for i, v in usable(rows).items()}, {i: y for i, _, y in rows}
    links = {i: set() for i, _, _ in rows}
    for i, v in good.items():
        for j, w in good.items():
            if i != j and label[i] is not None and label[i] == label[j] and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[i].add(j)
    part = {i: i for i in links}
    for _ in links:
        part = {i: min([part[i], *(part[j] for j in js)]) for i, js in links.items()}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(vectors(spark, rows), shard_rows=shard_rows).collect()}
    assert got == {i: (len(js), part[i], part[i] == i) for i, js in links.items()}


def dense(sizes, dim=8, noise=0.2, seed=4):
    """Groups of near copies around random vectors, some links in them a little under the bound."""
    rng = np.random.default_rng(seed)
    found = [x + rng.normal(size=(n, dim)) * noise for n, x in zip(sizes, rng.normal(size=(len(sizes), dim)), strict=True)]
    return np.concatenate(found).astype(np.float32)


@pytest.mark.parametrize("shard_rows", [300, 8192])
def test_links_of_groups_around_what_a_task_holds(spark, shard_rows):
    v = dense([700, 250, 190, 60, 9, *[1] * 100])
    unit = v.astype(float) / np.sqrt((v.astype(float) ** 2).sum(1, keepdims=True))
    near = unit @ unit.T >= 0.93
    rows = [(int(i), x.tolist(), 1) for i, x in enumerate(v)]
    got = {r.vec_id: r.n_links for r in neighbours.near_duplicates(vectors(spark, rows), shard_rows=shard_rows).collect()}
    assert got == dict(enumerate((near.sum(1) - 1).tolist()))


def test_memory_of_links_does_not_grow_with_their_number():
    v = dense([2_500], dim=64, noise=0.1)
    graph, ones = Graph.build(neighbours._unit(v)), np.ones(len(v), np.int64)
    tracemalloc.start()
    count, root, node = neighbours._linked(graph, v, v, ones, ones, 0.93, 48, True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count.sum() > 6_000_000 and len(node) == len(v) - 1 and most < 400e6  # twice six million vectors of 64 doubles are 6 GB


def test_no_vectors(spark):
    none = vectors(spark, [])
    assert neighbours.search(none, F.col("vec_id") % 20 == 0).count() == 0 and neighbours.near_duplicates(none).count() == 0


def test_graph_survives_flattening_and_audits():
    v = level_norms(np.random.default_rng(3).normal(size=(900, 16)).astype(np.float32))
    g = Graph.build(v)
    again = Graph.load(g.dump(), v.shape[1])
    q = v[:50]
    a, b = g.search(q, 40)[0], again.search(q, 40)[0]
    assert (a == b).all()
    top = np.argsort(-(q @ v.T), 1)[:, :10]
    found = audited_search(again, q, 10, 10)[0]
    assert np.mean([len(set(x) & set(y)) / 10 for x, y in zip(found[:, :10], top, strict=True)]) >= 0.9


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(300, i) for i in range(301, 340)] + [(i, i + 1) for i in range(400, 430)]
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGE = """<html><head><title>x</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-banner">We use cookies. Accept all of them now please.</div><div id="wrap"><main><article><h1>My Title</h1><p>First para has many
 words in it, &amp; it ends.</p><div class="ad-slot">Buy now!</div><p>Second&nbsp;para <b>bold</b>.<ul><li>item one<li>item two</ul><p hidden>unseen text here</p>
<div class="share-buttons">Share this</div><script>var a = "<p>no</p>";</script><p>Ok.</article><section id="comments"><p>Bob: I like this article a lot, really wonderful stuff.</p></section></main>
<aside><h2>Related</h2><p>Another long story that one can read elsewhere on this site today.</p></aside></div><form><label>Email</label><input></form><footer>&copy; me</footer></body></html>"""


def test_main_text_of_a_page():
    assert html.main_text(PAGE) == "My Title\nFirst para has many words in it, & it ends.\nSecond para bold.\nitem one\nitem two\nOk."


def test_pages(spark):
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<nav>only a menu</nav>"), (5, "u", "<p>cut off in the middle of a long sentence, <b>which is fine"), (7, "u", "< & <<>> </p></div>"),
             (6, "u", "<article>" + "<p>A sentence of a very long page stands here.</p>" * 3000)]
    rows = html.extract(spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, text string")).collect()
    assert len(rows) == 7 and all(r.n_chars == len(r.text) for r in rows)
    by = {(r.page_id, r.n_chars > 5): r.text for r in rows}
    assert by[2, False] == by[3, False] == by[4, False] == "" and by[5, True] == "cut off in the middle of a long sentence, which is fine"
    assert by[6, True].count("\n") == 2999
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_least_cut_by_trying_all_labels():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(1, 8))
        ends = [(float(a), float(b)) for a, b in rng.random((n, 2))]
        edges = [(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(0, n, 9), rng.integers(0, n, 9), rng.random(9), strict=True) if a != b]

        def cost(keep):
            return sum(two if k else one for k, (one, two) in zip(keep, ends, strict=True)) + sum(c for a, b, c in edges if keep[a] != keep[b])  # noqa: B023

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html.least_cut(ends, edges)) - best) < 1e-9


def test_pipeline_stages(spark):
    """Each stage keeps the columns of documents and follows its operator; the last covers every document left."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert out.columns == columns and out.count() <= before, name
        assert name in ("quality classifier", "minhash near-dedup") or out.count() == before
        docs, before = out, out.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count() > 100


def test_packed_sequences_follow_the_schedule(spark):
    """Over partitions every document of an earlier one is due before those of a later one; inside, sequences go by their first document."""
    import corpus_pipeline

    from docloom.llm import mixing

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").dropDuplicates(["doc_id"]).orderBy("text").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        packed = corpus_pipeline.pack_windows(spark, docs, sf).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    slot = {r.doc_id: (r.mix_slot, -1 if r.doc_id is None else r.doc_id) for r in mixing.mix(docs).collect()}
    first = {}
    for r in packed:
        first[r.sequence_id] = min(first.get(r.sequence_id, slot[r.doc_id]), slot[r.doc_id])
    order = [first[s] for s in sorted(first)]
    assert {r.doc_id for r in packed} == set(slot) and len({s >> 32 for s in first}) > 1 and order == sorted(order)
