"""Rows that share an id, columns with clashing names, repeated rows: one row out for each row in, and nothing lost between them."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import common, line_dedup, neighbours
from docloom.llm.hnsw import Graph, level_norms

FIELDS = "vec_id long, embedding array<float>, label int"


def cut(docs, min_lines=4, min_words=10, run_words=3, run_chars=16):
    """Line dedup by the quadratic definition; docs are (id, text); equal rows are one document. Order within an id is open, so ids that differ in text must not share lines."""
    own = sorted({(i, t) for i, t in docs if i is not None and t is not None}, key=lambda d: d[0])
    first, out = {}, {}
    for d, (_, t) in enumerate(own):
        x = [y.strip(" ") for y in t.split("\n")]
        for n in range(1, min_lines + 1):
            for p in range(len(x) - n + 1):
                first.setdefault(tuple(x[p : p + n]), (d, p))
    for d, (i, t) in enumerate(own):
        lines, x, gone = t.split("\n"), [y.strip(" ") for y in t.split("\n")], set()
        for n in range(1, min_lines + 1):
            for p in range(len(x) - n + 1):
                run = x[p : p + n]
                enough = n == min_lines or n == 1 and len(run[0].split()) >= min_words or sum(len(y.split()) for y in run) >= run_words or sum(map(len, run)) >= run_chars
                if enough and first[tuple(run)] < (d, p):
                    gone.update(range(p, p + n))
        out[i, t] = "\n".join(y for k, y in enumerate(lines) if k not in gone), len(gone)
    return out


def test_line_dedup_of_documents_that_share_an_id(spark):
    common = "a line that several documents have\nand one more of them"
    docs = [(1, f"one of its own here\n{common}"), (7, f"{common}\nthe first seven keeps this line"), (7, "the second seven has a line alone\nwhich stays as it is"),
            (7, "the second seven has a line alone\nwhich stays as it is"), (9, f"nine says so\n{common}\n{common}"), (9, None), (None, common), (5, ""), (6, "\n\n\n\n\n")]
    docs += [(3, f"a hundred rows of one id\nnumber {k} of them all") if k else (3, common) for k in range(1, 100)]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, __doc int, __gone int, runs int")
    got = line_dedup.dedup_lines(df, run_words=3)
    assert got.columns == [*df.columns, "lines_removed"]
    rows = got.collect()
    want = cut([d for d in docs if d[0] != 3])
    assert len(rows) == len(docs) and Counter(r.doc_id for r in rows) == Counter(d[0] for d in docs)
    for i, t in docs:
        if i is None or t is None:
            assert (t, 0) in {(r.text, r.lines_removed) for r in rows if r.doc_id == i}
        elif i != 3:
            assert want[i, t] in {(r.text, r.lines_removed) for r in rows if r.doc_id == i}
    of_three = [r for r in rows if r.doc_id == 3]
    assert sum(r.lines_removed for r in of_three) == 98 and all(any(f"number {k} of" in r.text for r in of_three) for k in range(1, 100))


def test_maximal_runs(spark):
    found = spark.createDataFrame([(1, 0, 4, 1), (1, 0, 2, 2), (1, 0, 5, 3), (1, 0, 12, 1), (2, 0, 0, 4), (2, 0, 1, 4)], "doc long, body long, pos int, reach int")
    got = {r.doc: [tuple(x) for x in r.runs] for r in line_dedup.maximal_runs(found).collect()}
    assert got == {1: [(2, 6), (12, 1)], 2: [(0, 5)]}


def test_very_many_removed_lines(spark):
    text = "\n".join(f"line number {k} of a long text" for k in range(30_000))
    rows = line_dedup.dedup_lines(spark.createDataFrame([(1, text), (2, text + "\nx"), (3, "y")], "doc_id long, text string"), run_words=3).orderBy("doc_id").collect()
    assert [(r.text, r.lines_removed) for r in rows] == [(text, 0), ("x", 30_000), ("y", 0)]


def test_near_duplicates_tell_rows_of_one_id_apart(spark):
    rows = [(1, [1.0, 0.0], 1), (1, None, 1), (2, [1.0, 0.01], 1), (1, [0.0, 1.0], 1), (3, [0.0, 2.0], 1), (3, [0.0, 2.0], 1), (4, [-1.0, 0.0], 1), (None, [1.0, 0.0], 1), (5, [1.0, 0.0], None), (0, [0.0, 1.0], 2)]
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(spark.createDataFrame(rows, FIELDS)).collect())
    assert got == Counter([(1, 1, 1, True), (1, 0, 1, True), (2, 1, 1, False), (1, 2, 1, True), (3, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (None, 0, None, True), (5, 0, 5, True), (0, 0, 0, True)])


def test_search_with_several_vectors_under_an_id_and_repeated_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 1.0], 1), (20, [0.0, 3.0], 1), (20, [3.0, 0.0], 1)]
    got = [tuple(r) for r in neighbours.search(spark.createDataFrame(rows, FIELDS), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 3.0), (0, 2, 1, 2.0), (0, 3, 2, 1.0), (20, 1, 1, 6.0), (20, 2, 0, 3.0), (20, 3, 2, 3.0)]


def test_vectors_in_double_precision_beyond_floats(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 6)) * 1e100
    v[30:] = v[:30] + rng.normal(size=(30, 6)) * 1e90
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    found = neighbours.search(df, F.col("vec_id") % 20 == 0, k=5).collect()
    assert len(found) == 15 and all(math.isclose(r.score, float(v[r.query_id] @ v[r.vec_id]), rel_tol=1e-12) for r in found)
    far = spark.createDataFrame([(i, (x * 1e100).tolist(), 1) for i, x in enumerate(v)], df.schema)
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(far).collect()}
    assert all(got[i] == (1, i % 30) for i in range(60) if got[i][0] == 1) and sum(n for n, _ in got.values()) >= 60


@pytest.mark.parametrize("shape", ["even", "dense group", "equal", "line"])
def test_graphs_grown_by_insertion_find_what_is_near(shape):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(5_000, 24)).astype(np.float32)
    if shape == "dense group":
        v[1_000:3_000] = v[0] + rng.normal(size=(2_000, 24)).astype(np.float32) * 0.05
    elif shape == "equal":
        v[10:4_000] = v[10]
    elif shape == "line":
        v = np.linspace(0, 9, 5_000, dtype=np.float32)[:, None] * v[:1] + v[1:2]
    v = level_norms(v)
    g = Graph.build(v)
    assert len(np.concatenate(g.nodes)) >= 5_000 and all(x.shape[1] <= 64 for x in g.links)
    q = v[::50]
    near = np.sort(q @ v.T, 1)[:, ::-1][:, :10]
    sims = g.search(q, 64)[1][:, :10]
    assert (sims >= near[:, -1:] - 1e-4).mean() >= 0.95


def test_shards_stop_growing_in_number_before_tasks_are_full():
    """Every query asks every shard: up to a million vectors of 64 numbers their number stays the same, so that only queries and rows grow."""
    asked = [math.ceil(n / neighbours.rows_a_shard(n, 64, neighbours.SHARD_ROWS)) for n in (10_256, 51_282, 131_072, 262_144, 615_384, 1_000_000)]
    assert asked == [2, 7, 16, 16, 16, 16]
    assert neighbours.rows_a_shard(10**9, 64, neighbours.SHARD_ROWS) == neighbours.MOST_SHARD_ROWS and neighbours.rows_a_shard(10**9, 4_096, 16) == neighbours.MOST_SHARD_BYTES // (4 * 4_096)


def test_beams_open_several_nodes_in_a_step_and_compare_a_node_once(monkeypatch):
    rng = np.random.default_rng(8)
    v = level_norms(rng.normal(size=(3_000, 24)).astype(np.float32))
    g, q, steps, pairs = Graph.build(v), v[::100], [], []
    take = np.take

    def counted(a, i, axis=None):
        if a is g.vectors:
            steps.append(len(i)), pairs.append(i)
        return take(a, i, axis)

    monkeypatch.setattr(np, "take", counted)
    ids, sims = g._beam(q, 0, np.repeat(g.nodes[-1][None, :1], len(q), 0), 64, 8)
    monkeypatch.undo()
    assert 0 < len(steps) <= 16 and max(map(len, pairs)) < len(q) * 8 * 64  # 64 places of a beam, 8 a step: 8 steps at least
    assert all(len(set(x)) == 64 for x in ids.tolist()) and (np.diff(sims, axis=1) <= 0).all()
    assert np.allclose(sims, np.einsum("qd,qkd->qk", q, v[ids]), atol=1e-4)
    near = np.sort(q @ v.T, 1)[:, ::-1][:, :10]
    assert (sims[:, :10] >= near[:, -1:] - 1e-4).mean() >= 0.95


def test_partitions_of_settled_frames_grow_with_the_input(spark, tmp_path, monkeypatch):
    """Cores are a minimum; beyond it the bytes of the files count, those of a join for both sides, those of local rows not."""
    spark.range(200_000).selectExpr("id", "md5(cast(id as string)) as x").repartition(64).write.parquet(f"{tmp_path}/t")
    files = spark.read.parquet(f"{tmp_path}/t")
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert common.read_bytes(files) == size and common.read_bytes(files.join(files.withColumnRenamed("x", "y"), "id")) == 2 * size
    local = spark.createDataFrame([(1, "a")], "id long, x string")
    assert common.read_bytes(local.union(files)) < 1.01 * size
    assert common.read_bytes(spark.range(1 << 40)) == 1 << 43  # sizes beyond 32 bits come whole
    cores = spark.sparkContext.defaultParallelism
    wide = files.repartition(60, "x")
    assert common.gathered(wide, 1).rdd.getNumPartitions() == cores
    monkeypatch.setattr(common, "CORE_BYTES", size // 20)
    assert 20 <= common.gathered(wide, 1).rdd.getNumPartitions() <= 21 and common.gathered(wide, 2).rdd.getNumPartitions() >= 40
