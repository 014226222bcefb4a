"""Approximate nearest neighbours and embedding near-dedup over graphs per shard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import BUSY, LIGHT, components, discard, settle
from docloom.llm.hnsw import Graph, audited_search, level_norms

SHARD_ROWS = 8_192
MOST_SHARD_ROWS, MOST_SHARD_BYTES = 65_536, 32 << 20
FEW_SHARDS = 16
QUERY_ROWS = 1_024
TASK_ROWS = 16_384
COSINE = 0.93
PROBES = 64
HELD = 192  # links of a query found by beams; one with more is compared with the whole shard
CELLS = 1 << 22  # numbers of a matrix of cosines, four times those of the vectors compared in double precision at once
_GRAPH = "sizes binary, nodes binary, widths binary, links binary"
_PARTS = "ids binary, ends binary, vectors binary, " + _GRAPH


def usable(vectors: DataFrame, keep: tuple[str, ...] = (), others: bool = False) -> DataFrame:
    """(vec_id, blob, dim, *keep) of vectors that are not null, empty or zero and whose components are all finite.

    The blob holds the components as they are, 32- or 64-bit floats; minus zero becomes zero, so equal vectors have equal
    blobs. With ``others`` the remaining rows come too, those without a vec_id among them, with null blobs.
    """
    kind = precision(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, blobs, dims = [], [], []
            for known, value in zip(batch.column(0).is_valid().to_pylist(), batch.column(1), strict=True):
                v = None if not known or not value.is_valid or value.values.null_count else value.values.to_numpy(zero_copy_only=False).astype(kind)
                ok.append(v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any()))
                blobs.append((v + 0.0).tobytes() if ok[-1] else None)
                dims.append(len(v) if ok[-1] else None)
            new = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(blobs, pa.binary()), pa.array(dims, pa.int32()), *batch.columns[2:]], names=["vec_id", "blob", "dim", *keep]
            )
            yield new if others else new.filter(pa.array(ok, pa.bool_()))

    base = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>" if kind == "<f8" else "array<float>"), *keep)
    kinds = "".join(f", {c} {base.schema[c].dataType.simpleString()}" for c in keep)
    return base.mapInArrow(run, f"vec_id long, blob binary, dim int{kinds}")


def precision(vectors: DataFrame) -> str:
    """Floats are kept as 32 bits if that is what the column holds, everything else as 64 bits."""
    return "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"


def rows_a_shard(n: int, dim: int, least: int) -> int:
    """Rows a shard: ``least`` up to ``FEW_SHARDS`` shards, then growing to what a task holds with ease, so that there are fewer shards to ask."""
    most = max(least, min(MOST_SHARD_ROWS, MOST_SHARD_BYTES // (4 * max(1, dim))))
    return min(most, max(least, math.ceil(n / FEW_SHARDS)))


def _stack(batches: Iterator[pa.RecordBatch], *names: str) -> list:
    found = pa.Table.from_batches(list(batches))
    return [found.column(n).to_pylist() for n in names]


def _row(values: dict, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], kinds[t]) for n, t in fields], names=[n for n, _ in fields])


def _served(found: DataFrame, keys: list[str], tasks: int, load, ask, schema: str) -> DataFrame:
    """Per task of ``keys``: the row of block -1 is loaded once, then the blocks of questions stream past it.

    ``load`` gives the state for ``ask`` and results that need no question.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["block"] < 0:
                    state, first = load(row)
                    yield from first
                else:
                    yield from ask(state, row)

    spread = tasks + min(3 * tasks, 200)  # few tasks would often meet in one partition
    return found.repartition(spread, *keys).sortWithinPartitions(*keys, "block").mapInArrow(run, schema)


def search(
    vectors: DataFrame, is_query, k: int = 20, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, ef: int = 64
) -> DataFrame:
    """The ``k`` nearest rows by inner product of every query row: query_id, rank, vec_id, score.

    Candidates are all usable rows but those of the query's own vec_id and of other dimensions. Vectors that are null,
    empty, zero or hold null or non-finite components take no part. Equal vectors are one node with its ``k + 1`` smallest
    ids, which is all a result can need; ties go to the smaller vec_id. Repeated rows count once. Different vectors under
    one vec_id are candidates each, but a vec_id comes once a query, with its best score; as queries they are answered together.
    Extra columns are ignored; an empty table gives an empty result. Shards and query blocks have bounded size. A task loads
    one shard's graph and streams up to ``TASK_ROWS`` queries past it; the beam is widened until a sample of each block's
    queries, compared with its whole shard, passes.
    """
    kind = precision(vectors)
    rows = settle(usable(vectors).distinct(), "vectors")
    by_vector = Window.partitionBy("dim", "blob").orderBy("vec_id")
    nodes = (
        rows.withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1)
        .groupBy("dim", "blob").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    nodes = settle(nodes, "nodes")
    total, widest = nodes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    shards = max(1, math.ceil(total / rows_a_shard(total, widest, shard_rows)))
    head = "shard int, dim int, block int, "

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, blobs = _stack(batches, "ids", "blob")
        order = sorted(range(len(ids)), key=lambda i: (ids[i], blobs[i]))
        own = [ids[i] for i in order]
        raw = b"".join(blobs[i] for i in order)
        dim = key[1].as_py()
        graph = Graph.build(_leveled(np.frombuffer(raw, kind).reshape(-1, dim)))
        flat = np.array([x for one in own for x in one], "<i8").tobytes()
        ends = np.cumsum([len(x) for x in own]).astype("<i8").tobytes()
        yield _row({"shard": key[0].as_py(), "dim": dim, "block": -1, "ids": flat, "ends": ends, **graph.dump(), "vectors": raw}, head + _PARTS)

    shard = F.pmod(F.xxhash64("blob"), F.lit(shards)).cast("int").alias("shard")
    index = settle(nodes.select("ids", "blob", "dim", shard).repartition(shards + min(3 * shards, 200), "shard", "dim").groupBy("shard", "dim").applyInArrow(build, head + _PARTS), "index")

    asked = rows.where(is_query)
    blocks = max(1, math.ceil(asked.count() / query_rows))
    groups = math.ceil(blocks * query_rows / TASK_ROWS)
    per_group = math.ceil(blocks / groups)

    def gather(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, blobs = _stack(batches, "vec_id", "blob")
        yield _row({"block": key[0].as_py(), "dim": key[1].as_py(), "ids": np.array(ids, "<i8").tobytes(), "vectors": b"".join(blobs)}, "block int, dim int, ids binary, vectors binary")

    asked = (
        asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)).cast("int"))
        .repartition(blocks, "block", "dim").groupBy("block", "dim").applyInArrow(gather, "block int, dim int, ids binary, vectors binary")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .withColumn("group", F.expr(f"block div {per_group}").cast("int"))
    )
    indexes = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def load(row: dict) -> tuple:
        raw = np.frombuffer(row["vectors"], kind).reshape(-1, row["dim"])
        return (row["shard"], row["dim"], raw, Graph.load(row, row["dim"] + 1, _leveled(raw)), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["ends"], "<i8")), []

    def ask(state: tuple | None, row: dict) -> Iterator[pa.RecordBatch]:
        if state is None or state[:2] != (row["shard"], row["dim"]):  # no vector of this width in the shard
            return
        _, dim, raw, graph, flat, ends = state
        q, q_ids = np.frombuffer(row["vectors"], kind).reshape(-1, dim).astype(np.float64), np.frombuffer(row["ids"], "<i8")
        small = (q / np.abs(q).max(1, keepdims=True)).astype(np.float32)
        near, _ = audited_search(graph, np.concatenate([small, np.zeros((len(q), 1), np.float32)], 1), k + 1, max(ef, k + 1))
        r, c = np.nonzero(near >= 0)
        node = near[r, c]
        exact = np.einsum("kd,kd->k", q[r], raw[node].astype(np.float64))
        begin = np.where(node > 0, ends[node - 1], 0)
        size = ends[node] - begin
        shift = np.cumsum(size) - size
        ids = flat[np.repeat(begin - shift, size) + np.arange(size.sum())]
        owner, score = np.repeat(r, size), np.repeat(exact, size)
        other = ids != q_ids[owner]
        ids, owner, score = ids[other], owner[other], score[other]
        order = np.lexsort((ids, -score, owner))
        owner = owner[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        order = order[place < k]
        owner = owner[place < k]
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[owner]), pa.array(ids[order]), pa.array(score[order])], names=["query_id", "vec_id", "score"])

    found = _served(indexes.unionByName(asked, allowMissingColumns=True), ["shard", "dim", "group"], shards * groups, load, ask, "query_id long, vec_id long, score double")
    # Both steps below need rows of a query together: one exchange.
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _leveled(raw: np.ndarray) -> np.ndarray:
    """Vectors of a shard for its graph: scaled by one number, so that 32 bits hold them, and brought to one norm."""
    return level_norms((raw.astype(np.float64) / np.abs(raw).max()).astype(np.float32))


def _scaled(raw: np.ndarray) -> np.ndarray:
    """Rows in double precision, divided by a power of two so that squares neither overflow nor vanish; no digit changes."""
    v = raw.astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def _unit(raw: np.ndarray) -> np.ndarray:
    v = raw.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (root, node) with the components of the links among nodes 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    node = np.flatnonzero(root != np.arange(n))
    return root[node], node


def _beams(graph: Graph, q: np.ndarray, loose: np.float32, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs found by beams of ``ef`` nodes, or four times as many where the first hold links only; and the queries with too many links for either."""
    n, todo, heads, tails = len(graph.vectors), np.arange(len(q)), [], []
    for width in (min(ef, n), min(4 * ef, n)):
        ids, sims = graph.search(q[todo], width)
        full = (sims[:, -1] >= loose) & (width < n)
        many = (sims >= loose).sum(1) > HELD
        r, c = np.nonzero((sims >= loose) & ~(full | many)[:, None])
        heads.append(todo[r]), tails.append(ids[r, c])
        todo = todo[full | many]
    return np.concatenate(heads), np.concatenate(tails), todo


def _whole(graph: Graph, q: np.ndarray, loose: np.float32, todo: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the queries ``todo`` by comparison with every row, a bounded number at a time."""
    step = max(1, CELLS // len(graph.vectors))
    for at in range(0, len(todo), step):
        r, c = np.nonzero(q[todo[at : at + step]] @ graph.vectors.T >= loose)
        yield todo[at + r], c


def _audited(graph: Graph, q: np.ndarray, loose: np.float32, least: float, ef: int, sample: int) -> int:
    """The beam, doubled from ``ef`` until a sample of the queries finds all its links and enough of its nearest rows, links or not; 0 if only comparing all will do."""
    n = len(graph.vectors)
    q = q[np.unique(np.linspace(0, len(q) - 1, min(sample, len(q))).astype(int))]
    exact = q @ graph.vectors.T
    r, c = np.nonzero(exact >= least + 1e-5)
    k = min(8, n)
    bar = -np.partition(-exact, k - 1, axis=1)[:, k - 1]
    while ef < n:
        a, b, todo = _beams(graph, q, loose, ef)
        seen = ~np.isin(r, todo)  # the others are compared with all rows
        if np.isin(r[seen] * np.int64(n) + c[seen], a * np.int64(n) + b).all() and (graph.search(q, ef)[1][:, :k] >= bar[:, None] - 1e-5).mean() >= 0.97:
            break
        ef *= 2
        if 32 * ef > n:  # such a beam reads as many rows as there are
            return 0
    return ef


def _links(graph: Graph, q: np.ndarray, least: float, ef: int, sample: int = PROBES, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query number, row number) of unit vectors whose cosine, in 32 bits, is ``least`` or hardly less, in pieces of bounded size.

    A beam that holds links only may be too narrow: its query is searched again with one four times as wide, and if that
    is full too, or holds over ``HELD`` links, compared with the whole shard. Before that a sample of queries is compared with all rows: while
    one of its links is missing, or too few of its nearest rows are found, links or not, all beams double. With ``same`` the queries are
    the shard's own rows: a pair found from either side comes once. For that only what beams found is held, up to ``HELD`` rows a query;
    queries compared with the whole shard know all their links.
    """
    n, loose = len(graph.vectors), np.float32(least - 1e-5)
    ef = _audited(graph, q, loose, least, ef, sample)
    whole, low, high = np.zeros(len(q), bool), [], []
    for at in range(0, len(q), QUERY_ROWS):
        if not ef:
            whole[at : at + QUERY_ROWS] = True
            continue
        a, b, todo = _beams(graph, q[at : at + QUERY_ROWS], loose, ef)
        a = a + at
        whole[at + todo] = True
        if same:
            low.append(np.minimum(a, b).astype(np.int32)[a != b]), high.append(np.maximum(a, b).astype(np.int32)[a != b])
        else:
            yield a, b
    for a, b in _whole(graph, q, loose, np.flatnonzero(whole)):
        once = (a < b) | (a > b) & ~whole[b] if same else slice(None)
        yield a[once], b[once]
    if low:
        a, b = np.concatenate(low), np.concatenate(high)
        del low, high
        rest = ~(whole[a] | whole[b])
        a, b = a[rest], b[rest]
        parts = -(-len(a) // CELLS) or 1
        for part in range(parts):  # both sides of a pair are in the same part
            mine = a % parts == part
            pair = np.unique(a[mine] * np.int64(n) + b[mine])
            yield pair // n, pair % n


def _linked(
    graph: Graph, q: np.ndarray, raw: np.ndarray, q_n: np.ndarray, n: np.ndarray, least: float, ef: int, same: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of the vectors ``q`` to those of the graph, ``raw``, whose numbers of rows are ``q_n`` and ``n``: per node its links' rows, and the edges
    (root, node) of a spanning forest. Nodes are the queries, then the rows; with ``same`` both are the same.

    Memory doesn't grow with the number of links: they are compared in double precision, counted and taken into the forest piece by piece.
    """
    one = _scaled(q)
    two = one if same else _scaled(raw)
    one_norm, two_norm = (np.sqrt((x * x).sum(1)) for x in (one, two))
    nodes = len(raw) if same else len(q) + len(raw)
    count, root, node = np.zeros(nodes), np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = max(1, CELLS // (4 * max(1, q.shape[1])))
    for a, b in _links(graph, graph.vectors if same else _unit(q), least - 1e-6, ef, same=same):
        near = np.zeros(len(a), bool)
        for at in range(0, len(a), step):
            x, y = a[at : at + step], b[at : at + step]
            near[at : at + step] = (one[x] * two[y]).sum(1) / (one_norm[x] * two_norm[y]) >= least
        a, b = a[near], b[near]
        if not len(a):
            continue
        c = b if same else b + len(q)
        count += np.bincount(a, n[b], nodes)
        count += np.bincount(c, q_n[a], nodes)
        root, node = _forest(np.concatenate([root, a]), np.concatenate([node, c]), nodes)
    return count.astype(np.int64), root, node


def near_duplicates(vectors: DataFrame, least: float = COSINE, shard_rows: int = SHARD_ROWS, ef: int = 48) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept; only vectors of the same label, not null, are compared.

    Null ids, null labels and vectors that are null, empty, zero or hold null or non-finite components link with nothing and keep
    themselves. Equal vectors of a label are one node that counts for each of its rows. Rows of one vec_id are vectors of
    their own: each has its links; its component is named by the smallest vec_id in it. Extra columns are ignored; an
    empty table gives an empty result. Each shard of a label is asked with the vectors of that shard and of those before
    it: a task loads one graph and streams up to ``TASK_ROWS`` vectors past it. Links are counted where they are found, piece by
    piece, and leave the task as counts and a spanning forest, not as pairs.
    """
    kind = precision(vectors)
    every = settle(usable(vectors, ("label",), others=True), "vectors")
    rows = every.where("blob is not null and label is not null")
    nodes = rows.groupBy("label", "dim", "blob").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # fixed by being written
    sizes = settle(nodes.groupBy("label", "dim").agg(F.count("*").alias("rows")), "sizes", LIGHT)
    total, widest = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("dim"), F.lit(1))).first()
    per = rows_a_shard(total, widest, shard_rows)
    sizes = sizes.select("label", "dim", F.ceil(F.col("rows") / per).cast("int").alias("shards"))
    shards = int(sizes.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0])
    dealt = nodes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("blob"), F.col("shards")).cast("int"))
    label = nodes.schema["label"].dataType.simpleString()
    step = max(1, math.ceil(per / QUERY_ROWS))  # blocks a shard is cut into as questions
    per_group = max(1, TASK_ROWS // QUERY_ROWS)

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, blobs, n, low = _stack(batches, "node", "blob", "n", "low")
        order = sorted(range(len(ids)), key=lambda i: (low[i], blobs[i]))
        dim, raw = key[1].as_py(), b"".join(blobs[i] for i in order)
        graph = Graph.build(_unit(np.frombuffer(raw, kind).reshape(-1, dim)))
        own = {"ids": np.array(ids, "<i8")[order].tobytes(), "ends": np.array(n, "<i8")[order].tobytes()}
        one = _row({"dim": dim, "block": -1, **own, **graph.dump(), "vectors": raw}, "dim int, block int, " + _PARTS)
        keys = [pa.array([key[i].as_py()], type=key[i].type) for i in (0, 2, 3)]
        yield pa.RecordBatch.from_arrays([*keys, *one.columns], names=["label", "shard", "shards", *one.schema.names])

    schema = f"label {label}, shard int, shards int, dim int, block int, {_PARTS}"
    index = settle(dealt.repartition(shards + min(3 * shards, 200), "label", "dim", "shard", "shards").groupBy("label", "dim", "shard", "shards").applyInArrow(build, schema), "index")
    # Block b of shard f is asked of the shards after f; blocks are numbered across shards, some dozen make a task. The task
    # with a shard's last questions asks it with its own vectors too.
    width = F.floor((F.octet_length("ids") / 8 + step - 1) / step).cast("int") * 8
    asked = (
        index.select("label", "dim", "shard", "shards", "ids", "ends", "vectors", width.alias("__w"), F.explode(F.sequence(F.lit(0), F.lit(step - 1))).alias("part"))
        .where("part * __w < octet_length(ids) and shard < shards - 1")
        .select("label", "dim", (F.col("shard") * step + F.col("part")).alias("block"), *[
            F.expr(f"substring({c}, cast(1 + part * __w / 8 * {u} as int), cast(__w / 8 * {u} as int)) as {c}") for c, u in (("ids", "8"), ("ends", "8"), ("vectors", f"dim * {kind[-1]}"))
        ], "shards", F.explode(F.sequence(F.col("shard") + 1, F.col("shards") - 1)).alias("shard"))
        .withColumn("group", F.expr(f"block div {per_group}").cast("int"))
    )
    indexes = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.expr(f"cast(((shard + 1) * {step} - 1) div {per_group} as int)"))))
    tasks = max(1, int(indexes.select("group").count()))

    def load(row: dict) -> tuple:
        raw = np.frombuffer(row["vectors"], kind).reshape(-1, row["dim"])
        state = raw, Graph.load(row, row["dim"], _unit(raw)), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["ends"], "<i8")
        last = ((row["shard"] + 1) * step - 1) // per_group
        return state, links(state, raw, state[2], state[3], True) if row["group"] == last else []

    def ask(state: tuple, row: dict) -> Iterator[pa.RecordBatch]:
        q = np.frombuffer(row["vectors"], kind).reshape(-1, row["dim"])
        return links(state, q, np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["ends"], "<i8"), False)

    def links(state: tuple, q: np.ndarray, q_ids: np.ndarray, q_n: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        raw, graph, ids, n = state
        count, root, node = _linked(graph, q, raw, q_n, n, least, ef, same)
        names = ids if same else np.concatenate([q_ids, ids])
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([names[some], names[root]])), pa.array([*[None] * len(some), *names[node].tolist()], pa.int64()), pa.array([*count[some].tolist(), *[None] * len(root)], pa.int64())],
            names=["a", "b", "n"],
        )

    both = indexes.unionByName(asked, allowMissingColumns=True)
    found = settle(_served(both, ["label", "dim", "shard", "group"], tasks, load, ask, "a long, b long, n long"), "links")
    discard(index)
    counts = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("outside"))
    parts = components(found.where("b is not null and a <> b").select("a", "b")).withColumnRenamed("id", "node")
    parts = settle(nodes.select("node", "low").join(parts, "node"), "parts", LIGHT)
    parts = parts.join(parts.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("node", "component_id")
    nodes = nodes.join(counts, "node", "left").join(parts, "node", "left").select(
        "label", "dim", "blob", (F.coalesce("outside", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "low").alias("component_id")
    )
    linked = rows.join(nodes, ["label", "dim", "blob"]).select("vec_id", "n_links", "component_id")
    rest = every.where("blob is null or label is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
