"""Conversation prefix trie: level-order tries (LOUDS) built with numpy, a prefix shard at a time, heavy prefixes merged apart.

A conversation becomes the list of its prefix keys: key d is a 128-bit hash of key d - 1 and of turn d, so equal keys are
equal beginnings. Equal conversations become one row with a count and the digest of their ids. A prefix with more than
``shard_convs`` different conversations is heavy; the shallowest prefix of a conversation that is not is its shard. Tasks build
the tries of their shards together, under one virtual root, as a bit string and label arrays, and roll counts up from the
last level to the first. The heavy prefixes form the top of the trie: they get the sums of the shards right below them, and
what each of them holds is summed over its heavy ancestors. So no prefix, however common, is gathered in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import LIGHT, WIDE, settle

GROUP, MOST_SHARED = 20, 4  # conversations that share a beginning, and the modulus of its length
KEY = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = (
    "key binary, parent_key binary, conv_id long, parent_conv_id long, depth long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)


# ---- rebuilding ----


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, digests, words``: the turns of every rebuilt conversation, as digests of role and text and numbers of words.

    Conversation c gets the first h turns of c - c % 20 (all if fewer, none if there is no such conversation), then its own
    turns after its first h; h = crc32(c) % 4. Turns are ordered by turn, null first; turns of equal number by role, then by
    the first 64 characters of the text, then by its MD5; equal rows count each. A null role or text is empty. Rows without a
    conv_id belong to no conversation. Texts aren't shuffled. The turns of one conversation are one row.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"), role.alias("role"), F.substring(text, 1, 64).alias("head"), F.md5(text.cast("binary")).alias("digest"),
        F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).alias("words"),
    )
    conv = F.col("conv_id").cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull()).select((conv - conv % GROUP).alias("base"), conv.alias("conv_id"), turn.alias("t"))
    own = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    heads = own.where(F.col("conv_id") == F.col("base")).select("base", F.slice("turns", 1, MOST_SHARED - 1).alias("head"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("int")
    whole = F.concat(
        F.when(F.col("head").isNull(), F.slice("turns", F.lit(1), F.lit(0))).otherwise(F.slice("head", F.lit(1), shared)), F.slice("turns", shared + 1, F.size("turns"))
    )
    found = own.join(heads, "base", "left").select("conv_id", whole.alias("turns"))
    digest = lambda t: F.unhex(F.md5(F.concat_ws(":", F.length(t["role"]).cast("string"), t["role"], t["digest"]).cast("binary")))
    return found.select("conv_id", F.transform("turns", digest).alias("digests"), F.transform("turns", lambda t: t["words"]).alias("words"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix keys in one string, and the last of them (of no turns: the empty key)."""
    for batch in batches:
        paths = []
        for digests in batch.column("digests").to_pylist():
            key, out = b"", []
            for d in digests:
                key = hashlib.blake2b(key + d, digest_size=KEY).digest()
                out.append(key)
            paths.append(b"".join(out))
        ends = pa.array([p[-KEY:] for p in paths], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), ends, pa.array(paths, pa.binary()), batch.column("words")], names=["conv_id", "end", "path", "words"])


def _id_runs(batches: Iterator[pa.RecordBatch], most: int = 512) -> Iterator[pa.RecordBatch]:
    """Runs of sorted ids of one end, as text: few rows for an end with many ids."""
    names, held, first, key = ["end", "first", "ids"], [], None, None
    for batch in batches:
        out: list[tuple] = []
        for end, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if end != key or len(held) >= most:
                if held:
                    out.append((key, first, ",".join(map(str, held))))
                key, first, held = end, i, []
            held.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(map(str, held))])], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined runs of each end, read one after the other."""
    key, state = None, None
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["end", "ends_sha256"])
    for batch in batches:
        out = []
        for end, ids in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if state is None or end != key:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = end, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield make(out)
    if state is not None:
        yield make([(key, state.hexdigest())])


def distinct_paths(seqs: DataFrame) -> DataFrame:
    """``end, low, n, path, words, ends_sha256``: each different conversation once, its smallest id, its copies, the digest of their ids."""
    runs = seqs.select("end", "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id").mapInArrow(_id_runs, "end binary, first long, ids string")
    ends = runs.repartition("end").sortWithinPartitions("end", "first").mapInArrow(_digests, "end binary, ends_sha256 string")
    one = seqs.groupBy("end").agg(F.min("conv_id").alias("low"), F.count("*").alias("n"), F.first("path").alias("path"), F.first("words").alias("words"))
    return one.join(ends, "end")


# ---- tries of shards ----


class Louds:
    """A forest as level-order bits: for each node in order of levels a 1 per child, then a 0; node 0 is a virtual root.

    Sequences are given by their keys (two words each), where they start among the keys, and their lengths. ``at`` is the node
    at which a sequence ends, ``label`` the place of each node's key, ``levels`` the first node of each level.
    """

    def __init__(self, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.at = np.zeros(len(starts), np.int64)
        self.levels, bits, labels = [0, 1], [], [np.zeros(1, np.int64)]
        alive, depth = np.arange(len(starts)), 0
        while len(alive := alive[lengths[alive] > depth]):
            place = starts[alive] + depth
            order = np.lexsort((keys[place, 1], keys[place, 0], self.at[alive]))
            alive, place = alive[order], place[order]
            above, own = self.at[alive], keys[place]
            new = np.ones(len(alive), bool)
            new[1:] = (above[1:] != above[:-1]) | (own[1:] != own[:-1]).any(axis=1)
            bits.append(self._level(above[new]))
            labels.append(place[new])
            self.at[alive] = self.levels[-1] + np.cumsum(new) - 1
            self.levels.append(self.levels[-1] + int(new.sum()))
            depth += 1
        bits.append(np.zeros(self.levels[-1] - self.levels[-2], bool))
        self.bits, self.label = np.concatenate(bits), np.concatenate(labels)

    def _level(self, above: np.ndarray) -> np.ndarray:
        """Bits of the last level, given the parent of each node of the next one in order."""
        degree = np.bincount(above - self.levels[-2], minlength=self.levels[-1] - self.levels[-2])
        out = np.ones(int(degree.sum()) + len(degree), bool)
        out[np.cumsum(degree) + np.arange(len(degree))] = False
        return out

    def parents(self) -> np.ndarray:
        """Parent of each node: the number of 0s before its 1. Of the root: -1."""
        ones = np.flatnonzero(self.bits)
        return np.concatenate([[-1], ones - np.arange(len(ones))])

    def degrees(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits), prepend=-1) - 1

    def rolled_up(self, values: np.ndarray, ufunc: np.ufunc = np.add) -> np.ndarray:
        """``values`` of every node combined over its subtree, from the last level up."""
        out, parent = values.copy(), self.parents()
        for a, b in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
            ufunc.at(out, parent[a:b], out[a:b])
        return out


def _nodes(batch: pa.Table) -> pa.RecordBatch:
    """The nodes of the shards of a batch of conversations (``parent_key, cut, low, n, path, words, ends_sha256``)."""
    paths = batch.column("path").to_pylist()
    lengths = np.array([len(p) // KEY for p in paths], np.int64)
    keys = np.frombuffer(b"".join(paths), ">u8").reshape(-1, 2)
    words = np.array(batch.column("words").combine_chunks().flatten(), np.int64)
    starts = np.cumsum(lengths) - lengths
    trie = Louds(keys.astype(np.uint64), starts, lengths)
    size, parent, degree = trie.levels[-1], trie.parents(), trie.degrees()

    count, low = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    count[trie.at] = np.array(batch.column("n"))
    low[trie.at] = np.array(batch.column("low"))
    count, low = trie.rolled_up(count), trie.rolled_up(low, np.minimum)
    leaves = trie.rolled_up((degree == 0).astype(np.int64))
    saved = trie.rolled_up((count - 1) * words[trie.label])

    roots = trie.levels[2]  # the nodes before are shards
    first = np.zeros(size, np.int64)  # a conversation of each shard
    first[_top(trie, parent)[trie.at]] = np.arange(len(paths))
    depth = np.zeros(size, np.int64)
    depth[1:roots] = np.array(batch.column("cut"))[first[1:roots]]
    for a, b in zip(trie.levels[2:-1], trie.levels[3:], strict=True):
        depth[a:b] = depth[parent[a:b]] + 1
    ends = np.full(size, -1)
    ends[trie.at] = np.arange(len(paths))
    sha = batch.column("ends_sha256").to_pylist()
    above = batch.column("parent_key").to_pylist()
    raw = keys[trie.label[1:]].tobytes()
    inner = np.arange(1, size) >= roots
    return pa.RecordBatch.from_arrays(
        [
            pa.array([raw[i : i + KEY] for i in range(0, len(raw), KEY)], pa.binary()), pa.array([above[first[k]] if k < roots else None for k in range(1, size)], pa.binary()),
            pa.array(low[1:]), pa.array(low[np.maximum(parent[1:], 0)], mask=~inner), pa.array(depth[1:]), pa.array(count[1:]), pa.array(degree[1:]), pa.array(leaves[1:]),
            pa.array(saved[1:]), pa.array([sha[k] if k >= 0 else NO_ENDS for k in ends[1:]], pa.string()),
        ],
        names=[f.split()[0] for f in NODE.split(", ")],
    )


def _top(trie: Louds, parent: np.ndarray) -> np.ndarray:
    """The shard, a node of the first level, that each node lies under."""
    out = np.arange(trie.levels[-1])
    for a, b in zip(trie.levels[2:-1], trie.levels[3:], strict=True):
        out[a:b] = out[parent[a:b]]
    return out


def _shards(shard_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if turns >= shard_turns:
                last, shard = held[-1].column("shard")[-1].as_py(), batch.column("shard").to_pylist()
                k = next((i for i, s in enumerate(shard) if s != last), len(shard))
                if k:
                    held.append(batch.slice(0, k))
                if k < len(shard):
                    yield _nodes(pa.Table.from_batches(held))
                    held, turns, batch = [], 0, batch.slice(k)
                else:
                    continue
            held.append(batch)
            turns += len(batch.column("words").flatten())
        if held:
            yield _nodes(pa.Table.from_batches(held))

    return run


# ---- heavy prefixes ----


def _key_at(depth: Column) -> Column:
    return F.substring("path", (depth - 1) * KEY + 1, F.lit(KEY))


def heavy_prefixes(paths: DataFrame, shard_convs: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Prefixes of more than ``shard_convs`` different conversations (``key, depth, rep``: the end of one of them), and how many
    of its prefixes are heavy for each conversation that has some (``end, heavy``). Depths are looked at in stretches that double."""
    tops, counts, alive, lo = [], [], paths.select("end", "path"), 1
    while True:
        hi = 2 * lo  # this round: depths lo to hi - 1
        depths = F.when(F.length("path") >= lo * KEY, F.sequence(F.lit(lo), F.least(F.lit(hi - 1), (F.length("path") / KEY).cast("int")))).otherwise(F.array().cast("array<int>"))
        steps = alive.select("end", "path", F.explode(depths).alias("depth")).select("end", "depth", _key_at(F.col("depth")).alias("key"))
        found = steps.groupBy("key").agg(F.first("depth").alias("depth"), F.count("*").alias("n"), F.min("end").alias("rep")).where(F.col("n") > shard_convs).drop("n")
        top = settle(found, "trie-heavy", LIGHT)
        if top.isEmpty():
            break
        tops.append(top)
        passed = settle(steps.join(top.select("key"), "key").groupBy("end").agg(F.count("*").alias("heavy")), "trie-depth", LIGHT)
        counts.append(passed)
        alive = alive.join(passed.where(F.col("heavy") == hi - lo).select("end"), "end", "left_semi")
        lo = hi
    if not tops:
        return None, None
    union = lambda frames: frames[0] if len(frames) == 1 else union(frames[: len(frames) // 2]).union(union(frames[len(frames) // 2 :]))
    return union(tops), union(counts).groupBy("end").agg(F.sum("heavy").cast("int").alias("heavy"))


def build(conversations: DataFrame, shard_convs: int = 200, shard_turns: int = 200_000) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.

    An empty table, or one without any conv_id, gives an empty result; conversations left without turns are members of the root.
    Columns other than conv_id, turn, role and text are ignored. See ``rebuilt`` for nulls, ties and repeated rows. A task holds
    the turns of one conversation, of ``shard_turns`` turns and a shard; shards hold at most ``shard_convs`` conversations.
    """
    seqs = settle(rebuilt(conversations).mapInArrow(_chained, "conv_id long, end binary, path binary, words array<int>"), "trie-paths", WIDE)
    paths = settle(distinct_paths(seqs), "trie-distinct", WIDE)
    tops, depths = heavy_prefixes(paths, shard_convs)
    cut = paths.withColumn("heavy", F.lit(0)) if depths is None else paths.join(depths, "end", "left").na.fill(0, ["heavy"])
    cut = cut.withColumn("cut", F.col("heavy") + 1)
    inside = F.length("path") >= F.col("cut") * KEY
    shard = (
        cut.where(inside)
        .select(
            _key_at(F.col("cut")).alias("shard"), F.when(F.col("cut") > 1, _key_at(F.col("cut") - 1)).otherwise(F.lit(b"")).alias("parent_key"), "cut", "low", "n",
            F.substring("path", (F.col("cut") - 1) * KEY + 1, F.length("path")).alias("path"), F.slice("words", F.col("cut"), F.size("words")).alias("words"), "ends_sha256",
        )
        .repartition("shard").sortWithinPartitions("shard")
    )
    low = settle(shard.mapInArrow(_shards(shard_turns), NODE), "trie-nodes", WIDE)

    # the root, wherever there is a conversation, and the heavy prefixes: key, keys from the root to the node, words of the last turn
    top = paths.agg(F.count("*").alias("c")).where("c > 0").select(F.lit(b"").alias("key"), F.array(F.lit(b"")).alias("line"), F.lit(0).alias("words"))
    if tops is not None:
        reps = tops.join(paths.select(F.col("end").alias("rep"), "path", "words"), "rep")
        line = F.concat(F.array(F.lit(b"")), F.transform(F.sequence(F.lit(1), F.col("depth")), lambda d: F.substring("path", (d - 1) * KEY + 1, F.lit(KEY))))
        top = top.union(reps.select("key", line.alias("line"), F.element_at("words", F.col("depth"))))
    parent = F.try_element_at("line", F.lit(-2))
    none = {"low": "long", "n": "long", "kids": "long", "leaves": "long", "saved": "long", "sha": "string"}
    part = lambda df, key, **have: df.select(F.col(key).alias("key"), *[have.get(c, F.lit(None)).cast(t).alias(c) for c, t in none.items()])
    below = low.where(F.col("parent_key").isNotNull()).groupBy("parent_key").agg(
        F.min("conv_id").alias("low"), F.sum("n_convs").alias("n"), F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    parts = part(below, "parent_key", **{c: F.col(c) for c in ("low", "n", "kids", "leaves", "saved")})
    parts = parts.union(part(cut.where(~inside), "end", low=F.col("low"), n=F.col("n"), sha=F.col("ends_sha256")))
    parts = parts.union(part(top.where(F.size("line") > 1).select(parent.alias("key")).groupBy("key").count(), "key", kids=F.col("count")))
    own = parts.groupBy("key").agg(F.min("low").alias("low"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "kids", "leaves", "saved")], F.max("sha").alias("sha"))
    held = settle(top.join(own, "key"), "trie-top", LIGHT)
    sums = held.select(F.explode("line").alias("key"), "n", "low").groupBy("key").agg(F.sum("n").alias("n"), F.min("low").alias("low"))
    held = settle(held.drop("n", "low").join(sums, "key"), "trie-sums", LIGHT)
    rest = held.select(
        F.explode("line").alias("key"), (F.col("leaves") + (F.col("kids") == 0).cast("long")).alias("leaves"), (F.col("saved") + (F.col("n") - 1) * F.col("words")).alias("saved")
    ).groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    top = held.join(rest, "key").select(
        "key", parent.alias("parent_key"), F.col("low").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), (F.size("line") - 1).cast("long").alias("depth"), F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    top = settle(top, "trie-upper", LIGHT)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    heads = low.where(F.col("parent_key").isNotNull()).unionByName(top)
    of = top.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    heads = heads.join(of, "parent_key", "left").drop("parent_conv_id").withColumnRenamed("above", "parent_conv_id")
    return low.where(F.col("parent_key").isNull()).select(*names).unionByName(heads.select(*names))
