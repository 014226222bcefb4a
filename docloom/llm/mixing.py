"""Mixing sources to target weights by proportionate-fair scheduling.

Each source is cut into blocks of about ``block_chars`` characters. Block j of a source with weight w is released at
slot floor(j / w) and due by slot ceil((j + 1) / w); the earliest deadline goes first. Weights are taken as the exact
fractions that they are, so any prefix, however long, holds less than one block more or less of a source than its
target weight asks for, until the source runs out. The driver places every block of the corpus, from the sources'
sizes alone: a few heap steps and 20 bytes a block.

Nothing is dropped or repeated: a source that runs out leaves its later slots empty, and the others keep their ratios.

Every source is scheduled by itself, however many there are: the driver holds a few numbers a source and a block. Blocks grow where
the corpus would have more than ``MOST_BLOCKS`` of them, beside one a source. The schedule of more than ``MOST_SOURCES`` sources is joined
without being sent to all executors; the result doesn't depend on that.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import unused

BLOCK_CHARS = 65_536
LEAST_PERIOD = 1_000
CHUNK_ROWS = 2_000
MOST_SOURCES = 50_000
MOST_BLOCKS = 1_000_000
EMPTY_SLOTS = 8


def quantise(weights: dict[str, float], period: int) -> dict[str, int]:
    """For schedules that repeat: whole slots per period, at least one each, by largest remainders; their sum is the period."""
    total = sum(weights.values())
    spare = period - len(weights)
    exact = {s: w / total * spare for s, w in weights.items()}
    slots = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(slots.values())]:
        slots[s] += 1
    return slots


def exact_shares(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the ratios of the weights."""
    if any(not 0 <= w < math.inf for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    unit = 1
    for w in weights.values():
        unit = math.lcm(unit, Fraction(w).denominator)
    return {s: int(Fraction(w) * unit) for s, w in weights.items()}


def place(shares: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[int, str, int]]:
    """(slot, source, number of its block) of every block, earliest deadline first among released blocks.

    Sources that ran out go on claiming slots, which stay empty, for up to ``EMPTY_SLOTS`` slots a block; after that
    only the blocks left are placed, each within its own release and deadline, so that the work is bounded by
    the number of blocks. Sources without a share come last.
    """
    total = sum(shares.values())
    left = sum(n for s, n in blocks.items() if shares[s])
    bound = EMPTY_SLOTS * left
    waiting = [(0, s, 0) for s in sorted(shares) if shares[s]]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    t = 0
    while left:
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            if j < blocks[s] or t < bound:
                heapq.heappush(ready, (-(-(j + 1) * total // shares[s]), s, j))
        if not ready:
            t = waiting[0][0]
            continue
        _, s, j = heapq.heappop(ready)
        if j < blocks[s]:
            yield t, s, j
            left -= 1
        heapq.heappush(waiting, ((j + 1) * total // shares[s], s, j + 1))
        t += 1
    for s in sorted(blocks):
        if not shares[s]:
            for j in range(blocks[s]):
                yield t + j, s, j
            t += blocks[s]


def schedule(slots: dict[str, int]) -> list[tuple[str, int]]:
    """One period of whole slots: (source, number of its block) for each."""
    return [(s, j) for _, s, j in place(slots, slots)]


POWER = 0.7


def default_weights(sizes: dict[str, int], power: float = POWER) -> dict[str, float]:
    """Weights between proportional (1) and equal (0) shares, so that a dominating source is damped."""
    return {s: max(1, n) ** power for s, n in sizes.items()}


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS,
    least_period: int = LEAST_PERIOD, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``docs`` with columns ``mix_source``, ``mix_block`` and ``mix_slot`` added (clashing names are replaced).

    Every row comes back once, those without a doc_id too. A null source is the source ''. Null and empty texts count one character.
    A row belongs to the block of its first character, so a text longer than a block leaves the blocks that it covers, and
    their slots, empty. Rows of equal doc_id are ordered by a hash of their text; fully equal rows are interchangeable. Sources
    without a given weight get the least weight given, those of weight 0 come last. ``least_period`` has no effect any more: the
    schedule follows the exact weights and has no period. An empty table gives an empty result.

    Running sizes are two-level sums: a source is dealt into chunks of about ``chunk_rows`` rows by a hash of doc_id and
    text, so a source with a third of all rows, or an id that many rows share, is no larger a window than any other.
    """
    base = docs.drop("mix_source", "mix_block", "mix_slot")
    size_, line, chunk, chunks_, sum_, before_ = unused(base, "__size", "__line", "__chunk", "__chunks", "__sum", "__before")
    size = F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("long")
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    spark = docs.sparkSession
    totals = base.groupBy(source.alias("s")).agg(F.count("*").alias("n"), F.sum(size).alias("chars")).toArrow()
    totals = totals.take(pc.sort_indices(totals["s"]))  # a source's place is its number; in the order of the names, which breaks ties
    sizes = dict(enumerate(totals["chars"].to_pylist()))
    if weights:
        least = min(weights.values())
        asked = {i: weights.get(s.as_py(), least) for i, s in enumerate(totals["s"])}
    else:
        asked = default_weights(sizes)
    block_chars = max(block_chars, -(-sum(sizes.values()) // MOST_BLOCKS))
    # The block of a row is that of its first character, so no source has more blocks than these.
    owners, blocks, slots = array("i"), array("q"), array("q")
    for t, x, j in place(exact_shares(asked), {x: -(-n // block_chars) for x, n in sizes.items()}):
        owners.append(x)
        blocks.append(j)
        slots.append(t)
    owner = totals["s"].take(pa.array(owners, pa.int32())).combine_chunks()
    fields = pa.schema([(line, pa.string()), ("mix_block", pa.int64()), ("mix_slot", pa.int64())])
    times = spark.createDataFrame(pa.table([owner, pa.array(blocks, pa.int64()), pa.array(slots, pa.int64())], schema=fields))
    large = totals.filter(pc.greater(totals["n"], chunk_rows))
    dealt = [(s, math.ceil(n / chunk_rows)) for s, n in zip(large["s"].to_pylist(), large["n"].to_pylist(), strict=True)]
    chunks = spark.createDataFrame(dealt or [("", 1)], f"`{line}` string, `{chunks_}` int")
    sent = F.broadcast if totals.num_rows <= MOST_SOURCES else lambda df: df

    keyed = (
        base.withColumns({"mix_source": source, line: source, size_: size})
        .join(F.broadcast(chunks), line, "left")  # one of every chunk_rows rows at most
        .withColumn(chunk, F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.coalesce(F.col(chunks_), F.lit(1))))
        .drop(chunks_)
    )
    parts = keyed.groupBy(line, chunk).agg(F.sum(size_).alias(sum_))
    before = F.sum(sum_).over(Window.partitionBy(line).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(line, chunk, F.coalesce(before, F.lit(0)).alias(before_))
    within = F.sum(size_).over(
        Window.partitionBy(line, chunk).orderBy("doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        keyed.join(parts, [line, chunk])
        .withColumn("mix_block", F.floor((F.col(before_) + F.coalesce(within, F.lit(0))) / block_chars).cast("long"))
        .join(sent(times), [line, "mix_block"])  # at most MOST_BLOCKS and one a source
        .select(*base.columns, "mix_source", "mix_block", "mix_slot")
    )
