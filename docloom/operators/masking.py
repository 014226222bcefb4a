"""Completion masks over token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORE = -100


def cutoff(ids: Column, start: int, role: list[int], newline: int | None = None) -> Column:
    """Where the last turn of a role begins: behind the start token, the role's tokens and one newline token; NULL if there is none.

    At least one token must follow the role's.
    """
    r = len(role)
    last = F.size(ids) - r - 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    is_head = lambda p: (F.element_at(ids, p) == start) & (F.slice(ids, p + 1, r) == F.array(*[F.lit(x) for x in role]))
    at = F.array_max(F.filter(places, is_head)) + r
    if newline is None:
        return at
    return at + F.when((at < F.size(ids)) & (F.try_element_at(ids, at + 1) == newline), 1).otherwise(0)


def masked(labels: Column, cut: Column) -> Column:
    """Labels with everything before the cutoff ignored; without a cutoff everything."""
    return F.transform(labels, lambda x, i: F.when(cut.isNull() | (i < cut), IGNORE).otherwise(x))


def n_masked(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x == IGNORE))


def status(labels: Column, least: int = 100) -> Column:
    """fail_all_masked, fail_none_masked, warn_short (fewer than ``least`` kept) or pass."""
    kept = F.size(labels) - n_masked(labels)
    return F.when(kept == 0, "fail_all_masked").when(n_masked(labels) == 0, "fail_none_masked").when(kept < least, "warn_short").otherwise("pass")


def boundary(ids: Column, labels: Column, around: int = 5) -> Column:
    """Tokens around the first one kept."""
    first = F.array_position(F.transform(labels, lambda x: x != IGNORE), True).cast("int")
    return F.when(first > 0, F.slice(ids, F.greatest(first - around, F.lit(1)), F.least(first - 1, F.lit(around)) + around))


def tail(ids: Column, labels: Column, around: int = 5) -> Column:
    """The last token kept and those before it."""
    keeps = F.filter(F.transform(labels, lambda x, i: F.when(x != IGNORE, i + 1)), lambda x: x.isNotNull())
    last = F.array_max(keeps)
    return F.when(last.isNotNull(), F.slice(ids, F.greatest(last - around, F.lit(1)), F.least(last, F.lit(around + 1))))


def truncated(ids: Column, most: int = 8192) -> Column:
    return F.slice(ids, 1, most)


def batches(rows: DataFrame, order: str, size: int = 16, run: str | None = None, chunk: int = 4096) -> DataFrame:
    """Rows with ``batch``: the first ``size`` in the order of a unique whole number are batch 0, and so on.

    Places are counted within chunks of that number and chunks are summed up, so no window holds more than a chunk's rows
    or one row a chunk.
    """
    keys = [run] if run else []
    part = F.floor(F.col(order) / chunk).alias("_part")
    sizes = rows.groupBy(*keys, part).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*keys, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order)) - 1
    return rows.withColumn("_part", part).withColumn("_place", place).join(sizes, [*keys, "_part"]).withColumn("batch", F.floor((F.col("_before") + F.col("_place")) / size)).drop("_part", "_place", "_before")


def text_tail(text: Column, most: int = 90) -> Column:
    """The end of a text and its length in characters, for a look at where generation stopped."""
    return F.struct(F.right(text, F.lit(most)).alias("tail"), F.length(text).alias("chars"))
