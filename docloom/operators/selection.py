"""Exact order statistics and samples of fixed size, of groups of any size: no task holds a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.io import shared_folder

GRID = 1_024  # shares of a group between the values that a sketch proposes


def _kept(df: DataFrame, tag: str) -> DataFrame:
    """Written in the shared folder and read back: later steps see one outcome of a sketch, whatever is run again."""
    folder = shared_folder(df.sparkSession, tag)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _same(left: str, right: str, columns: list[str]) -> Column:
    """Equal in all columns, NULL with NULL."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns), F.lit(True))


def _ranks(n: Column, p: float) -> tuple[Column, Column, Column]:
    """Ranks from 0 below and above the place of a percentile among n values, and the share of the upper one."""
    place = F.lit(float(p)) * (n - 1)
    return F.floor(place), F.ceil(place), place - F.floor(place)


def percentiles(rows: DataFrame, column: str, ps: list[float], by: list[str] | None = None, task_rows: int = 1_000_000) -> DataFrame:
    """``by, n, values``: exact percentiles with linear interpolation, a value for each of ``ps``. NULLs don't count; a group
    without values has no row; a NULL key is a group.

    Groups of up to ``task_rows`` values use the plain aggregate. A larger one is cut at values that a sketch proposes on either side of each wanted
    rank, the parts (and the cut values themselves) are counted exactly, and only the parts that hold a wanted rank go on, until they are
    small. A round reads what the one before left and shuffles counts and sketches; each leaves about three 1,024ths of a group for a rank.
    """
    by = list(by or [])
    held = rows.select(*by, F.col(column).cast("double").alias("_v")).where("_v is not null")
    sizes = _kept(held.groupBy(*by).agg(F.count("*").alias("n")).where("n > 0"), "group-sizes")
    large = sizes.where(F.col("n") > task_rows)
    plain = lambda df: df.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("_v", F.array(*[F.lit(float(p)) for p in ps])).alias("values")).where("n > 0")
    if large.isEmpty():
        return plain(held)
    groups = _kept(large.withColumn("_g", F.concat_ws("/", F.xxhash64(F.to_json(F.struct(F.lit(0), *by))), F.monotonically_increasing_id())), "large-groups")
    rest = held.alias("h").join(groups.alias("g"), _same("h", "g", by), "left_anti")
    found = _selected(held.alias("h").join(groups.alias("g"), _same("h", "g", by)).select("_g", "_v"), groups, ps, task_rows)
    known = found.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))  # two ranks for each of ps

    def value(p: float) -> Column:
        low, high, share = _ranks(F.col("n"), p)
        a, b = F.element_at("_at", low), F.element_at("_at", high)
        return a + (b - a) * share

    return plain(rest).unionByName(groups.join(known, "_g").select(*by, "n", F.array(*[value(p) for p in ps]).alias("values")))


def _selected(rows: DataFrame, groups: DataFrame, ps: list[float], task_rows: int) -> DataFrame:
    """``_g, rank, value`` for the ranks around ``ps`` in each group of ``rows(_g, _v)``."""
    ranks = F.array_distinct(F.array(*[r for p in ps for r in _ranks(F.col("n"), p)[:2]]))
    wanted = _kept(groups.select("_g", F.col("_g").alias("_part"), F.explode(ranks).alias("rank")).withColumn("_local", F.col("rank")), "ranks")
    rows, out = rows.withColumnRenamed("_g", "_part"), []
    while True:
        parts = _kept(rows.groupBy("_part").agg(F.count("*").alias("n"), F.percentile_approx("_v", [k / GRID for k in range(GRID + 1)], 10_000).alias("_grid")), "parts")
        place = F.row_number().over(Window.partitionBy("_part").orderBy("_v")) - 1
        ranked = rows.join(parts.where(F.col("n") <= task_rows).select("_part"), "_part", "left_semi").select("_part", "_v", place.cast("long").alias("_local"))
        out.append(_kept(wanted.join(ranked, ["_part", "_local"]).select("_g", "rank", F.col("_v").alias("value")), "ranked"))
        big = parts.where(F.col("n") > task_rows)
        if big.isEmpty():
            return reduce(DataFrame.unionByName, out)
        # Values on either side of each wanted rank, few enough for code that is compiled. Cells in order of value: 2i between the i-th and the next cut, 2i - 1 at the i-th
        step = F.floor(GRID * F.col("_local") / F.col("n")).cast("int")
        sides = F.array(F.col("_grid")[F.greatest(step - 1, F.lit(0))], F.col("_grid")[F.least(step + 2, F.lit(GRID))])
        cuts = wanted.join(big, "_part").groupBy("_part").agg(F.sort_array(F.flatten(F.collect_list(sides))).alias("_cuts"))
        cut = [f"_cut{k}" for k in range(4 * len(ps))]  # two for each of two ranks; where there are fewer, the last again
        cuts = _kept(cuts.select("_part", *[F.col("_cuts")[F.least(F.lit(k), F.size("_cuts") - 1)].alias(c) for k, c in enumerate(cut)]), "cuts")
        passed = reduce(lambda a, b: a + b, ((F.col(c) <= F.col("_v")).cast("int") for c in cut))
        at = reduce(lambda a, b: a | b, (F.col(c) == F.col("_v") for c in cut))
        cells = rows.join(cuts, "_part").select("_part", "_v", (2 * passed - at.cast("int")).alias("_cell"))
        below = F.sum("_n").over(Window.partitionBy("_part").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
        counted = cells.groupBy("_part", "_cell").agg(F.count("*").alias("_n"), F.min("_v").alias("_low")).withColumn("_below", F.coalesce(below, F.lit(0)))
        hit = wanted.join(counted, "_part").where((F.col("_local") >= F.col("_below")) & (F.col("_local") < F.col("_below") + F.col("_n")))
        hit = _kept(hit, "cells")
        out.append(hit.where("_cell % 2 = 1").select("_g", "rank", F.col("_low").alias("value")))
        inner = F.concat_ws("/", "_part", "_cell").alias("_inner")
        left = hit.where("_cell % 2 = 0").select("_part", "_cell", inner).distinct()
        wanted = hit.where("_cell % 2 = 0").select("_g", inner.alias("_part"), "rank", (F.col("_local") - F.col("_below")).alias("_local"))
        # Written, so that a later round reads what is left of the groups and not the whole column again through all rounds before.
        rows = _kept(cells.join(left, ["_part", "_cell"]).select(F.col("_inner").alias("_part"), "_v"), "rows")


def draw(key: Column, seed: int) -> Column:
    """A fixed place of a row in the order of a seed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def held_out(rows: DataFrame, key: str, strata: list[str], total: int = 50, seed: int = 42) -> DataFrame:
    """Exactly ``total`` rows (all, if there are fewer), spread over the strata in proportion, by largest remainders.

    A stratum's quota is the whole part of its share, and one more for the largest fractions, ties by the strata's order; a
    quota never passes a stratum's rows. Within a stratum the rows with the smallest draws are taken, so the choice is the same
    for any partitioning. Draws far above a quota's expected bound never leave their task, unless a bound turns out too low.
    Keys are unique; a NULL stratum is one of its own.
    """
    counts = rows.groupBy(*strata).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy()  # a row a stratum
    share = F.col("_n") * F.least(F.lit(total), F.sum("_n").over(whole)) / F.sum("_n").over(whole)
    exact = counts.withColumn("_base", F.floor(share)).withColumn("_rest", F.round(share - F.col("_base"), 9))
    left = F.least(F.lit(total), F.sum("_n").over(whole)) - F.sum("_base").over(whole)
    extra = F.row_number().over(whole.orderBy(F.desc("_rest"), *strata)) <= left
    quota = exact.withColumn("_quota", F.col("_base") + extra.cast("long")).where("_quota > 0")
    bound = F.least(F.lit(float(2**32)), (4 * F.col("_quota") + 50) / F.col("_n") * float(2**32))
    quota = _kept(quota.select(*strata, "_quota", F.lower(F.lpad(F.hex(F.floor(bound).cast("long")), 9, "0")).alias("_bound")), "quotas")
    drawn = rows.withColumn("_draw", draw(F.col(key), seed)).alias("r").join(F.broadcast(quota).alias("q") if quota.count() <= 10_000 else quota.alias("q"), _same("r", "q", strata)).select("r.*", "q._quota", "q._bound")
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("_draw", key))
    first = lambda df: df.withColumn("_rank", rank).where("_rank <= _quota").select(*rows.columns)
    near = drawn.where(F.concat(F.lit("0"), F.substring("_draw", 1, 8)) <= F.col("_bound"))
    short = _kept(quota.alias("q").join(near.groupBy(*strata).agg(F.count("*").alias("_near")).alias("c"), _same("q", "c", strata), "left").where(F.coalesce(F.col("_near"), F.lit(0)) < F.col("_quota")).select("q.*"), "short")
    if short.isEmpty():
        return first(near)
    return first(near.alias("n").join(short.alias("s"), _same("n", "s", strata), "left_anti")).unionByName(first(drawn.alias("d").join(short.alias("s"), _same("d", "s", strata), "left_semi")))
