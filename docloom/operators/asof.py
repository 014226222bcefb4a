"""As-of join by merge: both sides in one order of time, each asking row takes the last row before it.

Rows out of the shuffle are rows in: no asking row meets all earlier rows of its key. A key with more than ``chunk_rows`` rows is
cut along time at bounds taken from a hashed sample of its times; each chunk is merged on its own, and the newest row of
the chunks before is carried into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.io import shared_folder

SAMPLE = 1_000  # times of a large key that bounds are taken from, about


def time_bounds(rows: DataFrame, by: str, at: str, chunk_rows: int, most: int = 256) -> DataFrame | None:
    """``by, _bounds``: increasing times that cut each key of more than ``chunk_rows`` rows into chunks, ``most`` at most; None
    if there is no such key. The frame is written in the shared folder, so every reader sees the same bounds."""
    spark = rows.sparkSession
    folder = shared_folder(spark, "large-keys")
    rows.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") > chunk_rows).write.parquet(folder)
    large = spark.read.parquet(folder)
    if large.isEmpty():
        return None
    picked = rows.join(large, by).where(F.pmod(F.xxhash64(F.col(at).cast("string")), F.greatest(F.lit(1), F.floor(F.col("_n") / SAMPLE))) == 0)
    times = picked.groupBy(by).agg(F.sort_array(F.collect_set(at)).alias("_t"), F.max("_n").alias("_n"))
    parts = F.least(F.lit(most), F.ceil(F.col("_n") / chunk_rows).cast("int"), F.size("_t"))
    cut = F.transform(F.sequence(F.lit(1), parts), lambda i: F.element_at("_t", F.greatest(F.lit(1), F.floor(i * F.size("_t") / (parts + 1)).cast("int"))))
    folder = shared_folder(spark, "time-bounds")
    times.select(by, F.array_distinct(cut).alias("_bounds")).write.parquet(folder)
    return spark.read.parquet(folder)


def latest_before(rows: DataFrame, keys: DataFrame, by: str, when: str, as_of: str, inclusive: bool = False, chunk_rows: int = 1_000_000) -> DataFrame:
    """For each row of ``keys`` the newest row of the same ``by`` before its ``as_of`` (or at it, if ``inclusive``).

    All columns of ``keys``, then those of ``rows`` but ``by``, NULL where there is no such row. Rows of one time are told by
    their other columns: the last in their order wins. Repeated asking rows each get an answer. A NULL key or time, on either
    side, meets nothing. Rows of one key and one time are never cut apart.
    """
    other = [c for c in rows.columns if c != by]
    none = F.lit(None)
    theirs = rows.where(F.col(by).isNotNull() & F.col(when).isNotNull()).select(F.col(by).alias("_k"), F.col(when).alias("_at"), F.lit(0).alias("_asks"), F.struct(when, *[c for c in other if c != when]).alias("_row"))
    real = F.col(by).isNotNull() & F.col(as_of).isNotNull()
    ours = keys.where(real).select(F.col(by).alias("_k"), F.col(as_of).alias("_at"), F.lit(1).alias("_asks"), F.struct(*keys.columns).alias("_key"))
    both = theirs.withColumn("_key", none.cast(ours.schema["_key"].dataType)).unionByName(ours.withColumn("_row", none.cast(theirs.schema["_row"].dataType)))
    bounds = time_bounds(both.select("_k", "_at"), "_k", "_at", chunk_rows)
    if bounds is not None:  # a time that is a bound belongs to the chunk above it
        both = both.join(bounds, "_k", "left").withColumn("_chunk", F.coalesce(F.size(F.filter("_bounds", lambda b: b <= F.col("_at"))), F.lit(0))).drop("_bounds")
    else:
        both = both.withColumn("_chunk", F.lit(0))
    first = F.col("_asks").asc() if inclusive else F.col("_asks").desc()
    order = Window.partitionBy("_k", "_chunk").orderBy("_at", first, "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = both.withColumn("_last", F.last("_row", ignorenulls=True).over(order)).where("_asks = 1")
    if bounds is not None:
        ends = both.where("_asks = 0").join(bounds.select("_k"), "_k", "left_semi").groupBy("_k", "_chunk").agg(F.max("_row").alias("_end"))
        every = bounds.select("_k", F.explode(F.sequence(F.lit(0), F.size("_bounds"))).alias("_chunk")).join(ends, ["_k", "_chunk"], "left")
        before = Window.partitionBy("_k").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        carried = every.select("_k", "_chunk", F.last("_end", ignorenulls=True).over(before).alias("_carried")).where("_carried is not null")
        merged = merged.join(carried, ["_k", "_chunk"], "left").withColumn("_last", F.coalesce("_last", "_carried"))
    found = merged.select(*[F.col("_key")[c].alias(f"_key_{i}") for i, c in enumerate(keys.columns)], *[F.col("_last")[c].alias(f"_row_{i}") for i, c in enumerate(other)])
    found = found.toDF(*keys.columns, *other)
    return found.unionByName(keys.where(~real).select(*keys.columns, *[none.cast(rows.schema[c].dataType).alias(c) for c in other]))
