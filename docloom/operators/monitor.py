"""Training step logs: ticks, carried values, kept checkpoints, regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ticks(log: DataFrame, every: int = 5, peak: str = "peak_alloc_gb", run: str | None = None, chunk: int = 10_000) -> DataFrame:
    """Every ``every``-th step (0 left out) with the last loss seen so far and the peak within its tick.

    Losses are carried within chunks of steps, and from chunk to chunk by one row each: a log without a ``run`` column is
    no single window.
    """
    keys = [run] if run else []
    log = log.withColumn("_part", F.floor(F.col("step") / chunk))
    within = Window.partitionBy(*keys, "_part").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    ends = log.groupBy(*keys, "_part").agg(F.max_by("loss", F.when(F.col("loss").isNotNull(), F.col("step"))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*keys, "_part", before.alias("_carried"))
    carried = log.withColumn("last_loss", F.last("loss", ignorenulls=True).over(within)).where((F.col("step") != 0) & (F.col("step") % every == 0))
    carried = carried.join(ends, [*keys, "_part"]).withColumn("last_loss", F.coalesce("last_loss", "_carried"))
    peaks = log.where("step > 0").groupBy(*keys, F.ceil(F.col("step") / every).alias("tick")).agg(F.max(peak).alias("tick_peak"))
    return carried.withColumn("tick", F.ceil(F.col("step") / every)).join(peaks, [*keys, "tick"]).select(*keys, "step", "last_loss", "tick_peak")


def newest(checkpoints: DataFrame, keep: int = 4, run: str | None = None) -> DataFrame:
    w = Window.partitionBy(*([run] if run else [])).orderBy(F.desc("step"))
    return checkpoints.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def regressions(metrics: DataFrame, points: float = 2.0) -> DataFrame:
    """(metric, checkpoint, value) with the change from the checkpoint before and whether it fell by more than ``points``."""
    before = F.lag("value").over(Window.partitionBy("metric").orderBy("checkpoint"))
    return metrics.withColumn("change", F.col("value") - before).withColumn("regressed", F.coalesce(F.col("change") < -points, F.lit(False)))
