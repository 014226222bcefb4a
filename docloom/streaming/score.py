"""Incremental scoring: parse, validate and score documents as their files arrive. All steps are stateless and narrow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.metrics import score


def arriving(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """(id, raw) of whole files as they come."""
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    return files.select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("id"), F.col("value").alias("raw"))


def score_stream(docs: DataFrame, out: str, checkpoint: str):
    """Start a query that appends score rows as Parquet; exactly once by file and batch."""
    flat = score(docs).withColumn("schema_errors", F.array_join("schema_errors", "; ")).drop("raw")
    return flat.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def step_ticks(log: DataFrame, every: int = 5, time: str | None = None, late: str = "10 minutes", gap: str = "1 hour", run: str | None = None) -> DataFrame:
    """Tumbling count windows over a stream of step logs: the peak of each tick.

    With the column of event ``time`` a tick is a session of its rows that ends after ``gap`` without any; its state goes
    once the watermark, ``late`` behind, has passed. Without one all ticks stay open, as for a log that ends.
    """
    keys = [run] if run else []
    tick = F.ceil(F.col("step") / every).alias("tick")
    log = log.where("step > 0")
    if time is None:
        return log.groupBy(*keys, tick).agg(F.max("peak_alloc_gb").alias("tick_peak"))
    found = log.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), *keys, tick).agg(F.max("peak_alloc_gb").alias("tick_peak"))
    return found.drop("session")
