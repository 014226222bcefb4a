"""Shared plumbing: table access, lineage cuts in the shared folder, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset, in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="docloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


# Tasks a core, or a ``CORE_BYTES`` of files read, that write a frame: whole texts or all rows; work in Python on some of the rows; a few
# numbers for some of the rows.
WIDE, BUSY, LIGHT = 8, 4, 1
CORE_BYTES = 1 << 30


def read_bytes(df: DataFrame) -> int:
    """Size of the files that ``df`` is made from, once for each time it reads them; other sources count as nothing."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 62)


def gathered(df: DataFrame, a_core: int) -> DataFrame:
    """``df`` in at most so many partitions a core, each taking several of the old ones one after the other, without a shuffle.

    Joins whose skewed parts were split, and frames of few rows, else end in very many small files. Cores are a minimum: each gigabyte of
    files read counts as a core, so partitions grow with the input, however few executors a cluster begins with.
    """
    cores = max(df.sparkSession.sparkContext.defaultParallelism, -(-read_bytes(df) // CORE_BYTES))
    return df.coalesce(a_core * cores)


def settle(df: DataFrame, tag: str, a_core: int = WIDE) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df = gathered(df, a_core)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front as far as needed to differ from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of settled frames that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/part-" in name or shared_dir(spark).split(":")[-1].lstrip("/") not in name:
                continue
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(id, component)``, component = smallest id reachable.

    Alternates large-star and small-star steps. Each step takes a partial-aggregated minimum for every node
    and joins it back, so a node with very many links is a skewed join that adaptive execution splits, never
    a collected list. Every round is settled in the shared folder. Nodes without an edge are not returned.
    """
    star = settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc", LIGHT
    )
    state = None
    while True:  # a round that changes nothing ends it; rounds grow with the logarithm of the longest path
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        new = settle(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct(),
            "cc", LIGHT,
        )
        now = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        discard(star)
        star = new
        if now == state:
            break
        state = now
    roots = star.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return star.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots).distinct()
