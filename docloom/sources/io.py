"""Scans and sinks of documents, id lists, records, predictions and logs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.jsonx import first_object, strip
from docloom.sources import named_files, whole_files

RECORD = "id string, messages array<struct<role: string, content: string>>"


def setting(spark: SparkSession, key: str, env: str | None = None, default: str | None = None) -> str | None:
    """A setting from the session, else from the driver's environment, else ``default``."""
    found = spark.conf.get(key, None)
    return found if found is not None else os.environ.get(env or "", default)


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder name that executors reach: under ``spark.checkpoint.dir``; a temporary one in local mode only."""
    base = setting(spark, "spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *by: str, task_bytes: int = 4 << 20) -> DataFrame:
    """``df`` dealt by ``by`` for work that bytes don't show: a task for every ``task_bytes`` of the files read, and no fewer than the
    session's shuffle partitions."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    read = sum(n for n in sizes if n < 1 << 62)
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-read // task_bytes)), *by)


def upstream(spark: SparkSession, source: dict) -> DataFrame:
    """Rows of a system outside: ``format`` (jdbc, json, csv, parquet, table, ...), ``options``, ``path``, and ``columns`` that map
    its column names to ours; ``where`` is a condition on its own names, which goes to the source where the source can take it."""
    reader = spark.read.format(source["format"]).options(**source.get("options", {})) if source["format"] != "table" else None
    found = spark.table(source["path"]) if reader is None else reader.load(source["path"]) if "path" in source else reader.load()
    if "where" in source:
        found = found.where(source["where"])
    columns = source.get("columns")
    return found.select(*[F.col(theirs).alias(ours) for theirs, ours in columns.items()]) if columns else found


def _in_folder(spark: SparkSession, glob: str, content: bool = True) -> DataFrame | None:
    found = whole_files.reached(glob)
    return whole_files.register(spark).read.format("whole_files").options(pattern=found[1], content=content).load(found[0]) if found else None


def documents(spark: SparkSession, glob: str) -> DataFrame:
    """(id, path, raw): one row per file, id is the file's name without .json. The order is that of ``path`` where it is asked for.

    Files of one folder of the local or a mounted file system are read by ``whole_files``, other paths and globs over folders by Spark's own
    reader, which leaves empty files out.
    """
    if (files := _in_folder(spark, glob)) is not None:
        return files.select(F.regexp_replace("name", r"\.json$", "").alias("id"), "path", F.col("content").cast("string").alias("raw"))
    return spark.read.text(glob, wholetext=True).select(
        F.regexp_replace(F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))), r"\.json$", "").alias("id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")
    )


def documents_by_id(spark: SparkSession, folder: str, ids: DataFrame) -> DataFrame:
    """Documents of listed ids; ids without a file have a NULL raw. Repeats of an id stay."""
    return ids.join(documents(spark, f"{folder}/*.json"), "id", "left")


def id_list(spark: SparkSession, path: str, distinct: bool = False) -> DataFrame:
    """Ids of a text file, without blank lines and # comments. As a set with ``distinct``, else with repeats."""
    found = spark.read.text(path).select(strip(F.col("value")).alias("id")).where(~F.col("id").rlike(r"^(#|$)"))
    return found.distinct() if distinct else found


def _in_order(rows: DataFrame) -> DataFrame:
    """With ``_at``: file, place of the block in it, place in the block. The rows of a block are read in order, whichever task reads it."""
    return rows.withColumn("_at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("place")))


def records(spark: SparkSession, path: str, first: int | None = None, limit: int | None = None) -> DataFrame:
    """JSONL records with an id; those without are left out (count them with ``without_id``, or in the same pass with ``records_counted``).

    ``first`` takes the first n lines, by the order of the files' paths, and names those without an id by their line, counted
    from 0 over all files; ``limit`` counts after records without an id are skipped.
    """
    rows = spark.read.schema(RECORD).json(path)
    if first is not None:
        rows = _in_order(rows).orderBy("_at").limit(first).withColumn("_line", F.row_number().over(Window.orderBy("_at")) - 1)
        return rows.select(F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("line"), F.col("_line").cast("string"))).alias("id"), "messages")
    if limit is not None:
        return _in_order(rows).where("id <> ''").orderBy("_at").limit(limit).drop("_at")
    return rows.where("id <> ''")


def records_counted(spark: SparkSession, path: str) -> tuple[DataFrame, Observation]:
    """Records with an id, and what the scan counts while it is read: ``lines`` and ``skipped`` (those without an id).

    The counts are there after the first action on the records (``observation.get``), from the same pass.
    """
    seen = Observation()
    missing = F.col("id").isNull() | (F.col("id") == "")
    rows = spark.read.schema(RECORD).json(path).observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if(missing).alias("skipped"))
    return rows.where("id <> ''"), seen


def first_record(spark: SparkSession, path: str) -> DataFrame:
    """The record of a file's first line, as one row."""
    return records(spark, path, first=1)


def dataset(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Records of several files (train, eval, ...) with their ``split``."""
    out = None
    for split, path in files.items():
        one = spark.read.schema(RECORD).json(path).withColumn("split", F.lit(split))
        out = one if out is None else out.unionByName(one)
    return out


def without_id(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path).where("id is null or id = ''")


def resource(spark: SparkSession, path: str) -> str:
    """A small text (prompt, contract) as a string; an absent one raises."""
    return spark.read.text(path, wholetext=True).first()[0]


def file_names(spark: SparkSession, *globs: str) -> DataFrame:
    """(name) of the files of several listings."""
    out = None
    for g in globs:
        files = _in_folder(spark, g, content=False)
        one = spark.read.format("binaryFile").load(g).select(F.element_at(F.split("path", "/"), -1).alias("name")) if files is None else files.select("name")
        out = one if out is None else out.unionByName(one)
    return out


def write_records(records_with_split: DataFrame, path: str) -> None:
    """JSONL, one folder a split."""
    records_with_split.select("split", "id", "messages").write.mode("overwrite").partitionBy("split").json(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """(id, raw): raw texts always, objects only where one parses; whatever was there before goes."""
    found = predictions.withColumn("v", first_object(F.col("raw")))
    predictions.select("id", "raw").write.mode("overwrite").parquet(f"{path}/raw")
    found.where("v is not null").select("id", F.to_json("v").alias("json")).write.mode("overwrite").parquet(f"{path}/json")


def quarantine(rejected: DataFrame, path: str, stamp: int) -> None:
    """Failures with parameters, errors and last text under names that are unique by stamp and row."""
    name = F.format_string(f"FAILED-batch{stamp}-row%02d", F.col("row"))
    rejected.withColumn("name", name).write.mode("append").json(path)


def write_sanity(texts: DataFrame, folder: str) -> None:
    """Raw generated texts (step, id, text) under a checkpoint's folder, one folder a step, ids in front of the texts."""
    texts.select("step", F.concat(F.lit("=== "), F.col("id"), F.lit("\n"), F.col("text"), F.lit("\n")).alias("value")).write.mode("append").partitionBy("step").text(f"{folder}/sanity")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def export_documents(docs: DataFrame, folder: str) -> DataFrame:
    """One file {id}.json a document, indented and with its keys in order; returns (id, bytes) of the files there.

    Tasks write the files under their names (``named_files``); the driver gets counts only. Ids must be unique and fit a file
    name; a repeated id raises before anything is written.
    """
    spark = named_files.register(docs.sparkSession)
    repeated = docs.groupBy("id").count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"an id is repeated: {repeated[0].id}")
    docs.select("id", "raw").write.format("named_files").mode("append").option("suffix", ".json").option("pretty", "true").save(folder)
    if (files := _in_folder(spark, f"{folder}/*.json", content=False)) is not None:
        return files.select(F.regexp_replace("name", r"\.json$", "").alias("id"), F.col("length").alias("bytes"))
    files = spark.read.format("binaryFile").load(f"{folder}/*.json")
    return files.select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("id"), F.col("length").alias("bytes"))
