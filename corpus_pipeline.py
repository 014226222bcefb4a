"""Corpus preparation in five stages; each returns documents that are written and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import line_dedup, minhash, mixing, packing, quality
from docloom.llm.common import scratch, table, unused
from docloom.llm.queries import tokenizer_path


# For every stage: an empty table gives an empty one; null and empty texts, very long ones, rows without a doc_id, repeated
# rows and columns of any name are in order and come out as each stage says. All but the last return the columns of documents.


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Each row is judged by its own text, whatever its doc_id; a null text as an empty one."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut from the texts; every row stays.

    Null texts stay null, and a text all of whose lines are copies becomes empty. Rows of one doc_id with different texts are
    documents of their own, equal rows are cut alike; rows without a doc_id stay as they are.
    """
    found, back = _aside(docs, "lines_removed")
    return back(line_dedup.dedup_lines(found, run_words=line_dedup.RUN_WORDS))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the smallest doc_id; of rows equal in id and text one.

    All null and empty texts are one class. Rows without a doc_id all stay.
    """
    return minhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of their slots: files hold consecutive ranges of the schedule. A null source is a source of its own."""
    found, back = _aside(docs, "mix_source", "mix_block", "mix_slot")
    by = ["mix_slot", "mix_source", "doc_id"]
    return back(mixing.mix(found).repartitionByRange(*by, F.xxhash64("text")).sortWithinPartitions(*by))


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns of these names, which an operator adds, renamed; and what gives a result the columns of ``docs``."""
    clash = [c for c in docs.columns if c.lower() in names]
    own = dict(zip(clash, unused(docs, *clash), strict=True))
    return docs.withColumnsRenamed(own), lambda df: df.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed windows, numbered along the order of the documents; consecutive documents of it are packed together.

    Documents read from files are taken in the order in which the files hold them, by the files' numbers and the rows' places: the order
    that the stage before wrote. Rows of any other frame have no order and get that of the default schedule. A null or empty
    text is the end id alone; rows without a doc_id are packed too, repeated rows each.
    """
    place = F.struct(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long"), F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    found = docs.withColumn("mix_slot", place) if _scanned(docs) else mixing.mix(docs)
    return packing.pack(found, tokenizer_path(), order_col="mix_slot")


def _scanned(docs: DataFrame) -> bool:
    """Whether the rows are those of files just as they lie there."""
    if docs._jdf.queryExecution().analyzed().children().nonEmpty():
        return False
    try:
        return bool(docs.select("_metadata.row_index").columns)
    except AnalysisException:
        return False


STAGES = [
    ("quality classifier", filter_quality),
    ("line dedup", dedup_lines),
    ("minhash near-dedup", dedup_near),
    ("mixing to target weights", mix_sources),
    ("packing", pack_windows),
]

#: The classifier, the sampling and the tokenizer can't be written in SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
