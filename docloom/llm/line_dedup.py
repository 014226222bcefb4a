"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

Every line gets an ID, a 128-bit digest of its text without surrounding blanks. Suffixes (positions) are ranked by
their first line, then by prefixes of 2, 4, ... lines: the rank of a prefix twice as long is that of the pair (rank
here, rank h lines on). Only classes with at least two members stay, so each round is smaller than the last, and
doubling ends once prefixes reach ``min_lines``: longer common prefixes delete no more. Equal ranks are the
longest-common-prefix intervals of that length; runs of overlapping intervals are the maximal repeated runs.

A line is deleted if it lies in a run of ``min_lines`` lines that also starts at an earlier position (smaller doc_id,
or the same document further up), or if it has ``min_words`` words itself and an earlier equal line. With
``run_words`` shorter runs count by what they hold: a run of any number of lines that starts at an earlier position
too is deleted if its lines have ``run_words`` words or ``RUN_CHARS`` characters together; the characters are for scripts
that have no blanks between words. Words are parted by any white space. Everything is judged on the input, so the
result doesn't depend on order of work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import LIGHT, WIDE, discard, gathered, settle, unused

MIN_LINES = 4
MIN_WORDS = 10
# What the registered query and the pipeline use.
RUN_WORDS = 3
RUN_CHARS = 16


def _lines(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.where("doc_id is not null").select(*_key(), F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def _key() -> list:
    """A document is a doc_id and a digest of its text, so rows of one doc_id with different texts are told apart."""
    return [F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("body")]


def _ranked(keys: DataFrame, by: list[str], length: int) -> DataFrame:
    """Members of classes of two or more, with a rank in the order of ``by`` and whether an earlier member exists; ``keys`` are used up.

    Class sizes come from partial aggregation and only one row a class is sorted; joining back, a class with very
    many members is a skewed join, which adaptive execution splits.
    """
    place = F.struct("doc", "body", "pos")
    classes = keys.groupBy(*by).agg(F.count("*").alias("members"), F.min(place).alias("first")).where("members > 1")
    classes = classes.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()).drop("members")  # keys are unique: the order is fixed
    found = keys.join(classes, by).select(*PLACE, "rank", "words", "chars", (place > F.col("first")).alias("later"))
    found = settle(found.dropDuplicates(PLACE) if length == 1 else found, "suffixes", LIGHT)
    discard(keys)
    return found


PLACE = ["doc", "body", "pos"]


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, run_words: int | None = None) -> DataFrame:
    """(doc, body, pos, reach): from position pos on, the next ``reach`` lines have an earlier copy."""
    if min_lines < 2 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    line = F.trim("line")
    keys = _lines(docs).select(
        *PLACE, F.xxhash64(line).alias("a"), F.xxhash64(F.lit(17), F.reverse(line)).alias("b"),
        F.regexp_count(line, F.lit(r"(?U)\S+")).alias("words"), F.length(line).alias("chars"),
    )
    keys = settle(keys, "lines")
    enough = F.lit(False) if run_words is None else (F.col("words") >= run_words) | (F.col("chars") >= RUN_CHARS)
    # Rows that are equal altogether are one document from here on; all their lines are members of classes.
    states = {1: _ranked(keys, ["a", "b"], 1)}
    found = states[1].where(F.col("later") & ((F.col("words") >= min_words) | enough)).select(*PLACE, F.lit(1).alias("reach"))
    for n in range(2, min_lines + 1):
        h = 1 << (n - 1).bit_length() - 1
        if run_words is None and n != 2 * h:
            continue
        sums = [(F.col(c) + F.col(f"next_{c}")).alias(c) for c in ("words", "chars")]
        follow = states[n - h].select("doc", "body", (F.col("pos") - h).alias("pos"), F.col("rank").alias("next"), *[F.col(c).alias(f"next_{c}") for c in ("words", "chars")])
        pairs = states[h].join(follow, PLACE).select(*PLACE, *sums, "rank", "next")
        pairs = settle(pairs, "pairs", LIGHT).withColumnRenamed("rank", "here")
        states[n] = _ranked(pairs, ["here", "next"], n)
        cut = states[n].where("later") if n == min_lines else states[n].where(F.col("later") & enough)
        found = found.union(cut.select(*PLACE, F.lit(n)))
    return found


def maximal_runs(found: DataFrame) -> DataFrame:
    """(doc, body, runs): the maximal runs (start, lines) of lines that overlapping or touching intervals cover."""
    covered = (
        found.select("doc", "body", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("reach") - 1)).alias("pos"))
        .groupBy("doc", "body").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    )
    begins = F.filter("at", lambda p, i: (i == 0) | (F.get("at", i - 1) < p - 1))
    ends = F.filter("at", lambda p, i: (i == F.size("at") - 1) | (F.get("at", i + 1) > p + 1))
    runs = F.arrays_zip(begins.alias("start"), F.transform(ends, lambda p: p + 1).alias("end"))
    return covered.select("doc", "body", F.transform(runs, lambda r: F.struct(r["start"].alias("start"), (r["end"] - r["start"]).alias("lines"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, run_words: int | None = None) -> DataFrame:
    """``docs`` with later copies of repeated line runs cut from ``text``, and column ``lines_removed``.

    Every row comes back once and other columns stay as they are, whatever their names; n_chars, where present, is brought
    up to date. Null texts stay null and empty ones empty; rows without a doc_id come back as they are and don't count. A
    document all of whose lines go keeps an empty text. Rows of one doc_id with different texts are documents of their own,
    in the order of a digest of their texts; rows equal in both are one document and are cut alike. Blank lines count as
    lines in runs. An empty table gives an empty result.
    """
    base = docs.drop("lines_removed")
    doc, body, runs = unused(base, "doc", "body", "runs")
    gone = maximal_runs(repeated_lines(docs, min_lines, min_words, run_words))
    # A flag for each line up to the last one cut, so that a line is looked up at once however many are cut.
    flags = F.flatten(F.transform("runs", lambda r, i: F.concat(
        F.array_repeat(F.lit(False), (r["start"] - F.coalesce(F.get("runs", i - 1)["start"] + F.get("runs", i - 1)["lines"], F.lit(0))).cast("int")),
        F.array_repeat(F.lit(True), r["lines"].cast("int")),
    )))
    gone = gone.groupBy(F.col("doc").alias(doc), F.col("body").alias(body)).agg(F.first(flags).alias(runs))
    own = [x == F.col(n) for x, n in zip((F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))), (doc, body), strict=True)]
    joined = base.join(gone, own, "left")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.coalesce(F.get(runs, i), F.lit(False)))
    cut = F.col(runs).isNotNull()
    new = {"text": F.when(cut, F.array_join(kept, "\n")).otherwise(F.col("text")), "lines_removed": F.coalesce(F.size(F.filter(runs, lambda x: x)), F.lit(0)).cast("long")}
    out = joined.withColumns(new)
    if "n_chars" in base.columns:
        kind = base.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return gathered(out.select(*base.columns, "lines_removed"), WIDE)
