"""Filter interaction audit: what each filter removes in each of the 120 orders of five filters, from lattice edges.

A filter's work at a step depends only on the set of filters before it, not on their order. So the 600 steps of all
orders lie on the 80 edges (set already applied, next filter) of the lattice of subsets. What a document adds to the
edges depends only on the set of filters that it fails: documents are counted by that set, at most 32 rows a part, those
rows give the counts of the edges, and a join lays the edges along the orders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails by itself; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    many, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    upper, signs = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long"), F.length(text).cast("long")
    fails = (many < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * many, 100 * upper > UPPER_PERCENT * signs, text.rlike("[#$%&*|]"))
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: documents of a part by the set of filters that they fail, as bits (A is 1, E is 16).

    E asks for an equal text under a smaller id anywhere. Texts go as digests; rows of one digest and part and equal labels
    are one row before they meet, so no group of copies is gathered, and the smallest id of a digest is joined back to
    these rows only. Rows without an id are no one's earlier copy and never fail E; rows that share an id are documents of
    their own, none smaller than the other. An id with several labels has each mark that one of them gives.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), own_failures(F.col(text_col)).alias("own"),
        F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("digest"),
    ).groupBy("id", "part", "own", "digest").agg(F.count("*").alias("n"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")
    )
    known = rows.join(marks, "id", "left").na.fill(0, ["good", "toxic"])
    # min of (id, n): how many of the rows are under the smallest id of the cell; those without an id are counted beside
    cells = known.groupBy("digest", "part", "own", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("low"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unknown")
    )
    first = cells.groupBy("digest").agg(F.min("low.id").alias("first_id"))
    split = cells.join(first, "digest").select(
        "part", "own", "good", "toxic", "n", (F.col("unknown") + F.when(F.col("low.id") == F.col("first_id"), F.col("low.n")).otherwise(0)).alias("fresh")
    )
    return (
        split.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("own").alias("mask"), F.col("fresh").alias("n")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))).alias("x"))
        .groupBy("part", F.col("x.mask").alias("mask"))
        .agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))
    )


def edges(counts: DataFrame) -> DataFrame:
    """The 80 edges of each part: ``part, applied, bit`` and what the filter of ``bit`` does after the filters ``applied``."""
    all_edges = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(1 << k).alias("bit")) for k in range(5) for s in range(32) if not s >> k & 1])
    wide = counts.select("*", F.explode(all_edges).alias("e")).select("*", "e.applied", "e.bit")
    fails, before = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("applied")) > 0
    total = lambda when, of="n": F.sum(F.when(when, F.col(of)).otherwise(0))
    return wide.groupBy("part", "applied", "bit").agg(
        total(~fails & ~before).alias("kept"), total(fails & ~before).alias("removed"), total(fails & before).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~before, "good").alias("good_lost"), total(fails & ~before, "toxic").alias("toxic_lost"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per part, order of the filters and step: ``part, filter_order, step, filter``, the counts of that edge and ``shapley``,
    the filter's removed documents summed over all orders.

    A null part is the empty string, a null text the empty text. An empty table gives an empty result. Columns other than
    the three named are ignored, whatever they are called. See ``failure_counts`` for rows without an id, repeated ids and labels.
    """
    spark = docs.sparkSession
    steps = []
    for order in permutations(range(5)):
        applied, letters = 0, "".join(FILTERS[k] for k in order)
        for step, k in enumerate(order, 1):
            steps.append((letters, step, FILTERS[k], applied, 1 << k))
            applied |= 1 << k
    steps = spark.createDataFrame(steps, "filter_order string, step int, filter string, applied int, bit int")  # 600 rows
    found = edges(failure_counts(docs, labels, id_col, text_col, part_col))
    orders = F.element_at(F.array(*[F.lit(factorial(s) * factorial(4 - s)) for s in range(5)]), F.bit_count("applied").cast("int") + 1)  # those that pass an edge
    shapley = found.groupBy("part", "bit").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    return found.join(shapley, ["part", "bit"]).join(F.broadcast(steps), ["applied", "bit"]).select("part", "filter_order", "step", "filter", *_COUNTS, "shapley")
