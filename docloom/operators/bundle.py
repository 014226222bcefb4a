"""Upstream tables to sections of a brief."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

URGENCY = ("critical", "high", "medium", "low")


def attach(accounts: DataFrame, rows: DataFrame, key: str, name: str, fields: list[str], order: str, most: int | None = None) -> DataFrame:
    """Accounts with an ordered list of their rows as structs; an account without rows gets an empty list.

    A list is one value, so without ``most`` an account's rows must fit into one. With ``most`` the list holds the first that many, and
    ``n_<name>`` counts all rows: each task sends at most that many rows of an account and its count, however many the account has.
    """
    listed = F.sort_array(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias(name)
    if most is None:
        kept = rows.groupBy(key).agg(listed)
    else:
        held = [key, *dict.fromkeys([order, *fields])]
        kept = top_rows(rows.select(*held), key, [order], most).groupBy(key).agg(listed)
        counts = rows.groupBy(key).agg(F.count("*").alias(f"n_{name}"))
        accounts = accounts.join(counts, key, "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0).cast("long")))
    return accounts.join(kept, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kept.schema[name].dataType)))


def live_or_recent(is_open: Column, closed: Column, as_of: Column, days: int = 90) -> Column:
    return is_open | (closed >= F.date_sub(as_of, days))


def since(when: Column, as_of: Column, days: int) -> Column:
    return when >= F.date_sub(as_of, days)


def counted_cases(cases: DataFrame, kind: str, kinds: tuple | list, author: str, bots: tuple | list) -> DataFrame:
    """Cases of the record types that count, without those that bots or inside systems opened; NULL types and authors stay out and in."""
    return cases.where(F.col(kind).isin(*kinds) & ~F.coalesce(F.col(author).isin(*bots), F.lit(False)))


def renews_within(end: Column, as_of: Column, days: int) -> Column:
    """A contract that ends from ``as_of`` on within so many days."""
    return (end >= as_of) & (end <= F.date_add(as_of, days))


def open_long(priority: Column, is_open: Column, opened: Column, as_of: Column, days: int = 30, urgent: str = "P1") -> Column:
    """A case of the urgent priority that has been open for more than ``days`` days; unknown parts don't make one."""
    return F.coalesce((priority == urgent) & is_open & (F.date_diff(as_of, opened) > days), F.lit(False))


def lost_recently(stage: Column, closed: Column, as_of: Column, days: int = 90, lost: str = "Closed Lost") -> Column:
    """An opportunity that was lost in the ``days`` days up to ``as_of``, that day included; later closings don't count yet."""
    return F.coalesce((stage == lost) & F.date_diff(as_of, closed).between(0, days), F.lit(False))


def left_recently(contacts: DataFrame, by: str, left: str, primary: str, as_of: Column, engagement: str, days: int = 90, low: float = 1.0) -> DataFrame:
    """Per ``by`` whose primary contact left in the ``days`` days up to ``as_of``: the newest leaving, and whether those who are left
    engage little: none of them more than ``low``. An account without anyone left counts as that, too."""
    gone = F.coalesce(F.col(primary) & F.date_diff(as_of, F.col(left)).between(0, days), F.lit(False))
    stays = F.col(left).isNull() | (F.col(left) > as_of)
    found = contacts.groupBy(by).agg(F.max(F.when(gone, F.col(left))).alias("left"), F.max(F.when(stays, F.col(engagement))).alias("_most"))
    return found.where("left is not null").select(by, "left", (F.coalesce(F.col("_most"), F.lit(0.0)) <= low).alias("low_engagement"))


def last_activity(rows: DataFrame, by: str, when: str, as_of: Column) -> DataFrame:
    """Per ``by``: the newest time, and whole days from it to ``as_of``."""
    return rows.groupBy(by).agg(F.max(when).alias("last")).withColumn("days_ago", F.date_diff(as_of, F.col("last").cast("date")))


def open_sums(rows: DataFrame, by: str, is_open: Column, amount: Column, is_urgent: Column, kind: Column) -> DataFrame:
    """Per ``by``: amount of what is open, count of what is urgent, distinct kinds in order."""
    return rows.groupBy(by).agg(
        F.sum(F.when(is_open, amount).otherwise(0)).alias("open_total"), F.count_if(is_urgent).alias("urgent"), F.array_sort(F.collect_set(kind)).alias("kinds")
    )


def activity_volume(rows: DataFrame, by: str, when: Column, contact: Column, as_of: Column, days: int = 45, least: int = 50) -> DataFrame:
    """Per ``by`` with ``least`` rows or more in the days before ``as_of``: how many, and the share without a contact."""
    found = rows.where(since(when, as_of, days) & (when <= as_of)).groupBy(by).agg(F.count("*").alias("n"), F.avg(contact.isNull().cast("int")).alias("null_share"))
    return found.where(F.col("n") >= least)


def top_rows(rows: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each ``by``, with their ``rank``: ranked before anything is listed, so lists stay short.

    Spark ranks within each task first and sends only what can be among the first ``k``, so a ``by`` that holds much of all rows is no load.
    """
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def urgency_rank(urgency: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in URGENCY]), urgency), F.lit(0)), F.lit(9))


def host(url: Column) -> Column:
    """The host of a URL, without its port."""
    return F.split_part(F.split_part(url, F.lit("/"), F.lit(3)), F.lit(":"), F.lit(1))


def unknown_codes(billing: DataFrame, known: DataFrame, code: str = "dc_code") -> DataFrame:
    return billing.where(F.col(code).isNotNull()).join(known.select(code).distinct(), code, "left_anti").select(code).distinct()


def billing_rollup(billing: DataFrame) -> DataFrame:
    """Sums by period, product line and code with subtotals; NULL keys of subtotal rows are told by ``level``."""
    return billing.rollup("period", "product_line", "dc_code").agg(
        F.grouping_id().alias("level"), F.sum("mrc_usd").alias("mrc_usd"), F.sum("nrc_usd").alias("nrc_usd")
    )


def period_change(billing: DataFrame) -> DataFrame:
    w = Window.partitionBy("product_line", "dc_code").orderBy("period")
    return billing.withColumn("change", F.col("mrc_usd") - F.lag("mrc_usd").over(w))


def duplicates(contacts: DataFrame, by: list[str]) -> DataFrame:
    """Groups of contacts with the same name: how many, and when first seen."""
    return contacts.groupBy(*by).agg(F.count("*").alias("n"), F.min("seen").alias("first_seen")).where("n > 1")


def ranked_by_urgency(entries: Column) -> Column:
    """must_address by urgency, most urgent first; entries of one urgency stay in order."""
    keyed = F.transform(entries, lambda e, i: F.struct(urgency_rank(e.urgency).alias("r"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda x: x.e)


def newest(entries: Column, most: int = 5) -> Column:
    """The newest entries of structs that begin with their date."""
    return F.slice(F.reverse(F.array_sort(entries)), 1, most)


def top_similar(vectors: DataFrame, asked: DataFrame, k: int = 5, vector_block: int = 16_384, question_block: int = 4_096) -> DataFrame:
    """Per question (q_id, q) the k most similar vectors (vec_id, embedding) by cosine, ties to the smaller id.

    Neither side is bounded: both are dealt into blocks, every block of questions meets every block of vectors by key,
    and only the k best of a question in a pair of blocks go on to its final ranking. Blocks are multiplied as matrices; what a
    rounding error could put among the k best is computed again, summed in the vectors' order. A cosine that isn't a number comes first, one
    of NULL or empty vectors, NULL elements or unequal lengths is NULL and comes last.
    """
    rows, questions = (max(1, -(-df.count() // n)) for df, n in ((vectors, vector_block), (asked, question_block)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda i, x, n: F.pmod(F.xxhash64(i, x), F.lit(n)).cast("int")
    left = vectors.where("vec_id is not null").select("vec_id", "embedding", block("vec_id", "embedding", rows).alias("_rows"), every(questions).alias("_questions"))
    own = F.col("q_id").cast(vectors.schema["vec_id"].dataType).alias("_own")
    right = asked.where("q_id is not null").select("q_id", own, "q", block("q_id", "q", questions).alias("_questions"), every(rows).alias("_rows"))
    keys = ["_rows", "_questions"]
    kinds = [f"q_id {asked.schema['q_id'].dataType.simpleString()}", f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}", "similarity double"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda v, q: _best_of_blocks(v, q, k), ", ".join(kinds))
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("similarity"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


SLICE = 1 << 20  # pairs that are compared at once


def _vectors(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places of the vectors without NULLs, and the vectors."""
    held = column.combine_chunks()
    if isinstance(held, pa.ChunkedArray):
        held = held.chunk(0) if held.num_chunks else pa.array([], column.type)
    size = pc.fill_null(pc.list_value_length(held), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    nulls = pc.unique(pc.list_parent_indices(held).filter(pc.is_null(pc.list_flatten(held)))).to_numpy(zero_copy_only=False)
    size[nulls] = -1
    out = {}
    for n in np.unique(size[size > 0]):
        places = np.flatnonzero(size == n)
        flat = pc.list_flatten(held.take(pa.array(places))).to_numpy(zero_copy_only=False)
        out[int(n)] = places, np.asarray(flat, np.float64).reshape(len(places), n)
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first element on as F.aggregate does: the same for equal vectors wherever they stand."""
    s = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        s = s + x * y
    return s


def _best_of_blocks(vectors: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """``q_id, vec_id, similarity`` of the k best vectors of each question."""
    vectors = vectors.take(pc.sort_indices(vectors["vec_id"]))  # places are in the order of the ids
    ids = pa.chunked_array([*vectors["vec_id"].chunks, *asked["_own"].chunks], vectors["vec_id"].type).combine_chunks().dictionary_encode()
    codes = (ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids).indices.to_numpy(zero_copy_only=False)
    n, m = len(vectors), len(asked)
    code, own = codes[:n], codes[n:]
    known, questions = _vectors(vectors["embedding"]), _vectors(asked["q"])
    of = {int(p): (size, at) for size, (places, _) in questions.items() for at, p in enumerate(places)}
    out_q, out_v, out_s = [], [], []
    step = max(1, SLICE // max(1, n))
    with np.errstate(all="ignore"):
        norms = {size: np.sqrt(_dot(x, x)) for size, (_, x) in known.items()}
        asked_norms = {size: np.sqrt(_dot(x, x)) for size, (_, x) in questions.items()}
        for first in range(0, m if n else 0, step):
            some = range(first, min(m, first + step))
            near = np.full((len(some), n), -3.0)  # NULL cosines
            again = np.zeros(near.shape, bool)
            for size, (places, x) in known.items():
                mine = [p for p in some if p in of and of[p][0] == size]
                if not mine:
                    continue
                at = [of[p][1] for p in mine]
                both = asked_norms[size][at][:, None] * norms[size][None, :]
                c = (questions[size][1][at] @ x.T) / both
                odd = ~np.isfinite(c) | ~((both > 1e-140) & (both < 1e140))  # errors are larger there: computed again in any case
                c[odd] = -3.0
                here = np.ix_([p - first for p in mine], places)
                near[here], again[here] = c, odd
            near[own[first : first + len(some), None] == code[None, :]] = -9.0  # the question itself
            far = np.partition(near, max(0, n - k), axis=1)[:, max(0, n - k)]
            for p in some:
                row = near[p - first]
                found = np.flatnonzero((again[p - first] | (row >= far[p - first] - 1e-9)) & (row > -9.0))
                exact = np.full(len(found), -np.inf)  # NULL cosines, after all others
                if p in of:
                    size, at = of[p]
                    places, x = known.get(size, (np.array([], np.int64), None))
                    there = np.searchsorted(places, found)
                    fits = np.flatnonzero((there < len(places)) & (places[np.minimum(there, len(places) - 1)] == found)) if len(places) else []
                    if len(fits):
                        t = there[fits]
                        exact[fits] = _dot(x[t], np.broadcast_to(questions[size][1][at], (len(t), size))) / (norms[size][t] * asked_norms[size][at])
                order = np.lexsort((found, -np.where(np.isnan(exact), np.inf, exact)))[:k]
                out_q += [p] * len(order)
                out_v += found[order].tolist()
                out_s += [None if s == -np.inf else s for s in exact[order].tolist()]
    take = lambda column, places: column.take(pa.array(places, pa.int64()))
    return pa.table({"q_id": take(asked["q_id"], out_q), "vec_id": take(vectors["vec_id"], out_v), "similarity": pa.array(out_s, pa.float64())})


def normalised_amount(mrr: Column, amount: Column) -> Column:
    """Normalised recurring revenue before the raw amount, whose currency isn't known."""
    return F.coalesce(mrr, amount)


def edge_case_share(records: DataFrame, column: str = "edge_cases") -> DataFrame:
    """Per edge case: rows that have it and their share of all rows in percent."""
    total = records.agg(F.count("*").alias("total"))
    return records.select(F.explode(F.array_distinct(column)).alias("edge_case")).groupBy("edge_case").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("edge_case", "n", (100.0 * F.col("n") / F.col("total")).alias("share"))


def coverage_matrix(records: DataFrame) -> DataFrame:
    """Counts by surface and shape with totals on either side."""
    return records.cube("surface", "account_shape").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
