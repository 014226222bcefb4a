"""Score reports: eval ids against scored predictions, rollup by surface, gates, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.metrics import THRESHOLDS, meets, percent
from docloom.sources.io import shared_folder

OVERALL = "OVERALL"


def join_predictions(ids: DataFrame, scores: DataFrame, missing: str = "drop") -> DataFrame:
    """Scores of the eval ids, order and repeats of ids kept by the caller's columns. ``missing='count'`` gives unpredicted ids a failing row."""
    if missing not in ("drop", "count"):
        raise ValueError("missing must be 'drop' or 'count'")
    if missing == "drop":
        return ids.join(scores, "id", "inner")
    return ids.join(scores, "id", "left").withColumns({
        "surface": F.coalesce("surface", F.lit("?")), "schema_valid": F.coalesce("schema_valid", F.lit(False)),
        "cov_n": F.coalesce("cov_n", F.lit(0)), "cov_d": F.coalesce("cov_d", F.lit(1)),
        "attr_n": F.coalesce("attr_n", F.lit(0)), "attr_d": F.coalesce("attr_d", F.lit(0)),
    })


def missing_ids(ids: DataFrame, scores: DataFrame) -> DataFrame:
    return ids.join(scores, "id", "left_anti")


def report(scores: DataFrame) -> DataFrame:
    """One row per surface and one OVERALL row of sums (micro average) with unrounded percentages and gates on OVERALL."""
    sums = scores.rollup("surface").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n"), F.count_if("schema_valid").alias("n_valid"),
        *[F.sum(c).cast("long").alias(c) for c in ("cov_n", "cov_d", "attr_n", "attr_d")],
    )
    total = F.col("_g") == 1
    m1, m3, m5 = percent(F.col("n_valid"), F.col("n")), percent(F.col("cov_n"), F.col("cov_d")), percent(F.col("attr_n"), F.col("attr_d"))
    gate = F.coalesce(meets(m1, "m1") & meets(m3, "m3") & meets(m5, "m5"), F.lit(False))
    return sums.select(
        F.when(total, OVERALL).otherwise(F.col("surface")).alias("surface"), "n", "n_valid", "cov_n", "cov_d", "attr_n", "attr_d",
        m1.alias("m1"), m3.alias("m3"), m5.alias("m5"), F.when(total, gate).alias("gate_passed"),
    )


def failures(scores: DataFrame, most: int = 3) -> DataFrame:
    """Invalid documents with their first messages, by id."""
    return scores.where(~F.col("schema_valid")).select("id", F.array_join(F.slice("schema_errors", 1, most), "; ").alias("messages")).orderBy("id")


def percent_text(n: Column, d: Column, metric: str, stage: str = "v0.1") -> Column:
    """As ``96.0% (target >= 95%)``; ``n/a`` where there is nothing to count."""
    relation, bound = next((r, b) for m, s, r, b in THRESHOLDS if (m, s) == (metric, stage))
    return F.coalesce(F.concat(F.format_string("%.1f%%", percent(n, d)), F.lit(f" (target {relation} {bound:g}%)")), F.lit("n/a"))


def paired(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, predicted, gold): matched by id, never by position; ids on one side only have a NULL on the other."""
    return predictions.select("id", F.col("raw").alias("predicted")).join(gold.select("id", F.col("raw").alias("gold")), "id", "full")


def card(scores: DataFrame, ids: DataFrame | None = None, most: int = 3) -> DataFrame:
    """The report card (part, line): a line a surface, targets of the whole, missing ids, the first failures and warnings.

    Documents are parsed and scored once: what the parts read is written to the shared folder, with the first messages only.
    """
    scores = written(scores.withColumn("schema_errors", F.slice("schema_errors", 1, most)), "scores")
    found = written(report(scores), "rollup")  # a row a surface
    total = F.col("surface") == OVERALL
    show = lambda c: F.coalesce(F.format_string("%.1f%%", F.col(c)), F.lit("n/a"))
    rows = found.select(F.when(total, "2 total").otherwise("1 surface").alias("part"), F.concat_ws(" ", "surface", F.col("n").cast("string"), show("m1"), show("m3"), show("m5")).alias("line"))
    whole = found.where(total)
    parts = [rows]
    for m, n, d in (("m1", "n_valid", "n"), ("m3", "cov_n", "cov_d"), ("m5", "attr_n", "attr_d")):
        parts.append(whole.select(F.lit("3 target").alias("part"), F.concat_ws(" ", F.lit(m), percent_text(F.col(n), F.col(d), m), F.when(meets(F.col(m), m), "ok").otherwise("missed")).alias("line")))
    parts.append(failures(scores, most).select(F.lit("4 failure").alias("part"), F.concat_ws(": ", "id", "messages").alias("line")).limit(10))
    parts.append(scores.where("surface = '?'").orderBy("id").select(F.lit("5 warning").alias("part"), F.concat(F.lit("no JSON object: "), F.col("id")).alias("line")).limit(10))
    if ids is not None:
        parts.append(missing_ids(ids, scores).orderBy("id").select(F.lit("6 missing").alias("part"), F.col("id").alias("line")).limit(10))
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out


def written(df: DataFrame, tag: str) -> DataFrame:
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lines(rows: list) -> list[str]:
    """The report as text; all logic is in the rows."""
    show = lambda x: "n/a" if x is None else f"{x:.1f}%"
    return [f"{r.surface:<16}{r.n:>7}{show(r.m1):>9}{show(r.m3):>9}{show(r.m5):>9}" for r in rows]
