"""Metrics that need the inputs of a brief: grounding (M2), honest empties (M4), calibration (M6), latency (M7), style (M8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.matching import phrases_in_texts
from docloom.operators.selection import percentiles


def ungrounded(refs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Claims (id, ref, ...) whose ref is not an input id of the same document (id, ref)."""
    return refs.join(inputs.select("id", "ref").distinct(), ["id", "ref"], "left_anti")


def grounded_by_phrase(claims: DataFrame, inputs: DataFrame) -> DataFrame:
    """Claims (id, phrase, ...) that stand literally in an input text (id, text) of the same document; equal claims once."""
    return claims.join(phrases_in_texts(claims, inputs), ["id", "phrase"], "left_semi").distinct()


def entities(text: Column) -> Column:
    """Names in a text: runs of capitalised words that aren't only a sentence's first word; numbers of four digits and more.
    Distinct, in order of their spelling."""
    word = r"\p{Lu}[\p{L}\p{N}'’&-]*"
    name = rf"(?<!^)(?<![.!?:]\s)\b{word}(?: {word})*|\b{word}(?: {word})+|\b\p{{N}}{{4,}}\b"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(name), F.lit(0))))


def unfounded_entities(summaries: DataFrame, inputs: DataFrame) -> DataFrame:
    """(id, entity) named in a summary (id, text) but in none of the input texts (id, text) of the same document."""
    named = summaries.select("id", F.explode(entities(F.col("text"))).alias("entity"))
    return not_in_inputs(named, inputs)


def not_in_inputs(named: DataFrame, inputs: DataFrame) -> DataFrame:
    """The rows (id, entity) that stand in none of the input texts (id, text) of their id, in any case."""
    low = named.select("id", F.lower("entity").alias("phrase"))
    found = phrases_in_texts(low, inputs.select("id", F.lower("text").alias("text")))
    return named.join(found.withColumnRenamed("phrase", "_low"), (named.id == found.id) & (F.lower("entity") == F.col("_low")), "left_anti")


def hallucination(claims: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, n_bad and the rate in percent of claims with a boolean ``grounded``, overall or by e.g. confidence tier."""
    bad = F.count_if(~F.col("grounded"))
    return claims.groupBy(*(by or [])).agg(F.count("*").alias("n"), bad.alias("n_bad"), (100.0 * bad / F.count("*")).alias("rate"))


def empties(sections: DataFrame) -> DataFrame:
    """Class of every (section, declared_empty, has_signal, populated): true_empty, false_empty, hidden_empty, missed or filled."""
    kind = (
        F.when(F.col("declared_empty") & ~F.col("has_signal"), "true_empty").when(F.col("declared_empty"), "false_empty")
        .when(~F.col("populated") & ~F.col("has_signal"), "hidden_empty").when(~F.col("populated"), "missed").otherwise("filled")
    )
    return sections.withColumn("kind", kind)


def in_band(tier: Column, rate: Column) -> Column:
    """Whether a tier's rate lies in its band: high under 1, medium 1 to 5, low over 5 percent."""
    return F.when(tier == "high", rate < 1).when(tier == "medium", (rate >= 1) & (rate <= 5)).when(tier == "low", rate > 5)


def monotonic(rates: DataFrame) -> DataFrame:
    """One row: whether the rate rises from high over medium to low (tiers without claims don't count)."""
    rate = {t: F.max(F.when(F.col("confidence") == t, F.col("rate"))) for t in ("high", "medium", "low")}
    pairs = [("high", "medium"), ("medium", "low"), ("high", "low")]
    ok = F.lit(True)
    for a, b in pairs:
        ok = ok & F.coalesce(rate[a] < rate[b], F.lit(True))
    return rates.agg(ok.alias("monotonic"))


def latency(times: DataFrame, column: str, by: list[str] | None = None, task_rows: int = 1_000_000) -> DataFrame:
    """Exact median and 95th percentile, whatever the size of a group."""
    found = percentiles(times, column, [0.5, 0.95], by, task_rows)
    return found.select(*(by or []), "n", F.col("values")[0].alias("p50"), F.col("values")[1].alias("p95"))


def style(scores: DataFrame, by: list[str], least: float = 4.0) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("score").alias("mean")).withColumn("passed", F.col("mean") >= least)


def source_type_gaps(inline: Column, used: Column) -> tuple[Column, Column]:
    """Types cited but not listed, and listed but not cited."""
    return F.array_sort(F.array_except(inline, used)), F.array_sort(F.array_except(used, inline))
