"""Schema adherence (M1), section coverage (M3) and source attribution (M5) of parsed briefs, and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.jsonx import bind, fields, get, get_string, items, not_blank, parse_strict
from docloom.functions.vocab import CLAIM_PATHS, SURFACE_SECTIONS, THRESHOLDS
from docloom.operators.validate import first_messages, violations


def populated(x: Column) -> Column:
    """A non-empty list, a non-blank string, or an object with such a field or with a non-empty object; numbers don't count."""
    inner = lambda y: (F.size(items(y)) > 0) | (F.size(fields(y)) > 0) | not_blank(_string(y))
    whole = lambda y: (
        F.coalesce(F.size(items(y)) > 0, F.lit(False))
        | F.coalesce(not_blank(_string(y)), F.lit(False))
        | F.coalesce(F.exists(F.map_values(fields(y)), lambda z: F.coalesce(inner(z), F.lit(False))), F.lit(False))
    )
    return bind(x, whole)


def _string(x: Column) -> Column:
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def declared_empty(v: Column) -> Column:
    """Strings of empty_sections; none if it is missing or not a list."""
    return F.coalesce(F.filter(F.transform(items(get(v, "empty_sections")), _string), lambda s: s.isNotNull()), F.array().cast("array<string>"))


def _table(rows: dict[str, tuple]) -> Column:
    return F.create_map(*[c for k, xs in rows.items() for c in (F.lit(k), F.array(*[F.lit(x) for x in xs]))])


def considered_sections(v: Column, surface: Column) -> Column:
    """Sections relevant to the surface that are populated or declared empty, in the surface's order. None for unknown surfaces."""
    relevant = F.coalesce(F.try_element_at(_table(SURFACE_SECTIONS), surface), F.array().cast("array<string>"))

    def seen(both: Column) -> Column:
        return F.filter(relevant, lambda s: F.array_contains(both.empty, s) | populated(F.try_element_at(both.m, s)))

    return bind(F.struct(fields(v).alias("m"), declared_empty(v).alias("empty")), seen)


def filled_sections(v: Column) -> Column:
    """Names of all fields of a document that are populated."""
    return F.map_keys(F.map_filter(fields(v), lambda _, x: populated(x)))


def relevant_count(surface: Column) -> Column:
    return F.coalesce(F.size(F.try_element_at(_table(SURFACE_SECTIONS), surface)), F.lit(0))


def claims(v: Column, paths: tuple = CLAIM_PATHS) -> Column:
    """Objects at the claim paths. A missing, null or unsuitable section has none; other items don't count."""
    table = F.array(*[F.struct(F.lit(p).alias("parent"), F.lit(c).cast("string").alias("child")) for p, c in paths])

    def lists(m: Column) -> Column:
        def one(p: Column) -> Column:
            section = F.try_element_at(m, p.parent)
            x = F.when(p.child.isNull(), section).otherwise(F.try_element_at(fields(section), p.child))
            return F.coalesce(items(x), F.array().cast("array<variant>"))

        return F.filter(F.flatten(F.transform(table, one)), lambda x: fields(x).isNotNull())

    return bind(fields(v), lists)


def sourced(claim: Column) -> Column:
    return F.coalesce(F.size(items(get(claim, "sources"))) > 0, F.lit(False))


def score(docs: DataFrame, text: str = "raw", keep: int = 5, paths: tuple = CLAIM_PATHS) -> DataFrame:
    """One score row per document: surface, schema_valid, schema_errors, cov_n, cov_d, attr_n, attr_d.

    A text that isn't one JSON object scores as unparseable: surface '?', invalid, coverage 0 of 1, attribution 0 of 0.
    Other columns stay. Narrow: one parse a document, no Python.
    """
    parsed = docs.withColumn("_v", parse_strict(F.col(text)))
    parsed = parsed.withColumn("_v", F.when(fields(F.col("_v")).isNotNull(), F.col("_v")))
    v = F.col("_v")
    wide = parsed.withColumns({"_errors": violations("_v"), "_claims": claims(v, paths), "_surface": F.coalesce(get_string(v, "surface"), F.lit("?"))})
    wide = wide.withColumn("_seen", considered_sections(v, F.col("_surface")))
    ok = v.isNotNull()
    return wide.withColumns({
        "surface": F.when(ok, F.col("_surface")).otherwise("?"),
        "schema_valid": ok & (F.size("_errors") == 0),
        "n_errors": F.when(ok, F.size("_errors")).otherwise(1),
        "schema_errors": F.when(ok, first_messages(F.col("_errors"), keep)).otherwise(F.array(F.lit("json parse"))),
        "cov_n": F.when(ok, F.size("_seen")).otherwise(0),
        "cov_d": F.when(ok, relevant_count(F.col("_surface"))).otherwise(1),
        "attr_n": F.when(ok, F.size(F.filter("_claims", sourced))).otherwise(0),
        "attr_d": F.when(ok, F.size("_claims")).otherwise(0),
    }).drop("_v", "_errors", "_claims", "_surface", "_seen")


def percent(n: Column, d: Column) -> Column:
    """100 n / d, NULL for d = 0."""
    return F.when(d != 0, 100.0 * n / d)


def meets(value: Column, metric: str, stage: str = "v0.1") -> Column:
    """Whether the unrounded percentage meets the gate; NULL where there is no value."""
    relation, bound = next((r, b) for m, s, r, b in THRESHOLDS if (m, s) == (metric, stage))
    return value >= bound if relation == ">=" else value <= bound
