"""The library from ``spark.sql``: scalar functions for the lints and rates, temporary views and a table function over scored briefs.

    sql.register_functions(spark)
    sql.register_briefs(spark, docs)                       # docs: id, raw
    spark.sql("SELECT surface, m3(n, d) FROM (SELECT surface, sum(cov_n) AS n, sum(cov_d) AS d FROM brief_scores GROUP BY surface)")
    spark.sql("SELECT * FROM briefs_of_surface('qbr') WHERE NOT schema_valid")

A scalar function's body is the SQL of the library's own column expression, so both are one definition and Catalyst inlines it:
no Python runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.jsonx import configure, parse_strict
from docloom.operators import bundle, lints, metrics
from docloom.operators.validate import violations

#: Name: function of columns, and the names and types of its arguments.
FUNCTIONS: dict[str, tuple[Callable[..., Column], dict[str, str]]] = {
    **{f"lint_{n}": (getattr(lints, n), {"x": "string"}) for n in (
        "account_id", "customer_id", "case_number", "email", "quote_id", "iso_time", "snippet_fits", "no_forbidden_phrase", "specific_ref", "concrete_topic", "plain_quarter", "latin", "no_url",
    )},
    "lint_messy_amount": (lints.messy_amount, {"x": "bigint"}),
    "lint_near_names": (lints.near_names, {"a": "string", "b": "string"}),
    "country_name": (lints.country, {"x": "string"}),
    "url_host": (bundle.host, {"url": "string"}),
    "urgency_rank": (bundle.urgency_rank, {"urgency": "string"}),
    **{m: (metrics.percent, {"n": "bigint", "d": "bigint"}) for m in ("m1", "m3", "m5")},
}


def body(spark: SparkSession, function: Callable[..., Column], arguments: dict[str, str]) -> tuple[str, str]:
    """SQL and type of a function's expression over arguments of these names, as Catalyst resolves it."""
    row = spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in arguments.items()]).select(function(*map(F.col, arguments)).alias("result"))
    plan = row._jdf.queryExecution().analyzed()
    return plan.expressions().head().child().sql(), row.schema["result"].dataType.simpleString()


def register_functions(spark: SparkSession) -> list[str]:
    """Make ``FUNCTIONS`` temporary functions of the session; returns their names."""
    for name, (function, arguments) in FUNCTIONS.items():
        text, kind = body(spark, function, arguments)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{n} {t}' for n, t in arguments.items())}) RETURNS {kind} RETURN {text}")
    return list(FUNCTIONS)


def register_briefs(spark: SparkSession, docs: DataFrame, prefix: str = "brief") -> list[str]:
    """Temporary views of documents (id, raw): ``{prefix}_scores`` (a row each), ``{prefix}_violations`` (id, path, keyword),
    ``{prefix}_sections`` (id, surface, section: filled ones) and the table function ``{prefix}s_of_surface(surface)``.

    Views are plans, not copies: what a statement doesn't ask for isn't computed."""
    configure(spark)
    scores = metrics.score(docs).select("id", "surface", "schema_valid", "n_errors", "schema_errors", "cov_n", "cov_d", "attr_n", "attr_d")
    parsed = docs.select("id", parse_strict(F.col("raw")).alias("v")).where("v is not null")
    scores.createOrReplaceTempView(f"{prefix}_scores")
    parsed.select("id", F.explode(violations("v")).alias("x")).select("id", "x.path", "x.keyword").createOrReplaceTempView(f"{prefix}_violations")
    surface = F.try_variant_get("v", "$.surface", "string")
    parsed.select("id", surface.alias("surface"), F.explode(metrics.filled_sections(F.col("v"))).alias("section")).createOrReplaceTempView(f"{prefix}_sections")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scores.schema)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}s_of_surface(wanted STRING) RETURNS TABLE ({columns}) RETURN SELECT * FROM {prefix}_scores WHERE surface = wanted")
    return [f"{prefix}_scores", f"{prefix}_violations", f"{prefix}_sections", f"{prefix}s_of_surface"]
