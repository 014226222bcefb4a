"""Briefs made from the star-schema tables, broken on purpose by the customer's number, so that a relational oracle knows every outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.jsonx import configure
from docloom.functions.vocab import SURFACES
from docloom.sources.io import spread

#: Defect: modulus of c_custkey.
DEFECTS = {
    "truncated": 13, "null_summary": 11, "bad_enum": 17, "extra_key": 19, "number_for_string": 23, "over_cap": 29, "duplicate": 31,
    "below_minimum": 37, "missing_required": 41, "bad_map_value": 43,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, id, raw): one JSON text per customer, with orders as pipeline items. Parallel by customer."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda o: F.concat(
            F.lit('{"name":"Order '), o.o_orderkey.cast("string"), F.lit('","amount":'),
            F.when(o.o_orderkey % 17 == 0, "null").otherwise(F.concat(F.lit('"$'), o.o_orderkey.cast("string"), F.lit('"'))),
            F.lit(',"stage":"'), o.o_orderstatus, F.lit('"'),
            F.when(o.o_orderkey % 3 == 0, F.concat(F.lit(',"sources":[{"type":"sf_opp","ref":"'), o.o_orderkey.cast("string"), F.lit('"}]'))).otherwise(""),
            F.lit("}"))), ",").alias("items")
    )
    k = F.col("c_custkey")
    bad = {d: k % m == 0 for d, m in DEFECTS.items()}
    surface = F.element_at(F.array(*[F.lit(s) for s in SURFACES]), (k % 6 + 1).cast("int"))
    topic = '{"topic":"t","urgency":"high","what_happened":"w","open_in_meeting":"o"}'
    parts = [
        F.lit('{"account":{"name":"'), F.col("c_name"), F.lit('","industry":"'), F.col("c_mktsegment"), F.lit('"'),
        F.when(bad["extra_key"], ',"tier":1').otherwise(""), F.lit('},"surface":"'), surface, F.lit('",'),
        F.when(bad["missing_required"], "").otherwise('"generated_at":"2026-01-01T00:00:00Z",'),
        F.lit('"executive_summary":'), F.when(bad["null_summary"], "null").otherwise('"S"'),
        F.lit(',"confidence":{"overall":"'), F.when(bad["bad_enum"], "sure").otherwise("high"), F.lit('"'),
        F.when(bad["bad_map_value"], ',"per_section":{"pipeline":"sure","renewal":"low"}').otherwise(""),
        F.lit('},"empty_sections":["timeline"'), F.when(k % 2 == 0, ',"landmines"').otherwise(""),
        F.lit('],"sources_used":["sf_opp"'), F.when(bad["duplicate"], ',"sf_opp"').otherwise(""), F.lit('],"must_address":['),
        F.array_join(F.array_repeat(F.lit(topic), (k % 3).cast("int")), ","), F.lit('],"pipeline":{'),
        F.when(bad["number_for_string"], '"total_active_mrr":210000,').otherwise(""), F.lit('"items":['), F.coalesce("items", F.lit("")),
        F.lit(']},"support_health":{"open_cases_count":'), F.when(bad["below_minimum"], "-1").otherwise("2.0"), F.lit(',"items":[]},"talking_points":['),
        F.when(bad["over_cap"], '"a","b","c","d","e","f"').otherwise(F.when(k % 4 == 1, '"a"').otherwise("")),
        F.lit('],"carryover":"'), F.when(k % 5 == 0, "left over").otherwise("  "), F.lit('","_meta":{"shape_constraints":"Enterprise growth, rich"}}'),
    ]
    text = F.concat(*parts)
    made = (
        table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("k"), "left").drop("k")
        .select(k.alias("k"), F.concat(F.lit("brief-"), k.cast("string")).alias("id"), F.when(bad["truncated"], F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text).alias("raw"))
    )
    return spread(made, "k", task_bytes=1 << 20)  # parsing is work for cores, which bytes don't show; tasks grow in number with the input


#: The same briefs relationally, for DuckDB: one row per customer with every expected outcome.
EXPECTED_SQL = """
o AS (SELECT o_custkey AS k, count(*) AS n, sum(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) AS s FROM orders GROUP BY 1),
b AS (SELECT c_custkey AS k, coalesce(n, 0) AS n, coalesce(s, 0) AS s, c_custkey % 13 = 0 AS bad,
  (ARRAY['meeting_prep', 'qbr', 'handoff', 'renewal_alert', 'onboarding', 'escalation'])[1 + c_custkey % 6] AS surf
  FROM customer LEFT JOIN o ON c_custkey = o.k),
w AS (SELECT *, CASE WHEN n > 0 THEN 1 ELSE 0 END AS pipe, CASE WHEN k % 3 > 0 THEN 1 ELSE 0 END AS must,
  CASE WHEN k % 29 = 0 OR k % 4 = 1 THEN 1 ELSE 0 END AS talk, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS carry,
  CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS mine,
  CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END
  + CASE WHEN k % 23 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 31 = 0 THEN 1 ELSE 0 END
  + CASE WHEN k % 37 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 41 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 43 = 0 THEN 1 ELSE 0 END AS errs FROM b),
sc AS (SELECT 'brief-' || k AS id, k, CASE WHEN bad THEN '?' ELSE surf END AS surface, NOT bad AND errs = 0 AS schema_valid,
  CASE WHEN bad THEN 1 ELSE errs END AS n_errors,
  CASE WHEN bad THEN 0 ELSE CASE surf WHEN 'meeting_prep' THEN must + pipe + mine + talk + carry WHEN 'qbr' THEN must + pipe + talk
    WHEN 'handoff' THEN pipe + 1 + mine WHEN 'renewal_alert' THEN must + pipe + mine WHEN 'onboarding' THEN 1 ELSE must END END AS cov_n,
  CASE WHEN bad THEN 1 ELSE CASE surf WHEN 'meeting_prep' THEN 12 WHEN 'qbr' THEN 11 WHEN 'handoff' THEN 7 WHEN 'renewal_alert' THEN 9
    WHEN 'onboarding' THEN 5 ELSE 4 END END AS cov_d,
  CASE WHEN bad THEN 0 ELSE s END AS attr_n, CASE WHEN bad THEN 0 ELSE n + k % 3 END AS attr_d FROM w)
"""
