"""Registered queries of records, prompts, masks and violations on rows that briefs of the common make don't have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import jsonx
from docloom.operators import masking, records
from docloom.operators.validate import violations
from docloom.plans.registry import query
from docloom.plans.synth import table


def _pick(key: Column, *values: str | None) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose surface is told at the top, in ``_meta`` only, beside an empty one, or nowhere; with and without a shape."""
    k = F.col("c_custkey")
    top = _pick(k, '"surface":"qbr",', '"surface":"",', "", "")
    meta = _pick(k, "", '"surface":"handoff",', '"surface":"renewal_alert",', "")
    said = _pick(k, '"shape_constraints":"an enterprise_steady account, sf_only"', '"shape_constraints":"nothing known"', '"x":1')
    raw = F.concat(F.lit("{"), top, F.lit('"k":'), k.cast("string"), F.lit(',"_meta":{'), meta, said, F.lit("}}"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), raw.alias("raw"))


_DOCUMENTS = """d AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'qbr' WHEN 1 THEN 'handoff' WHEN 2 THEN 'renewal_alert' END AS surface,
  CASE WHEN c_custkey % 3 = 0 THEN 'enterprise_steady' END AS shape FROM customer)"""


@query(f"""WITH {_DOCUMENTS} SELECT id, surface, shape, md5('Generate one synthetic example with these parameters:' || chr(10) || chr(10) || coalesce('- surface: ' || surface || chr(10), '') || '- account_shape: enterprise_steady'
  || CASE WHEN shape IS NULL THEN '' ELSE chr(10) || '- source_mix: sf_only' END) AS prompt_md5, '{{"k":' || id || CASE id % 4 WHEN 0 THEN ',"surface":"qbr"' WHEN 1 THEN ',"surface":""' ELSE '' END || '}}' AS body FROM d""")
def record_variants(spark, sf_dir):
    """The surface falls back on ``_meta``, an assumed shape is left NULL, and the message drops ``_meta`` only."""
    made = records.chat_records(_documents(spark, sf_dir), "You write briefs.")
    return made.select("id", "surface", "shape", F.md5(F.col("messages")[1].content).alias("prompt_md5"), F.col("messages")[2].content.alias("body"))


@query(f"WITH {_DOCUMENTS} SELECT surface, count(*) AS n, count(*) FILTER (shape IS NULL) AS n_warnings FROM d GROUP BY 1")
def record_summary_warned(spark, sf_dir):
    return records.summary(records.chat_records(_documents(spark, sf_dir), "You write briefs."))


@query("""SELECT c_custkey AS id, md5('Generate one synthetic example with these parameters:' || chr(10) || chr(10) || '- surface: qbr' || chr(10) || '- account_shape: stalled_at_risk'
  || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || '- edge_cases: ["null_industry"]' ELSE chr(10) || '- edge_cases: ["null_industry", "sparse_activity"]' END
  || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || '- source_mix: minimal' ELSE '' END
  || CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '' ELSE chr(10) || '- account_hint: ' || c_name END) AS prompt_md5 FROM customer""")
def prompts_with_hints(spark, sf_dir):
    """A hint, an empty hint or none; no, one or two edge cases; with and without a mix."""
    k = F.col("c_custkey")
    cases = F.slice(F.array(F.lit("null_industry"), F.lit("sparse_activity")), F.lit(1), (k % 3).cast("int"))
    hint = F.when(k % 5 == 0, F.lit("")).when(k % 5 > 1, F.col("c_name"))
    made = records.prompt(F.lit("qbr"), F.lit("stalled_at_risk"), cases, F.when(k % 2 == 0, "minimal"), hint)
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.md5(made).alias("prompt_md5"))


@query("""WITH t AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT l_orderkey, CASE WHEN least(n, l_orderkey % 4) = n THEN 'fail_all_masked' WHEN l_orderkey % 4 = 0 THEN 'fail_none_masked' WHEN n - l_orderkey % 4 < 3 THEN 'warn_short' ELSE 'pass' END AS status FROM t""")
def mask_outcomes(spark, sf_dir):
    """Sequences cut at every place from the first on, so that each outcome occurs, a mask that hides nothing too."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_partkey").cast("int"))).alias("ids"))
    labels = masking.masked(F.col("ids"), (F.col("l_orderkey") % 4).cast("int"))
    return rows.select("l_orderkey", masking.status(labels, 3).alias("status"))


@query("""WITH i AS (SELECT c_custkey AS id, unnest(range(c_custkey % 4)) AS i FROM customer)
  SELECT id, 'pipeline/items/' || i || '/name' AS path, 'type' AS keyword FROM i WHERE (id + i) % 2 = 0
  UNION ALL SELECT id, 'pipeline/items/' || i, 'additionalProperties' FROM i WHERE (id + i) % 3 = 0
  UNION ALL SELECT id, 'pipeline/items/' || i || '/sources/0/type', unnest(['type', 'enum']) FROM i WHERE (id + i) % 5 = 0""")
def violations_in_items(spark, sf_dir):
    """Violations inside items of an array, and inside items of an array of theirs, by their places."""
    k = F.col("c_custkey")
    item = lambda i: F.concat(
        F.lit('{"name":'), F.when((k + i) % 2 == 0, "1").otherwise('"n"'), F.when((k + i) % 3 == 0, ',"other":1').otherwise(""),
        F.lit(',"sources":[{"type":'), F.when((k + i) % 5 == 0, "1").otherwise('"sf_opp"'), F.lit(',"ref":"r"}]}'),
    )
    items = F.when(k % 4 > 0, F.transform(F.sequence(F.lit(0).cast("long"), k % 4 - 1), item)).otherwise(F.array().cast("array<string>"))
    raw = F.concat(F.lit('{"pipeline":{"items":['), F.array_join(items, ","), F.lit("]}}"))
    parsed = table(spark, sf_dir, "customer").select(k.alias("id"), jsonx.parse_strict(raw).alias("brief"))
    found = parsed.select("id", F.explode(violations("brief")).alias("v"))
    return found.where("v.path like 'pipeline/items/%' and v.keyword <> 'required'").select("id", "v.path", "v.keyword")
