"""Registered queries: every operator on the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import jsonx
from docloom.functions.vocab import ACCOUNT_SHAPES, EDGE_CASE_HINTS, EDGE_CASES, SOURCE_MIXES
from docloom.operators import asof, bundle, grounding, knobs, lints, masking, metrics, monitor, records, selection
from docloom.operators.validate import violations
from docloom.plans import checks, files, report, variants  # noqa: F401  (checks, files and variants register queries of their own)
from docloom.plans.registry import QUERIES, SQL, query
from docloom.plans.synth import EXPECTED_SQL, briefs, table

EXPECTED = f"WITH {EXPECTED_SQL} "


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.score(briefs(spark, sf_dir))


# ---- scoring and reports -------------------------------------------------------------------------------------------


@query(EXPECTED + "SELECT id, schema_valid, n_errors FROM sc")
def m1_schema_adherence(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "schema_valid", "n_errors")


@query(EXPECTED + "SELECT id, surface, cov_n, cov_d FROM sc")
def m3_section_coverage(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "surface", "cov_n", "cov_d")


@query(EXPECTED + "SELECT id, CAST(attr_n AS INT) AS attr_n, CAST(attr_d AS INT) AS attr_d FROM sc")
def m5_source_attribution(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "attr_n", "attr_d")


@query(EXPECTED + """SELECT v.path, v.keyword, count(*) AS n FROM b, (VALUES (11, 'executive_summary', 'type'), (17, 'confidence/overall', 'enum'),
  (19, 'account', 'additionalProperties'), (23, 'pipeline/total_active_mrr', 'type'), (29, 'talking_points', 'maxItems'), (31, 'sources_used', 'uniqueItems'),
  (37, 'support_health/open_cases_count', 'minimum'), (41, '', 'required'), (43, 'confidence/per_section/pipeline', 'enum')) v(m, path, keyword)
  WHERE NOT bad AND k % v.m = 0 GROUP BY 1, 2""")
def violations_by_keyword(spark, sf_dir):
    found = briefs(spark, sf_dir).withColumn("v", jsonx.parse_strict(F.col("raw"))).select(F.explode(violations("v")).alias("x"))
    return found.groupBy("x.path", "x.keyword").agg(F.count("*").alias("n"))


_REPORT = """SELECT coalesce(surface, 'OVERALL') AS surface, count(*) AS n, CAST(sum(CASE WHEN schema_valid THEN 1 ELSE 0 END) AS BIGINT) AS n_valid,
  CAST(sum(cov_n) AS BIGINT) AS cov_n, CAST(sum(cov_d) AS BIGINT) AS cov_d, CAST(sum(attr_n) AS BIGINT) AS attr_n, CAST(sum(attr_d) AS BIGINT) AS attr_d,
  round(100.0 * sum(CASE WHEN schema_valid THEN 1 ELSE 0 END) / count(*), 6)::DOUBLE AS m1,
  round(CASE WHEN sum(cov_d) <> 0 THEN 100.0 * sum(cov_n) / sum(cov_d) END, 6)::DOUBLE AS m3,
  round(CASE WHEN sum(attr_d) <> 0 THEN 100.0 * sum(attr_n) / sum(attr_d) END, 6)::DOUBLE AS m5 FROM {rows} GROUP BY ROLLUP (surface)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("m1", "m3", "m5")})


@query(EXPECTED + _REPORT.format(rows="sc"))
def report_rollup(spark, sf_dir):
    return _rounded(report.report(scored(spark, sf_dir))).drop("gate_passed")


def _eval_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders, and three times the number of every labelled document: some have no brief, some are listed twice."""
    name = lambda c: F.concat(F.lit("brief-"), c.cast("string")).alias("id")
    buyers = table(spark, sf_dir, "orders").select(name(F.col("o_custkey"))).distinct()
    return buyers.unionByName(table(spark, sf_dir, "labels").select(name(F.col("doc_id") * 3)))


_IDS = "ids AS (SELECT DISTINCT 'brief-' || o_custkey AS id FROM orders UNION ALL SELECT 'brief-' || doc_id * 3 FROM labels)"


@query(f"WITH {EXPECTED_SQL}, {_IDS}, j AS (SELECT coalesce(surface, '?') AS surface, coalesce(schema_valid, false) AS schema_valid, coalesce(cov_n, 0) AS cov_n, "
       "coalesce(cov_d, 1) AS cov_d, coalesce(attr_n, 0) AS attr_n, coalesce(attr_d, 0) AS attr_d FROM ids LEFT JOIN sc USING (id)) " + _REPORT.format(rows="j"))  # fmt: skip
def report_missing_counted(spark, sf_dir):
    joined = report.join_predictions(_eval_ids(spark, sf_dir), scored(spark, sf_dir), missing="count")
    return _rounded(report.report(joined)).drop("gate_passed")


@query(f"WITH {EXPECTED_SQL}, {_IDS} SELECT count(*) AS n, CAST(sum(CASE WHEN schema_valid THEN 1 ELSE 0 END) AS BIGINT) AS n_valid FROM ids JOIN sc USING (id)")
def report_missing_dropped(spark, sf_dir):
    joined = report.join_predictions(_eval_ids(spark, sf_dir), scored(spark, sf_dir))
    return joined.agg(F.count("*").alias("n"), F.count_if("schema_valid").alias("n_valid"))


@query(f"WITH {EXPECTED_SQL}, {_IDS} SELECT id FROM ids WHERE id NOT IN (SELECT id FROM sc)")
def missing_predictions(spark, sf_dir):
    return report.missing_ids(_eval_ids(spark, sf_dir), briefs(spark, sf_dir))


@query(EXPECTED + """, t AS (SELECT 100.0 * sum(CASE WHEN schema_valid THEN 1 ELSE 0 END) / count(*) AS m1, 100.0 * sum(cov_n) / sum(cov_d) AS m3,
  100.0 * sum(attr_n) / sum(attr_d) AS m5 FROM sc) SELECT m1 >= 95 AS m1_ok, m3 >= 90 AS m3_ok, m5 >= 80 AS m5_ok, m1 >= 95 AND m3 >= 90 AND m5 >= 80 AS gate_passed FROM t""")  # fmt: skip
def quality_gate(spark, sf_dir):
    total = report.report(scored(spark, sf_dir)).where(F.col("surface") == report.OVERALL)
    return total.select(*[metrics.meets(F.col(m), m).alias(f"{m}_ok") for m in ("m1", "m3", "m5")], "gate_passed")


@query(EXPECTED + "SELECT id FROM sc WHERE NOT schema_valid ORDER BY id LIMIT 5")
def first_failures(spark, sf_dir):
    return report.failures(scored(spark, sf_dir)).select("id").limit(5)


# ---- JSON out of text ----------------------------------------------------------------------------------------------


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns inside JSON objects inside noise: fenced, bare, with a second object behind, or cut off."""
    body = F.to_json(F.struct(F.col("text").alias("t"), F.lit("}").alias("brace")))
    n = (F.col("conv_id") + F.col("turn")) % 4
    text = F.when(n == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\ndone"))).when(n == 1, F.concat(F.lit("Result "), body)).when(
        n == 2, F.concat(body, F.lit('{"_meta":{}}'))).otherwise(F.substring(body, F.lit(1), F.length(body) - 1))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", text.alias("raw"), n.alias("n"))


@query("SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 <> 3 THEN length(text) END AS t_chars, CASE WHEN (conv_id + turn) % 4 <> 3 THEN md5(text) END AS t_md5 FROM conversations")
def extract_first_object(spark, sf_dir):
    t = jsonx.get_string(jsonx.first_object(F.col("raw")), "t")
    return _wrapped(spark, sf_dir).select("conv_id", "turn", F.length(t).cast("long").alias("t_chars"), F.md5(t).alias("t_md5"))


@query("SELECT (conv_id + turn) % 4 AS n, count(*) AS rows, CAST(sum(CASE WHEN (conv_id + turn) % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS parsed FROM conversations GROUP BY 1")
def extract_fenced_block(spark, sf_dir):
    """Without a fence the brace in a string ends the block too early, which then doesn't parse."""
    v = jsonx.parse_strict(jsonx.fenced_or_braced(F.col("raw")))
    return _wrapped(spark, sf_dir).groupBy("n").agg(F.count("*").alias("rows"), F.count_if(v.isNotNull()).alias("parsed"))


@query("""SELECT (conv_id + turn) % 4 AS n, CAST(sum(CASE WHEN (conv_id + turn) % 4 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS strict,
  CAST(sum(CASE WHEN (conv_id + turn) % 4 IN (1, 2) THEN 1 ELSE 0 END) AS BIGINT) AS lenient FROM conversations GROUP BY 1""")  # fmt: skip
def parse_strict_or_lenient(spark, sf_dir):
    raw = F.regexp_replace("raw", "^Result ", "")
    return _wrapped(spark, sf_dir).groupBy("n").agg(F.count_if(jsonx.parse_strict(raw).isNotNull()).alias("strict"), F.count_if(F.try_parse_json(raw).isNotNull()).alias("lenient"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_properties(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


# ---- records -------------------------------------------------------------------------------------------------------


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda x: F.struct(x.role.alias("role"), x.text.alias("content"))).alias("messages"))


@query("SELECT conv_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE role <> 'assistant' GROUP BY 1")
def messages_without_assistant(spark, sf_dir):
    kept = _messages(spark, sf_dir).select("conv_id", records.without_assistant(F.col("messages")).alias("m")).where(F.size("m") > 0)
    chars = F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + F.length(x.content))
    return kept.select("conv_id", F.size("m").cast("long").alias("n"), chars.alias("chars"))


@query("""SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS text_md5 FROM conversations GROUP BY 1""")
def chat_text(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", F.md5(records.chat_text(F.col("messages"))).alias("text_md5"))


@query("SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY 1")
def last_assistant_turn(spark, sf_dir):
    return records.last_turn(table(spark, sf_dir, "conversations"))


_PROMPT_SQL = "'Generate one synthetic example with these parameters:' || chr(10) || chr(10) || '- surface: ' || surf || chr(10) || '- account_shape: enterprise_expanding' || chr(10) || '- source_mix: rich'"


# The assistant's message: keys by name, no blanks, no _meta.
_BODY_SQL = """'{"account":{"industry":"' || c_mktsegment || '","name":"' || c_name || '"' || CASE WHEN k % 19 = 0 THEN ',"tier":1' ELSE '' END
  || '},"carryover":"' || CASE WHEN k % 5 = 0 THEN 'left over' ELSE '  ' END || '","confidence":{"overall":"' || CASE WHEN k % 17 = 0 THEN 'sure' ELSE 'high' END || '"'
  || CASE WHEN k % 43 = 0 THEN ',"per_section":{"pipeline":"sure","renewal":"low"}' ELSE '' END || '},"empty_sections":["timeline"' || CASE WHEN k % 2 = 0 THEN ',"landmines"' ELSE '' END
  || '],"executive_summary":' || CASE WHEN k % 11 = 0 THEN 'null' ELSE '"S"' END || CASE WHEN k % 41 = 0 THEN '' ELSE ',"generated_at":"2026-01-01T00:00:00Z"' END
  || ',"must_address":[' || array_to_string(list_transform(range(k % 3), lambda x: '{"open_in_meeting":"o","topic":"t","urgency":"high","what_happened":"w"}'), ',')
  || '],"pipeline":{"items":[' || coalesce(items, '') || ']' || CASE WHEN k % 23 = 0 THEN ',"total_active_mrr":210000' ELSE '' END
  || '},"sources_used":["sf_opp"' || CASE WHEN k % 31 = 0 THEN ',"sf_opp"' ELSE '' END || '],"support_health":{"items":[],"open_cases_count":' || CASE WHEN k % 37 = 0 THEN '-1' ELSE '2' END
  || '},"surface":"' || surf || '","talking_points":[' || CASE WHEN k % 29 = 0 THEN '"a","b","c","d","e","f"' WHEN k % 4 = 1 THEN '"a"' ELSE '' END || ']}'"""
_ITEMS_SQL = """(SELECT o_custkey, string_agg('{"amount":' || CASE WHEN o_orderkey % 17 = 0 THEN 'null' ELSE '"$' || o_orderkey || '"' END || ',"name":"Order ' || o_orderkey || '"'
  || CASE WHEN o_orderkey % 3 = 0 THEN ',"sources":[{"ref":"' || o_orderkey || '","type":"sf_opp"}]' ELSE '' END || ',"stage":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) AS items FROM orders GROUP BY 1)"""


@query(EXPECTED + f"""SELECT 'brief-' || k AS id, surf AS surface, 3 AS n_messages, md5({_PROMPT_SQL}) AS prompt_md5, CAST(n AS INT) AS n_items, false AS has_meta, md5({_BODY_SQL}) AS body_md5
  FROM b JOIN customer ON c_custkey = k LEFT JOIN {_ITEMS_SQL} i ON o_custkey = k WHERE NOT bad""")  # fmt: skip
def chat_records(spark, sf_dir):
    made = records.chat_records(briefs(spark, sf_dir), "You write briefs.", on_bad="quarantine")
    body = F.col("messages")[2].content
    v = F.try_parse_json(body)
    return made.select(
        "id", "surface", F.size("messages").alias("n_messages"), F.md5(F.col("messages")[1].content).alias("prompt_md5"),
        F.size(jsonx.items(jsonx.get(v, "pipeline", "items"))).alias("n_items"), jsonx.get(v, "_meta").isNotNull().alias("has_meta"), F.md5(body).alias("body_md5"),
    )


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return records.split(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("SELECT doc_id AS id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'eval' ELSE 'train' END AS split FROM documents")
def split_by_ids(spark, sf_dir):
    return _split(spark, sf_dir).select("id", "split")


@query("SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def train_rows_by_group(spark, sf_dir):
    return _split(spark, sf_dir).where("split = 'train'").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT CAST(0 AS BIGINT) AS shared, CAST(0 AS BIGINT) AS lost, count(*) AS total FROM documents")
def split_is_partition(spark, sf_dir):
    docs, ids = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    some, rest = docs.join(ids, "doc_id", "left_semi"), docs.join(ids, "doc_id", "left_anti")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(some.intersect(rest), "shared").crossJoin(count(docs.exceptAll(some.union(rest)), "lost")).crossJoin(count(docs, "total"))


@query("SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 3")
def stratified_split(spark, sf_dir):
    return records.stratified_sample(table(spark, sf_dir, "documents"), ["lang", "source"], 3, key="doc_id").select("lang", "source", "doc_id")


# Descriptions to draw from, some without any shape.
_PHRASES = ("Enterprise_Steady base", "mid-market, multi-deal", "Midmarket quiet", "enterprise growth rich", "small_strategic with_news", "a Strategic one",
            "at-risk and minimal", "hand-off enriched", "P1 outage sf_only", "nothing", "mid_market_active enterprise_steady", "RICH Enterprise")
_PHRASE_SQL = "(ARRAY[" + ", ".join(f"'{p}'" for p in _PHRASES) + f"])[1 + doc_id % {len(_PHRASES)}]"


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (F.col("doc_id") % len(_PHRASES) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", pick.alias("said"))


@query(f"""WITH p AS (SELECT doc_id, lower({_PHRASE_SQL}) AS s FROM documents) SELECT doc_id, CASE WHEN regexp_matches(s, '{"|".join(ACCOUNT_SHAPES)}')
  THEN regexp_extract(s, '({"|".join(ACCOUNT_SHAPES)})', 1) WHEN s LIKE '%mid-market%' OR s LIKE '%midmarket%' THEN
  CASE WHEN s LIKE '%active%' OR s LIKE '%high engagement%' OR s LIKE '%multi-deal%' OR s LIKE '%expanding pipeline%' THEN 'mid_market_active' ELSE 'mid_market_quiet' END
  WHEN s LIKE '%enterprise%' THEN CASE WHEN s LIKE '%expanding%' OR s LIKE '%expansion%' OR s LIKE '%growth%' THEN 'enterprise_expanding' ELSE 'enterprise_steady' END
  WHEN s LIKE '%small%' OR s LIKE '%strategic%' THEN 'small_strategic' WHEN s LIKE '%stalled%' OR s LIKE '%at risk%' OR s LIKE '%at-risk%' THEN 'stalled_at_risk'
  WHEN s LIKE '%handoff%' OR s LIKE '%hand-off%' THEN 'fresh_handoff' WHEN s LIKE '%incident%' OR s LIKE '%p1%' THEN 'incident_acute' END AS shape FROM p""")  # fmt: skip
def shape_of_description(spark, sf_dir):
    return _phrases(spark, sf_dir).select("doc_id", records.shape(F.col("said")).alias("shape"))


@query(f"SELECT doc_id, nullif(regexp_extract({_PHRASE_SQL}, '({'|'.join(SOURCE_MIXES)})', 1), '') AS mix FROM documents")
def source_mix_of_description(spark, sf_dir):
    return _phrases(spark, sf_dir).select("doc_id", records.source_mix(F.col("said")).alias("mix"))


_HINT_SQL = "(VALUES " + ", ".join(f"({i}, '{t}', '{h}')" for i, (t, hs) in enumerate(EDGE_CASE_HINTS.items()) for h in hs) + ") h(i, token, hint)"
_ENTRIES = ("SOC2 audit cycle", "soc2 press release", "Marble supplier", "P1 case open", "dc_code typo", "nothing here", "Null who and kanji")


@query(f"""WITH e AS (SELECT doc_id, (ARRAY[{", ".join(f"'{x}'" for x in _ENTRIES)}])[1 + doc_id % 7] AS a, (ARRAY[{", ".join(f"'{x}'" for x in _ENTRIES)}])[1 + (doc_id // 7) % 7] AS b FROM documents),
  one AS (SELECT doc_id, b, (SELECT arg_min(token, i) FROM {_HINT_SQL} WHERE contains(lower(a), hint)) AS first FROM e),
  two AS (SELECT doc_id, first, (SELECT arg_min(token, i) FROM {_HINT_SQL} WHERE contains(lower(b), hint) AND token IS DISTINCT FROM first) AS second FROM one)
  SELECT doc_id, concat_ws(',', first, second) AS found FROM two""")  # fmt: skip
def edge_case_fold(spark, sf_dir):
    texts = F.array(*[F.lit(x) for x in _ENTRIES])
    a, b = F.element_at(texts, (F.col("doc_id") % 7 + 1).cast("int")), F.element_at(texts, (F.floor(F.col("doc_id") / 7) % 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(records.edge_cases(F.array(a, b)), ",").alias("found"))


# ---- generation plans and attempts ---------------------------------------------------------------------------------


def _bits(key: str, n: int) -> str:
    return f"CAST('0x' || substr(md5({key}), 1, 7) AS BIGINT) % {n}"


@query(f"""WITH r AS (SELECT c_custkey AS row FROM customer), m AS (SELECT row, {_bits("'42:' || row || ':shape'", 8)} AS s, {_bits("'42:' || row || ':mix'", 7)} AS x,
  {_bits("'42:' || row || ':n'", 10)} AS t FROM r), e AS (SELECT row, token, row_number() OVER (PARTITION BY row ORDER BY md5('42:' || row || ':' || token)) AS k
  FROM r, (SELECT DISTINCT token FROM {_HINT_SQL}) tokens)
  SELECT m.row AS row, (ARRAY[{", ".join(f"'{s}'" for s in ACCOUNT_SHAPES)}])[1 + s] AS account_shape, (ARRAY[{", ".join(f"'{s}'" for s in SOURCE_MIXES)}, NULL])[1 + x] AS source_mix,
  coalesce((SELECT string_agg(token, ',' ORDER BY k) FROM e WHERE e.row = m.row AND k <= CASE WHEN t < 2 THEN 0 WHEN t < 6 THEN 1 WHEN t < 9 THEN 2 ELSE 3 END), '') AS edge_cases FROM m""")  # fmt: skip
def generation_matrix(spark, sf_dir):
    """A row of parameters for every customer."""
    made = knobs.matrix(spark, "qbr", 0, rows=table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row")))
    return made.select("row", "account_shape", "source_mix", F.array_join("edge_cases", ",").alias("edge_cases"))


@query("SELECT c_custkey % 200 AS count, round(c_custkey % 200 * 0.1404, 6)::DOUBLE AS cost, c_custkey % 200 * 0.1404 > 20 AS over_cap FROM customer")
def generation_cost(spark, sf_dir):
    n = F.col("c_custkey") % 200
    return table(spark, sf_dir, "customer").select(n.alias("count"), F.round(knobs.cost(n), 6).alias("cost"), knobs.over_cap(n).alias("over_cap"))


@query("SELECT greatest((SELECT max(c_custkey) FROM customer), (SELECT max(n_nationkey) FROM nation)) + 1 AS next_id")
def next_example_id(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(knobs.id_name(F.col("c_custkey")).alias("name"))
    more = table(spark, sf_dir, "nation").select(knobs.id_name(F.col("n_nationkey")).alias("name"))
    return knobs.next_id(names.unionByName(more))


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in order of time are attempts: purchases succeed, errors of the API are those with event_id % 11 = 0."""
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    outcome = F.when(F.col("event_id") % 11 == 0, "api").when(F.col("event_type") == "purchase", "ok").otherwise("schema")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("row"), order.alias("attempt"), outcome.alias("outcome"))


_ATTEMPTS = """a AS (SELECT user_id AS row, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt,
  CASE WHEN event_id % 11 = 0 THEN 'api' WHEN event_type = 'purchase' THEN 'ok' ELSE 'schema' END AS outcome FROM events),
  f AS (SELECT row, min(attempt) FILTER (outcome IN ('ok', 'api')) AS stop, max(attempt) AS last, min(attempt) FILTER (outcome = 'ok') AS good FROM a WHERE attempt <= 3 GROUP BY row),
  r AS (SELECT row, coalesce(stop, last) AS attempts, CASE WHEN good = stop THEN good END AS good_attempt, coalesce(good = stop, false) AS success FROM f)"""


@query(f"WITH {_ATTEMPTS} SELECT row, CAST(attempts AS INT) AS attempts, CAST(good_attempt AS INT) AS good_attempt, success FROM r")
def attempts_resolved(spark, sf_dir):
    return knobs.resolve(_attempts(spark, sf_dir)).select("row", "attempts", "good_attempt", "success")


@query(f"WITH {_ATTEMPTS} SELECT row, CAST(CASE WHEN success THEN 9 + sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (ORDER BY row ROWS UNBOUNDED PRECEDING) - 1 END AS BIGINT) AS example_id FROM r")
def running_example_ids(spark, sf_dir):
    return knobs.running_ids(knobs.resolve(_attempts(spark, sf_dir)), 9).select("row", "example_id")


@query(f"WITH {_ATTEMPTS} SELECT CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS good, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) AS BIGINT) AS failed, CAST(sum(attempts) AS BIGINT) AS attempts FROM r")
def run_totals(spark, sf_dir):
    return knobs.run_summary(knobs.resolve(_attempts(spark, sf_dir)))


@query("SELECT n, count(*) AS rows, min(outcome) AS outcome FROM (SELECT (conv_id + turn) % 4 AS n, CASE (conv_id + turn) % 4 WHEN 0 THEN 'schema' WHEN 3 THEN 'parse' ELSE 'parse' END AS outcome FROM conversations) GROUP BY 1")
def attempt_outcomes(spark, sf_dir):
    tries = _wrapped(spark, sf_dir).select("n", "raw", F.lit(None).cast("string").alias("api_error"))
    return knobs.judged(tries).groupBy("n").agg(F.count("*").alias("rows"), F.min("outcome").alias("outcome"))


@query("""WITH c AS (SELECT conv_id, min(turn) AS t0, count(*) AS k FROM conversations GROUP BY 1) SELECT conv_id AS row, 1 + 2 * least(k, 3) AS n_messages FROM c""")
def retry_conversations(spark, sf_dir):
    turn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    tries = _wrapped(spark, sf_dir).select(F.col("conv_id").alias("row"), turn.alias("attempt"), "raw", F.lit(None).cast("string").alias("api_error"))
    prompts = tries.select("row").distinct().withColumn("prompt", F.lit("go"))
    return knobs.conversations(tries, prompts).select("row", F.size("messages").cast("long").alias("n_messages"))


# ---- masks ---------------------------------------------------------------------------------------------------------


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of an order: the start token 7 where the part's number is a multiple of 3, else its rest by 6."""
    token = F.when(F.col("l_partkey") % 3 == 0, 7).otherwise(F.col("l_partkey") % 6).cast("int")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("p"), token.alias("t")))).alias("x"))
    return rows.select("l_orderkey", F.transform("x", lambda e: e.t).alias("ids"))


_TOKENS = """t AS (SELECT l_orderkey, list(CASE WHEN l_partkey % 3 = 0 THEN 7 ELSE l_partkey % 6 END ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY 1),
  c AS (SELECT l_orderkey, ids, list_max([p + 1 + CASE WHEN p + 1 < len(ids) AND ids[p + 2] = 5 THEN 1 ELSE 0 END for p in range(1, len(ids) - 1) if ids[p] = 7 AND ids[p + 1] = 1]) AS cut FROM t)"""


@query(f"WITH {_TOKENS} SELECT l_orderkey, CAST(cut AS INT) AS cut, CAST(CASE WHEN cut IS NULL THEN len(ids) ELSE cut END AS INT) AS n_masked, CAST(len(ids) AS INT) AS n FROM c")
def mask_cutoff(spark, sf_dir):
    found = _tokens(spark, sf_dir).withColumn("cut", masking.cutoff(F.col("ids"), 7, [1], 5))
    labels = masking.masked(F.col("ids"), F.col("cut"))
    return found.select("l_orderkey", "cut", masking.n_masked(labels).alias("n_masked"), F.size("ids").alias("n"))


@query(f"WITH {_TOKENS} SELECT CASE WHEN cut IS NULL OR cut >= len(ids) THEN 'fail_all_masked' WHEN len(ids) - cut < 3 THEN 'warn_short' ELSE 'pass' END AS status, count(*) AS n FROM c GROUP BY 1")
def mask_status(spark, sf_dir):
    found = _tokens(spark, sf_dir).withColumn("labels", masking.masked(F.col("ids"), masking.cutoff(F.col("ids"), 7, [1], 5)))
    return found.groupBy(masking.status(F.col("labels"), 3).alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {_TOKENS} SELECT l_orderkey, array_to_string(ids[greatest(cut + 1 - 2, 1) : cut + 2], ',') AS around, array_to_string(ids[greatest(len(ids) - 2, 1) : len(ids)], ',') AS tail FROM c WHERE cut < len(ids)")
def mask_boundary(spark, sf_dir):
    found = _tokens(spark, sf_dir).withColumn("labels", masking.masked(F.col("ids"), masking.cutoff(F.col("ids"), 7, [1], 5)))
    around, end = masking.boundary(F.col("ids"), F.col("labels"), 2), masking.tail(F.col("ids"), F.col("labels"), 2)
    return found.select("l_orderkey", F.array_join(around, ",").alias("around"), F.array_join(end, ",").alias("tail")).where("around is not null")


# ---- step logs -----------------------------------------------------------------------------------------------------


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = F.when(F.col("event_id") % 4 == 0, F.col("value"))
    return table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("run"), F.floor(F.col("event_id") / 50).alias("step"), loss.alias("loss"), F.col("value").alias("peak_alloc_gb"))


_LOG = "l AS (SELECT event_id % 50 AS run, event_id // 50 AS step, CASE WHEN event_id % 4 = 0 THEN value END AS loss, value FROM events)"


@query(f"""WITH {_LOG}, c AS (SELECT *, last_value(loss IGNORE NULLS) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS last_loss,
  max(value) OVER (PARTITION BY run, CAST(ceil(step / 5.0) AS BIGINT)) AS tick_peak FROM l) SELECT run, step, last_loss, tick_peak FROM c WHERE step <> 0 AND step % 5 = 0""")  # fmt: skip
def step_ticks(spark, sf_dir):
    return monitor.ticks(_log(spark, sf_dir), run="run").select("run", "step", "last_loss", "tick_peak")


@query(f"WITH {_LOG} SELECT run, step FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS r FROM l WHERE step % 10 = 0) WHERE r <= 4")
def newest_checkpoints(spark, sf_dir):
    return monitor.newest(_log(spark, sf_dir).where("step % 10 = 0"), 4, "run").select("run", "step")


@query("""WITH m AS (SELECT event_type AS metric, user_id % 20 AS checkpoint, round(avg(value), 6) AS value FROM events GROUP BY 1, 2)
  SELECT metric, checkpoint, coalesce(value - lag(value) OVER (PARTITION BY metric ORDER BY checkpoint) < -2, false) AS regressed FROM m""")
def metric_regressions(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 20).alias("checkpoint")).agg(F.round(F.avg("value"), 6).alias("value"))
    return monitor.regressions(m).select("metric", "checkpoint", "regressed")


# ---- grounding -----------------------------------------------------------------------------------------------------


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is cited; the inputs hold those with a line of more than 40 pieces."""
    tier = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("o_custkey") % 3 + 1).cast("int"))
    refs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ref"), tier.alias("confidence"))
    held = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("ref")).distinct()
    return refs.join(held.withColumn("g", F.lit(True)), "ref", "left").withColumn("grounded", F.coalesce("g", F.lit(False))).drop("g")


_CLAIMS = """c AS (SELECT o_custkey AS id, o_orderkey AS ref, (ARRAY['high', 'medium', 'low'])[1 + o_custkey % 3] AS confidence,
  o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) AS grounded FROM orders)"""


@query(f"WITH {_CLAIMS} SELECT id, ref FROM c WHERE NOT grounded")
def ungrounded_claims(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ref"))
    inputs = orders.join(table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("ref")), "ref", "left_semi")
    return grounding.ungrounded(orders, inputs)


@query(f"WITH {_CLAIMS} SELECT confidence, count(*) AS n, CAST(sum(CASE WHEN grounded THEN 0 ELSE 1 END) AS BIGINT) AS n_bad, round(100.0 * sum(CASE WHEN grounded THEN 0 ELSE 1 END) / count(*), 6)::DOUBLE AS rate FROM c GROUP BY 1")
def hallucination_by_tier(spark, sf_dir):
    return grounding.hallucination(_claims(spark, sf_dir), ["confidence"]).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {_CLAIMS}, r AS (SELECT confidence, 100.0 * sum(CASE WHEN grounded THEN 0 ELSE 1 END) / count(*) AS rate FROM c GROUP BY 1)
  SELECT confidence, CASE confidence WHEN 'high' THEN rate < 1 WHEN 'medium' THEN rate BETWEEN 1 AND 5 ELSE rate > 5 END AS in_band,
  (SELECT max(rate) FILTER (confidence = 'high') < max(rate) FILTER (confidence = 'medium') AND max(rate) FILTER (confidence = 'medium') < max(rate) FILTER (confidence = 'low') FROM r) AS monotonic FROM r""")  # fmt: skip
def calibration(spark, sf_dir):
    rates = grounding.hallucination(_claims(spark, sf_dir), ["confidence"])
    return rates.select("confidence", grounding.in_band(F.col("confidence"), F.col("rate")).alias("in_band")).crossJoin(grounding.monotonic(rates))


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    found = grounding.latency(table(spark, sf_dir, "events"), "value", ["event_type"])
    return found.withColumns({c: F.round(c, 6) for c in ("p50", "p95")})


@query("""SELECT coalesce(l_returnflag, 'all') AS flag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95,
  round(quantile_cont(l_quantity::DOUBLE, 0.5), 6) AS q50, round(quantile_cont(l_quantity::DOUBLE, 0.95), 6) AS q95 FROM lineitem GROUP BY ROLLUP (l_returnflag)""")  # fmt: skip
def percentiles_of_large_groups(spark, sf_dir):
    """Groups larger than a task may hold, one of them the whole table; prices with few ties and quantities with very many."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    flags = lines.select(F.explode(F.array(F.coalesce("l_returnflag", F.lit("all")), F.lit("all"))).alias("flag"), "l_extendedprice", "l_quantity")
    price, pieces = (grounding.latency(flags, c, ["flag"], task_rows=2_000) for c in ("l_extendedprice", "l_quantity"))
    names = {"p50": "q50", "p95": "q95"}
    return price.join(pieces.drop("n").withColumnsRenamed(names), "flag").select("flag", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "q50", "q95")])


@query("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT *, sum(n) OVER () AS all_n, floor(n * least(50, sum(n) OVER ()) / sum(n) OVER ()) AS base FROM c),
  q AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY round(n * least(50, all_n) / all_n - base, 9) DESC, lang NULLS FIRST, source NULLS FIRST) <= least(50, all_n) - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM t)
  SELECT doc_id, d.lang, d.source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents) d
  JOIN q ON d.lang IS NOT DISTINCT FROM q.lang AND d.source IS NOT DISTINCT FROM q.source WHERE r <= quota""")  # fmt: skip
def held_out_fifty(spark, sf_dir):
    return selection.held_out(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", ["lang", "source"])


@query("SELECT event_type, round(avg(1 + user_id % 5), 6) AS mean, avg(1 + user_id % 5) >= 3 AS passed FROM events GROUP BY 1")
def style_scores(spark, sf_dir):
    found = table(spark, sf_dir, "events").withColumn("score", 1 + F.col("user_id") % 5)
    return grounding.style(found, ["event_type"], 3.0).withColumn("mean", F.round("mean", 6))


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 2 = 0 AND p_size <= 25 THEN 'true_empty' WHEN p_partkey % 2 = 0 THEN 'false_empty'
  WHEN p_partkey % 5 = 0 AND p_size <= 25 THEN 'hidden_empty' WHEN p_partkey % 5 = 0 THEN 'missed' ELSE 'filled' END AS kind FROM part) GROUP BY 1""")
def empty_section_classes(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 2 == 0).alias("declared_empty"), (F.col("p_size") > 25).alias("has_signal"), (F.col("p_partkey") % 5 != 0).alias("populated"))
    return grounding.empties(rows).groupBy("kind").agg(F.count("*").alias("n"))


# ---- bundles -------------------------------------------------------------------------------------------------------


def _billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts, makers = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    period = F.concat(F.year("l_shipdate").cast("string"), F.lit("Q"), F.quarter("l_shipdate").cast("string"))
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey).join(makers, lines.l_suppkey == makers.s_suppkey)
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return joined.groupBy(period.alias("period"), F.col("p_brand").alias("product_line"), F.col("s_nationkey").alias("dc_code")).agg(F.sum(cents).alias("mrc_usd"), F.sum("l_linenumber").alias("nrc_usd"))


_BILLING = """g AS (SELECT year(l_shipdate) || 'Q' || quarter(l_shipdate) AS period, p_brand AS product_line, s_nationkey AS dc_code,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS mrc_usd, CAST(sum(l_linenumber) AS BIGINT) AS nrc_usd
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"""


@query(f"WITH {_BILLING} SELECT period, product_line, dc_code, CAST(sum(mrc_usd) AS BIGINT) AS mrc_usd, CAST(sum(nrc_usd) AS BIGINT) AS nrc_usd, CAST(GROUPING(period, product_line, dc_code) AS BIGINT) AS level FROM g GROUP BY ROLLUP (period, product_line, dc_code)")
def billing_rollup(spark, sf_dir):
    return bundle.billing_rollup(_billing(spark, sf_dir))


@query(f"WITH {_BILLING} SELECT period, product_line, dc_code, mrc_usd - lag(mrc_usd) OVER (PARTITION BY product_line, dc_code ORDER BY period) AS change FROM g")
def billing_change(spark, sf_dir):
    return bundle.period_change(_billing(spark, sf_dir)).select("period", "product_line", "dc_code", "change")


@query("""SELECT k.user_id, k.event_id AS asked, (SELECT max(e.ts) FROM events e WHERE e.user_id = k.user_id AND e.ts < k.ts) AS ts
  FROM events k WHERE k.event_type = 'purchase'""")
def latest_prior(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    keys = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("asked"), F.col("ts").alias("now"))
    return asof.latest_before(events.select("user_id", "ts", "event_id"), keys, "user_id", "ts", "now").select("user_id", "asked", "ts")


_HALF = "CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END"


@query(f"""WITH e AS (SELECT {_HALF} AS user_id, event_id, event_type, ts FROM events) SELECT k.user_id, k.event_id AS asked, e.ts, e.event_id AS prior
  FROM (SELECT * FROM e WHERE event_type = 'purchase') k ASOF LEFT JOIN e ON e.user_id = k.user_id AND k.ts > e.ts""")  # fmt: skip
def latest_prior_skewed(spark, sf_dir):
    """One user has half of the events: the key is merged in chunks of time."""
    events = table(spark, sf_dir, "events").withColumn("user_id", F.expr(_HALF))
    keys = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("asked"), F.col("ts").alias("now"))
    found = asof.latest_before(events.select("user_id", "ts", F.col("event_id").alias("prior")), keys, "user_id", "ts", "now", chunk_rows=1_000)
    return found.select("user_id", "asked", "ts", "prior")


@query("SELECT s_nationkey AS dc_code FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY 1")
def unknown_dc_codes(spark, sf_dir):
    known = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("dc_code"))
    return bundle.unknown_codes(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("dc_code")), known)


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS first_seen FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_contacts(spark, sf_dir):
    return bundle.duplicates(table(spark, sf_dir, "customer").withColumn("seen", F.col("c_custkey")), ["c_nationkey", "c_mktsegment"])


@query("""SELECT q_id, vec_id, CAST(rank AS INT) AS rank, round(s, 5) AS similarity FROM (SELECT q.vec_id AS q_id, v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS rank
  FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id) WHERE rank <= 5""")  # fmt: skip
def top_similar_every_50th(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    return bundle.top_similar(vectors, asked).select("q_id", "vec_id", "rank", F.round("similarity", 5).alias("similarity"))


@query("""SELECT o_orderkey, coalesce(o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AND date_diff('day', o_orderdate::DATE, DATE '1998-06-01') > 30, false) AS open_long,
  coalesce(o_orderstatus = 'F' AND date_diff('day', o_orderdate::DATE, DATE '1998-06-01') BETWEEN 0 AND 900, false) AS lost FROM orders""")  # fmt: skip
def dated_cases(spark, sf_dir):
    """Urgent orders open for long, and finished ones that ended not long ago."""
    day, placed = F.to_date(F.lit("1998-06-01")), F.col("o_orderdate").cast("date")
    long = bundle.open_long(F.col("o_orderpriority"), F.col("o_orderstatus") == "O", placed, day, urgent="1-URGENT")
    return table(spark, sf_dir, "orders").select("o_orderkey", long.alias("open_long"), bundle.lost_recently(F.col("o_orderstatus"), placed, day, 900, "F").alias("lost"))


@query("""WITH c AS (SELECT o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE END AS gone, o_orderkey % 2 = 0 AS main, o_totalprice AS e FROM orders)
  SELECT o_custkey, max(gone) FILTER (main AND date_diff('day', gone, DATE '1998-06-01') BETWEEN 0 AND 400)::VARCHAR AS gone, coalesce(max(e) FILTER (gone IS NULL OR gone > DATE '1998-06-01'), 0) <= 100000 AS low_engagement
  FROM c GROUP BY 1 HAVING max(gone) FILTER (main AND date_diff('day', gone, DATE '1998-06-01') BETWEEN 0 AND 400) IS NOT NULL""")  # fmt: skip
def champions_gone(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate").cast("date")).alias("gone"), (F.col("o_orderkey") % 2 == 0).alias("main"), F.col("o_totalprice").alias("e")
    )
    found = bundle.left_recently(orders, "o_custkey", "gone", "main", F.to_date(F.lit("1998-06-01")), "e", 400, 100_000.0)
    return found.select("o_custkey", F.col("left").cast("string").alias("gone"), "low_engagement")


@query("""SELECT user_id AS row, CASE WHEN count(*) FILTER (event_id % 7 = 0) = 0 THEN round(epoch(max(ts)) + max_by(value, ts) - epoch(min(ts)), 3) END AS elapsed_s, '20260131-235959' AS run FROM
  (SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 1 END AS done FROM events) GROUP BY 1""")  # fmt: skip
def run_times(spark, sf_dir):
    """Events as attempts that end after ``value`` seconds; some have no end."""
    began = F.unix_micros(F.to_timestamp(F.col("ts").cast("string"))) / 1e6
    ended = F.when(F.col("event_id") % 7 != 0, began + F.when(F.col("ts") == F.max("ts").over(Window.partitionBy("user_id")), F.col("value")).otherwise(0.0))
    times = knobs.elapsed(table(spark, sf_dir, "events").select(F.col("user_id").alias("row"), began.alias("began"), ended.alias("ended")), "began", "ended")
    return knobs.stamped(times.select("row", F.round("elapsed_s", 3).alias("elapsed_s")), 1769903999.0)


@query("""SELECT c_custkey, count(o_orderkey) AS n_orders, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def account_bundle(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("c_custkey", F.col("o_custkey"))
    made = bundle.attach(table(spark, sf_dir, "customer"), orders, "c_custkey", "orders", ["o_orderkey", "o_orderstatus"], "o_orderkey")
    return made.select("c_custkey", F.size("orders").cast("long").alias("n_orders"), F.try_element_at("orders", F.lit(1)).o_orderkey.alias("first_order"))


@query("""WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id + 1 END AS user_id, event_id, event_type FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM e)
  SELECT user_id, max(n) AS n_events, string_agg(event_id || ':' || event_type, ',' ORDER BY event_id) AS events FROM r WHERE r <= 4 GROUP BY 1""")
def account_bundle_skewed(spark, sf_dir):
    """One account holds a third of all rows: its first rows and its count are told without a list of them all."""
    user = F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id") + 1).alias("user_id")
    rows = table(spark, sf_dir, "events").select(user, "event_id", "event_type")
    made = bundle.attach(rows.select("user_id").distinct(), rows, "user_id", "events", ["event_type"], "event_id", most=4)
    shown = F.transform("events", lambda e: F.concat_ws(":", e.event_id.cast("string"), e.event_type))
    return made.select("user_id", "n_events", F.array_join(shown, ",").alias("events"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 90 DAY")
def open_or_recent(spark, sf_dir):
    as_of = F.lit("1998-01-01").cast("date")
    return table(spark, sf_dir, "orders").where(bundle.live_or_recent(F.col("o_orderstatus") == "O", F.col("o_orderdate"), as_of)).select("o_orderkey")


@query("""WITH x AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END, o_orderkey) AS r FROM orders)
  SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY r) AS ranked FROM x WHERE r <= 3 GROUP BY 1""")  # fmt: skip
def urgency_ranking(spark, sf_dir):
    urgency = F.element_at(F.array(*[F.lit(u) for u in bundle.URGENCY]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    top = bundle.top_rows(table(spark, sf_dir, "orders"), "o_custkey", [bundle.urgency_rank(urgency), "o_orderkey"], 3)
    return _listed(top, "ranked")


def _listed(top: DataFrame, name: str) -> DataFrame:
    keys = F.transform(F.sort_array(F.collect_list(F.struct("rank", "o_orderkey"))), lambda x: x.o_orderkey.cast("string"))
    return top.groupBy("o_custkey").agg(F.array_join(keys, ",").alias(name))


@query("""SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate DESC, o_orderkey DESC) AS newest FROM
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 5 GROUP BY 1""")
def newest_entries(spark, sf_dir):
    return _listed(bundle.top_rows(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 5), "newest")


@query("""SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END, o_orderkey) AS ranked FROM orders GROUP BY 1""")
def urgency_in_lists(spark, sf_dir):
    """The same order within the list of a document."""
    urgency = F.element_at(F.array(*[F.lit(u) for u in bundle.URGENCY]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", urgency.alias("urgency")))).alias("e"))
    return lists.select("o_custkey", F.array_join(F.transform(bundle.ranked_by_urgency(F.col("e")), lambda x: x.o_orderkey.cast("string")), ",").alias("ranked"))


@query(f"""WITH e AS (SELECT doc_id, token FROM documents, (SELECT DISTINCT i, token FROM {_HINT_SQL}) WHERE (doc_id + i) % 9 = 0)
  SELECT token AS edge_case, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 6)::DOUBLE AS share FROM e GROUP BY 1""")
def edge_case_shares(spark, sf_dir):
    cases = F.array_compact(F.array(*[F.when((F.col("doc_id") + i) % 9 == 0, t) for i, t in enumerate(EDGE_CASES)]))
    return bundle.edge_case_share(table(spark, sf_dir, "documents").select(cases.alias("edge_cases"))).withColumn("share", F.round("share", 6))


@query("SELECT c_mktsegment AS surface, c_nationkey AS account_shape, CAST(GROUPING(c_mktsegment, c_nationkey) AS BIGINT) AS level, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def coverage_matrix(spark, sf_dir):
    return bundle.coverage_matrix(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("surface"), F.col("c_nationkey").alias("account_shape")))


@query("""SELECT user_id, count(*) AS n, round(avg(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END), 6) AS null_share FROM events
  WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 45 DAY AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1 HAVING count(*) >= 5""")  # fmt: skip
def activity_volume(spark, sf_dir):
    contact = F.when(F.col("event_type") != "click", F.col("event_type"))
    found = bundle.activity_volume(table(spark, sf_dir, "events"), "user_id", F.col("ts"), contact, F.lit("2024-01-20").cast("date"), least=5)
    return found.withColumn("null_share", F.round("null_share", 6))


@query("""SELECT n_regionkey, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS open_total, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")  # fmt: skip
def open_totals(spark, sf_dir):
    orders, customers, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    found = bundle.open_sums(j, "n_regionkey", F.col("o_orderstatus") == "O", F.col("o_totalprice"), F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus"))
    return found.select("n_regionkey", F.round("open_total", 2).alias("open_total"), "urgent", F.array_join("kinds", ",").alias("states"))


@query("""WITH l AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS inline, CASE WHEN l_orderkey % 2 = 0 THEN ['A', 'N'] ELSE ['R'] END AS used FROM lineitem GROUP BY 1)
  SELECT l_orderkey, coalesce(array_to_string([x for x in inline if NOT list_contains(used, x)], ','), '') AS unlisted, coalesce(array_to_string([x for x in used if NOT list_contains(inline, x)], ','), '') AS uncited FROM l""")  # fmt: skip
def source_type_gaps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("inline"))
    used = F.when(F.col("l_orderkey") % 2 == 0, F.array(F.lit("A"), F.lit("N"))).otherwise(F.array(F.lit("R")))
    a, b = grounding.source_type_gaps(F.col("inline"), used)
    return rows.select("l_orderkey", F.array_join(a, ",").alias("unlisted"), F.array_join(b, ",").alias("uncited"))


# ---- lints ---------------------------------------------------------------------------------------------------------


@query(r"""SELECT c_custkey, regexp_matches(c_custkey::VARCHAR, '^[1-9]\d{3,5}$') AS cid_ok, regexp_matches(lpad(c_custkey::VARCHAR, 8, '0'), '^\d{8}$') AS case_ok,
  (CAST(c_custkey AS BIGINT) * 500) % 10000 <> 0 AS amount_ok, regexp_matches('a.b' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '@x.com' END, '^[^@\s.]+\.[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$') AS email_ok FROM customer""")
def lints_identifiers(spark, sf_dir):
    k = F.col("c_custkey")
    mail = F.concat(F.lit("a.b"), k.cast("string"), F.when(k % 3 == 0, "").otherwise("@x.com"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", lints.customer_id(k.cast("string")).alias("cid_ok"), lints.case_number(F.lpad(k.cast("string"), 8, "0")).alias("case_ok"),
        lints.messy_amount(k * 500).alias("amount_ok"), lints.email(mail).alias("email_ok"),
    )


@query(r"""SELECT doc_id, length(text) <= 200 AS snippet_ok, NOT regexp_matches(lower(text), 'robust|comprehensive|industry-leading|cutting-edge|synergy|alignment opportunity|as we discussed|circling back|touch base') AS phrases_ok,
  NOT regexp_matches(text, 'https?://') AS no_url FROM documents""")
def lints_texts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", lints.snippet_fits(t).alias("snippet_ok"), lints.no_forbidden_phrase(t).alias("phrases_ok"), lints.no_url(t).alias("no_url"))


@query("""SELECT page_id, split_part(split_part(url, '/', 3), ':', 1) AS host, regexp_matches(url, '^https://') AS secure FROM pages""")
def page_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", bundle.host(F.col("url")).alias("host"), F.col("url").rlike("^https://").alias("secure"))


# ---- plans, diagnostics ----------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, right(text, 90) AS tail, CAST(length(text) AS INT) AS chars FROM conversations")
def tail_diagnostics(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", masking.text_tail(F.col("text")).alias("t")).select("conv_id", "turn", "t.tail", "t.chars")


@query(f"WITH {_TOKENS} SELECT l_orderkey, array_to_string(ids[1:3], ',') AS ids FROM t")
def truncated_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("l_orderkey", F.array_join(masking.truncated(F.col("ids"), 3), ",").alias("ids"))


@query(EXPECTED + """SELECT surf AS surface, count(*) AS made, CAST(CASE surf WHEN 'meeting_prep' THEN 60 WHEN 'qbr' THEN 100 WHEN 'handoff' THEN 100 WHEN 'renewal_alert' THEN 100
  WHEN 'onboarding' THEN 100 WHEN 'escalation' THEN 100 END AS INT) AS planned FROM b WHERE NOT bad GROUP BY 1""")  # fmt: skip
def batch_plan(spark, sf_dir):
    """Examples there are of each surface, and how many are planned."""
    made = records.chat_records(briefs(spark, sf_dir), "You write briefs.", on_bad="quarantine")
    return made.groupBy("surface").agg(F.count("*").alias("made")).withColumn("planned", knobs.planned()[F.col("surface")])


@query(EXPECTED + "SELECT surf AS surface, count(*) AS n, CAST(0 AS BIGINT) AS n_warnings FROM b WHERE NOT bad GROUP BY 1")
def record_summary(spark, sf_dir):
    return records.summary(records.chat_records(briefs(spark, sf_dir), "You write briefs.", on_bad="quarantine"))


@query("SELECT c_custkey AS id, 'shape not found' AS warning FROM customer WHERE c_custkey % 3 = 0 ORDER BY c_custkey LIMIT 10")
def record_warnings(spark, sf_dir):
    shape = F.when(F.col("c_custkey") % 3 != 0, "enterprise_steady")
    return records.warnings(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), shape.alias("shape")), 10)


@query("SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 16 AS BIGINT) AS batch FROM customer")
def training_batches(spark, sf_dir):
    return masking.batches(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", chunk=100)


@query(f"""WITH {_LOG}, c AS (SELECT event_id AS step, CASE WHEN event_id % 4 = 0 THEN value END AS loss, value FROM events),
  d AS (SELECT *, last_value(loss IGNORE NULLS) OVER (ORDER BY step ROWS UNBOUNDED PRECEDING) AS last_loss, max(value) OVER (PARTITION BY CAST(ceil(step / 5.0) AS BIGINT), step = 0) AS tick_peak FROM c)
  SELECT step, last_loss, tick_peak FROM d WHERE step <> 0 AND step % 5 = 0""")  # fmt: skip
def step_ticks_of_one_run(spark, sf_dir):
    """One log without runs, in chunks."""
    log = _log(spark, sf_dir).select((F.col("step") * 50 + F.col("run")).alias("step"), "loss", "peak_alloc_gb")
    return monitor.ticks(log, chunk=70)


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), c_name) AS amount FROM customer")
def normalised_amounts(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", bundle.normalised_amount(F.nullif("c_mktsegment", F.lit("BUILDING")), F.col("c_name")).alias("amount"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' - INTERVAL 30 DAY GROUP BY 1")
def recent_activity(spark, sf_dir):
    as_of = F.lit("2024-01-15").cast("date")
    return table(spark, sf_dir, "events").where(bundle.since(F.col("ts"), as_of, 30)).groupBy("event_type").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality report by surface."""
    return report.report(scored(spark, sf_dir))
