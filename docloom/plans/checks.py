"""Registered queries of lints and of claims against their inputs, on texts made from keys so that SQL knows the outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import jsonx, sql
from docloom.functions.vocab import EDGE_CASE_HINTS, HEAVY, TYPICALLY_EMPTY
from docloom.operators import bundle, grounding, lints, matching, metrics
from docloom.plans import report
from docloom.plans.registry import query
from docloom.plans.synth import EXPECTED_SQL, briefs, table


def _customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    return table(spark, sf_dir, "customer"), F.col("c_custkey")


def _pick(k: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (k % len(values) + 1).cast("int"))


@query("""SELECT c_custkey, c_custkey % 7 <> 0 AS account_ok, c_custkey % 4 <> 0 AS quote_ok, c_custkey % 3 < 2 AS time_ok, c_custkey % 4 = 1 AS ref_ok, c_custkey % 5 <> 0 AS topic_ok,
  c_custkey % 7 IN (3, 4, 5) AS must_ok, c_custkey % 6 BETWEEN 2 AND 5 AS empty_ok FROM customer""")  # fmt: skip
def lints_formats(spark, sf_dir):
    rows, k = _customers(spark, sf_dir)
    eight = F.lpad(k.cast("string"), 8, "0")
    return rows.select(
        "c_custkey",
        lints.account_id(F.concat(F.when(k % 7 == 0, "002").otherwise("001"), F.lpad(k.cast("string"), 15, "0"))).alias("account_ok"),
        lints.quote_id(F.concat(F.lit("Q-"), eight, F.lit("-"), F.when(k % 4 == 0, "12").otherwise("123"))).alias("quote_ok"),
        lints.iso_time(F.concat(F.lit("2026-01-01T00:00:00"), _pick(k, "Z", "+01:00", ""))).alias("time_ok"),
        lints.specific_ref(_pick(k, "SF data", "case 123", "CRM ", " data")).alias("ref_ok"),
        lints.concrete_topic(F.when(k % 5 == 0, " [topic]").otherwise("Renewal [draft] 1")).alias("topic_ok"),
        lints.count_between(k % 7, 3, 5).alias("must_ok"), lints.count_between(k % 6, 2, 5).alias("empty_ok"),
    )


@query("""SELECT c_custkey, c_custkey % 3 <> 1 AS quarter_ok, c_custkey % 4 <> 0 AS latin_ok, c_mktsegment IN ('BUILDING', 'MACHINERY') AS names_ok,
  (ARRAY['United States', 'United Kingdom', 'France', 'South Korea'])[1 + c_custkey % 4] AS country, c_custkey % 3 = 1 AS near FROM customer""")
def lints_names(spark, sf_dir):
    rows, k = _customers(spark, sf_dir)
    segments = ["BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"]
    other = F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, F.concat("c_name", F.lit("x"))).otherwise("Zebra house")
    return rows.select(
        "c_custkey", lints.plain_quarter(_pick(k, "Deal Q12025", "Deal Q320255", "Deal Q1 2025")).alias("quarter_ok"),
        lints.latin(F.concat("c_name", _pick(k, " 株式", " Éa ß", " 12.5 %", ""))).alias("latin_ok"),
        lints.only_known(F.concat(F.lit("We sell "), F.lower("c_mktsegment"), F.lit(" things")), segments[:2], segments).alias("names_ok"),
        lints.country(_pick(k, "USA", " uk ", " France", "Korea")).alias("country"), lints.near_names(F.col("c_name"), other).alias("near"),
    )


def _pairs(rows: dict[str, tuple]) -> str:
    return "(VALUES " + ", ".join(f"('{s}', '{x}')" for s, xs in rows.items() for x in xs) + ") t(surface, section)"


_FILLED = "(section = 'must_address' AND must = 1 OR section = 'pipeline' AND pipe = 1 OR section = 'talking_points' AND talk = 1 OR section = 'carryover' AND carry = 1)"


@query(f"""WITH {EXPECTED_SQL} SELECT 'brief-' || k AS id, coalesce((SELECT string_agg(section, ',' ORDER BY section) FROM {_pairs(HEAVY)} WHERE surface = surf AND NOT {_FILLED}), '') AS lacking,
  NOT EXISTS (SELECT 1 FROM {_pairs(TYPICALLY_EMPTY)} WHERE surface = surf AND {_FILLED}) AS honest, false AS emphasis FROM w WHERE NOT bad""")  # fmt: skip
def lints_emphasis(spark, sf_dir):
    """Per brief of any surface: heavy sections that it leaves empty, and whether it fills none that should be empty."""
    v = F.col("v")
    parsed = briefs(spark, sf_dir).withColumn("v", jsonx.parse_strict(F.col("raw"))).where("v is not null")
    made = parsed.select("id", jsonx.get_string(v, "surface").alias("s"), metrics.filled_sections(v).alias("filled"))
    s, filled = F.col("s"), F.col("filled")
    return made.select(
        "id", F.array_join(lints.emphasis_gaps(s, filled), ",").alias("lacking"), lints.honest_empty(s, filled).alias("honest"), lints.emphasis(s, filled).alias("emphasis")
    )


@query("SELECT doc_id AS id FROM documents WHERE length(text) > 30 AND doc_id % 2 = 0")
def phrases_in_inputs(spark, sf_dir):
    """Phrases of every text; those of odd documents end in a sign that no text holds."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 30")
    phrase = F.concat(F.substring("text", 5, 20), F.when(F.col("doc_id") % 2 == 0, "").otherwise("☃"))
    claims, inputs = docs.select(F.col("doc_id").alias("id"), phrase.alias("phrase")), docs.select(F.col("doc_id").alias("id"), "text")
    return grounding.grounded_by_phrase(claims, inputs).select("id")


@query(f"""WITH {EXPECTED_SQL} SELECT surface, round(100.0 * sum(CASE WHEN schema_valid THEN 1 ELSE 0 END) / count(*), 6)::DOUBLE AS m1,
  round(CASE WHEN sum(cov_d) <> 0 THEN 100.0 * sum(cov_n) / sum(cov_d) END, 6)::DOUBLE AS m3, round(CASE WHEN sum(attr_d) <> 0 THEN 100.0 * sum(attr_n) / sum(attr_d) END, 6)::DOUBLE AS m5 FROM sc GROUP BY 1""")  # fmt: skip
def rates_in_sql(spark, sf_dir):
    """The rates asked for in SQL, over the view of scores."""
    sql.register_functions(spark)
    sql.register_briefs(spark, briefs(spark, sf_dir).select("id", "raw"))
    sums = "SELECT surface, count_if(schema_valid) AS valid, count(*) AS n, sum(cov_n) AS cov_n, sum(cov_d) AS cov_d, sum(attr_n) AS attr_n, sum(attr_d) AS attr_d FROM brief_scores GROUP BY surface"
    rate = lambda m, n, d: f"CAST(round({m}({n}, {d}), 6) AS DOUBLE) AS {m}"
    return spark.sql(f"SELECT surface, {rate('m1', 'valid', 'n')}, {rate('m3', 'cov_n', 'cov_d')}, {rate('m5', 'attr_n', 'attr_d')} FROM ({sums})")


@query(f"WITH {EXPECTED_SQL} SELECT id, schema_valid, n_errors FROM sc WHERE surface = 'qbr'")
def surface_in_sql(spark, sf_dir):
    sql.register_briefs(spark, briefs(spark, sf_dir).select("id", "raw"))
    return spark.sql("SELECT id, schema_valid, n_errors FROM briefs_of_surface('qbr')")


@query(r"""SELECT c_custkey, regexp_matches(c_custkey::VARCHAR, '^[1-9]\d{3,5}$') AS cid_ok, regexp_matches(lpad(c_custkey::VARCHAR, 8, '0'), '^\d{8}$') AS case_ok, c_custkey % 10000 <> 0 AS amount_ok FROM customer""")
def lints_in_sql(spark, sf_dir):
    sql.register_functions(spark)
    return spark.sql("SELECT c_custkey, lint_customer_id(c_custkey) AS cid_ok, lint_case_number(lpad(c_custkey, 8, '0')) AS case_ok, lint_messy_amount(c_custkey) AS amount_ok FROM {customer}", customer=table(spark, sf_dir, "customer"))


_CLAIMED = "substring(text, CAST(1 + doc_id * 7 % greatest(length(text) - {n}, 1) AS INT), {n})"


@query(f"""WITH c AS (SELECT doc_id AS id, {_CLAIMED.format(n=60)} AS phrase FROM documents UNION ALL SELECT doc_id, {_CLAIMED.format(n=9)} FROM documents
  UNION ALL SELECT doc_id + 1, {_CLAIMED.format(n=60)} FROM documents UNION ALL SELECT doc_id + 1, {_CLAIMED.format(n=5)} FROM documents)
  SELECT DISTINCT id, phrase FROM c JOIN documents ON doc_id = id WHERE contains(text, phrase)""")  # fmt: skip
def claims_in_inputs(spark, sf_dir):
    """Long and short pieces of each text as claims on it and on the next document, against whole texts."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    cut = lambda n, of: docs.select((F.col("doc_id") + of).alias("id"), F.expr(_CLAIMED.format(n=n)).alias("phrase"))
    claims = cut(60, 0).unionByName(cut(9, 0)).unionByName(cut(60, 1)).unionByName(cut(5, 1))
    return grounding.grounded_by_phrase(claims, docs.select(F.col("doc_id").alias("id"), "text"))


@query("""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,} [a-z]+')) AS entity FROM documents)
  SELECT DISTINCT s.doc_id + 1 AS id, entity FROM s JOIN documents d ON d.doc_id = s.doc_id + 1 WHERE d.text IS NOT NULL AND NOT contains(lower(d.text), lower(entity))""")  # fmt: skip
def names_of_the_document_before(spark, sf_dir):
    """Names of each text that the next document doesn't have, in any case."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    named = docs.select((F.col("doc_id") + 1).alias("id"), F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,} [a-z]+"), F.lit(0))).alias("entity"))
    inputs = docs.select(F.col("doc_id").alias("id"), "text")
    return grounding.not_in_inputs(named.join(inputs.select("id"), "id", "left_semi").distinct(), inputs)


@query(f"""WITH h AS (SELECT DISTINCT token, hint FROM (VALUES {", ".join(f"('{t}', '{h}')" for t, hints in EDGE_CASE_HINTS.items() for h in hints)}) v(token, hint)),
  d AS (SELECT doc_id, lower(text || ' ' || (SELECT string_agg(hint, ' ' ORDER BY hint) FROM h WHERE length(hint) % 7 = doc_id % 7)) AS t FROM documents)
  SELECT doc_id AS id, token, count(*) AS hints FROM d JOIN h ON contains(t, hint) GROUP BY 1, 2""")  # fmt: skip
def hints_in_texts(spark, sf_dir):
    """All hint lists at once over whole texts, which end in some hints."""
    hints = spark.createDataFrame([(t, h) for t, hs in EDGE_CASE_HINTS.items() for h in hs], "token string, pattern string").distinct()
    ends = [" ".join(sorted({h for hs in EDGE_CASE_HINTS.values() for h in hs if len(h) % 7 == k})) for k in range(7)]
    end = F.element_at(F.array(*[F.lit(e) for e in ends]), (F.col("doc_id") % 7 + 1).cast("int"))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.concat_ws(" ", "text", end)).alias("text")).where("text is not null")
    return matching.pattern_hits(texts, hints.select("pattern"), "doc_id").join(F.broadcast(hints), "pattern").groupBy("id", "token").agg(F.count("*").alias("hints"))


@query("""WITH w AS (SELECT string_split(text, ' ') AS w FROM benchmark), p AS (SELECT DISTINCT array_to_string(w[i:i + 5], ' ') AS p FROM (SELECT w, unnest(range(1, len(w) - 4)) AS i FROM w))
  SELECT doc_id AS id, count(*) AS passages FROM documents JOIN p ON contains(text, p) GROUP BY 1""")  # fmt: skip
def passages_in_texts(spark, sf_dir):
    """Every run of six words of the benchmark as a pattern over whole texts."""
    w = F.split("text", " ")
    runs = F.when(F.size(w) >= 6, F.transform(F.sequence(F.lit(1), F.size(w) - 5), lambda i: F.array_join(F.slice(w, i, F.lit(6)), " ")))
    patterns = table(spark, sf_dir, "benchmark").select(F.explode(runs).alias("pattern"))
    return matching.pattern_hits(table(spark, sf_dir, "documents"), patterns, "doc_id").groupBy("id").agg(F.count("*").alias("passages"))


@query("""WITH n AS (SELECT c_name AS name FROM customer UNION SELECT s_name FROM supplier)
  SELECT x.name AS a, y.name AS b, CAST(levenshtein(x.name, y.name) AS INT) AS distance FROM n x JOIN n y ON x.name < y.name WHERE levenshtein(x.name, y.name) <= 1""")  # fmt: skip
def near_names(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")))
    return matching.near_pairs(names, most=1)


@query("""SELECT c_custkey AS id, 'GERMANY' AS entity FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name <> 'GERMANY'
  UNION ALL SELECT c_custkey, 'Ada Lovelace' FROM customer WHERE c_custkey % 2 = 1""")
def unfounded_entities(spark, sf_dir):
    """Summaries name Germany and a person; the inputs name the customer's nation and, for even keys, the person."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey").alias("id")
    inputs = rows.select(k, F.concat_ws(" ", F.lit("notes of"), "n_name", F.when(F.col("c_custkey") % 2 == 0, "by Ada Lovelace")).alias("text"))
    return grounding.unfounded_entities(rows.select(k, F.lit("Yesterday we met Ada Lovelace in GERMANY.").alias("text")), inputs)


@query(f"""WITH {EXPECTED_SQL}, t AS (SELECT count(*) AS n, sum(CASE WHEN schema_valid THEN 1 ELSE 0 END) AS v, sum(cov_n) AS cn, sum(cov_d) AS cd, sum(attr_n) AS an, sum(attr_d) AS ad FROM sc),
  x AS (SELECT * FROM t, (VALUES ('m1', 95), ('m3', 90), ('m5', 80)) m(m, bound)), y AS (SELECT *, CASE m WHEN 'm1' THEN 100.0 * v / n WHEN 'm3' THEN 100.0 * cn / cd ELSE 100.0 * an / ad END AS p FROM x)
  SELECT '3 target' AS part, m || ' ' || printf('%.1f%%', p) || ' (target >= ' || bound || '%) ' || CASE WHEN p >= bound THEN 'ok' ELSE 'missed' END AS line FROM y
  UNION ALL SELECT '5 warning', 'no JSON object: ' || id FROM (SELECT id FROM sc WHERE surface = '?' ORDER BY id LIMIT 10)
  UNION ALL SELECT '6 missing', 'brief-absent'""")  # fmt: skip
def report_card(spark, sf_dir):
    docs = briefs(spark, sf_dir)
    ids = docs.select("id").unionByName(spark.range(1).select(F.lit("brief-absent").alias("id")))
    return report.card(metrics.score(docs), ids).where("part in ('3 target', '5 warning', '6 missing')")


@query("""SELECT coalesce(c_custkey, o_custkey) AS id, c_custkey IS NOT NULL AS has_gold, o_custkey IS NOT NULL AS has_prediction
  FROM customer FULL JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey""")
def paired_by_id(spark, sf_dir):
    gold = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("raw"))
    made = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit("x").alias("raw")).distinct()
    return report.paired(made, gold).select("id", F.col("gold").isNotNull().alias("has_gold"), F.col("predicted").isNotNull().alias("has_prediction"))


@query(f"""WITH {EXPECTED_SQL}, e AS (SELECT id, unnest(list_filter([CASE WHEN k % 41 = 0 THEN '<root>: required' END, CASE WHEN k % 19 = 0 THEN 'account: additionalProperties' END, CASE WHEN k % 17 = 0 THEN 'confidence/overall: enum' END,
  CASE WHEN k % 43 = 0 THEN 'confidence/per_section/pipeline: enum' END, CASE WHEN k % 11 = 0 THEN 'executive_summary: type' END, CASE WHEN k % 23 = 0 THEN 'pipeline/total_active_mrr: type' END,
  CASE WHEN k % 31 = 0 THEN 'sources_used: uniqueItems' END, CASE WHEN k % 37 = 0 THEN 'support_health/open_cases_count: minimum' END, CASE WHEN k % 29 = 0 THEN 'talking_points: maxItems' END], lambda x: x IS NOT NULL)[1:1]) AS first
  FROM sc WHERE surface <> '?') SELECT id, first FROM e""")  # fmt: skip
def first_messages(spark, sf_dir):
    """The first message of every invalid brief, without its detail."""
    found = metrics.score(briefs(spark, sf_dir), keep=1).where("not schema_valid and surface <> '?'")
    return found.select("id", F.regexp_extract(F.col("schema_errors")[0], r"^\S+ \S+", 0).alias("first"))


@query("SELECT s_nationkey AS dc, count(*) AS n FROM supplier WHERE s_nationkey % 3 < 2 AND s_suppkey % 4 <> 0 GROUP BY 1")
def counted_cases(spark, sf_dir):
    """Cases of two record types, without those of bots."""
    kind, author = _pick(F.col("s_nationkey"), "incident", "question", "chore"), _pick(F.col("s_suppkey"), "monitor-bot", "ann", "bob", None)
    cases = table(spark, sf_dir, "supplier").withColumns({"kind": kind, "author": author})
    return bundle.counted_cases(cases, "kind", ("incident", "question"), "author", ("monitor-bot",)).groupBy(F.col("s_nationkey").alias("dc")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, max(o_orderdate)::DATE AS last, CAST(date_diff('day', max(o_orderdate)::DATE, DATE '1999-01-01') AS INT) AS days_ago, max(o_orderdate)::DATE + 200 BETWEEN DATE '1999-01-01' AND DATE '1999-01-01' + 90 AS renews FROM orders GROUP BY 1")
def last_activities(spark, sf_dir):
    as_of = F.lit("1999-01-01").cast("date")
    found = bundle.last_activity(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", as_of)
    last = F.col("last").cast("date")
    return found.select("o_custkey", last.alias("last"), "days_ago", bundle.renews_within(F.date_add(last, 200), as_of, 90).alias("renews"))
