"""Hand-derived cases of the other operators."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.functions.vocab import CLAIM_PATHS, EDGE_CASE_HINTS, SATISFIABLE_PATHS, SURFACE_SECTIONS
from docloom.operators import asof, bundle, grounding, knobs, lints, masking, metrics, monitor, records
from docloom.plans import report
from docloom.sources import io
from docloom.streaming import score as streaming


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[1] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_vocabularies():
    assert [len(v) for v in SURFACE_SECTIONS.values()] == [12, 11, 7, 9, 5, 4] and len(CLAIM_PATHS) == 14 and len(EDGE_CASE_HINTS) == 19
    assert set(SATISFIABLE_PATHS) < set(CLAIM_PATHS)


def test_shapes(spark):
    said = ["strategic at-risk", "Mid-market, multi-deal", "mid-market", "ENTERPRISE_STEADY small", "p1", "", None, "enterprise expansion"]
    assert values(spark, said, "s string", records.shape(F.col("s"))) == ["small_strategic", "mid_market_active", "mid_market_quiet", "enterprise_steady", "incident_acute", None, None, "enterprise_expanding"]


def test_source_mix(spark):
    assert values(spark, ["RICH", "enriched", "sf_only rich", None], "s string", records.source_mix(F.col("s"))) == [None, "rich", "sf_only", None]


def test_edge_cases_fall_through(spark):
    said = [["SOC2 audit cycle", "SOC2 press release"], ["null_industry"], ["marble supplier"], ["typo", "typo"], None]
    got = values(spark, [(x,) for x in said], "e array<string>", records.edge_cases(F.col("e")))
    assert got == [["audit_cycle", "public_announcement_anchor"], [], ["bot_filed_case_noise"], ["opp_name_typo"], []]
    assert values(spark, [(["null_industry"],)], "e array<string>", records.edge_cases(F.col("e"), True)) == [["null_industry"]]


def test_prompt_and_records(spark):
    doc = {"surface": "", "_meta": {"surface": "qbr", "shape_constraints": "x", "edge_cases_included": ["kanji"]}, "a": None, "b": "é"}
    df = spark.createDataFrame([("e1", json.dumps(doc)), ("e2", "nope")], "id string, raw string")
    (r,) = records.chat_records(df, "SYS", on_bad="quarantine").collect()
    assert r.surface == "qbr" and r["shape"] is None and [m.role for m in r.messages] == ["system", "user", "assistant"]
    assert r.messages[1].content == 'Generate one synthetic example with these parameters:\n\n- surface: qbr\n- account_shape: enterprise_steady\n- edge_cases: ["non_latin_contact"]'
    assert json.loads(r.messages[2].content) == {"surface": "", "a": None, "b": "é"}
    assert [x.id for x in records.bad_documents(df).collect()] == ["e2"]
    with pytest.raises(Exception, match="not one JSON object"):
        records.chat_records(df, "SYS").collect()


def test_split_and_chat_text(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    got = {r.id: r.split for r in records.split(df, spark.createDataFrame([("a",), ("a",), ("z",)], "id string")).collect()}
    assert got == {"a": "eval", "b": "train"}
    m = [("user", "hi"), ("assistant", "yo")]
    assert values(spark, [(m,)], "m array<struct<role:string,content:string>>", records.chat_text(F.col("m"))) == ["<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"]
    assert len(values(spark, [(m,)], "m array<struct<role:string,content:string>>", records.without_assistant(F.col("m")))[0]) == 1


def test_cutoff_and_mask(spark):
    ids = [[7, 1, 5, 7, 2, 9, 7, 1, 6, 8], [7, 1, 5, 3], [7, 1], [], [7, 1, 5]]
    cut = masking.cutoff(F.col("x"), 7, [1], 5)
    assert values(spark, [(x,) for x in ids], "x array<int>", cut) == [8, 3, None, None, 3]
    kept = values(spark, [(x,) for x in ids], "x array<int>", masking.masked(F.col("x"), cut))
    assert kept == [[-100] * 8 + [6, 8], [-100] * 3 + [3], [-100, -100], [], [-100] * 3]
    status = masking.status(masking.masked(F.col("x"), cut), 2)
    assert values(spark, [(x,) for x in ids[:3]], "x array<int>", status) == ["pass", "warn_short", "fail_all_masked"]
    assert values(spark, [([1, 2, 3],)], "x array<int>", masking.status(F.col("x"), 1)) == ["fail_none_masked"]
    lab = masking.masked(F.col("x"), cut)
    assert values(spark, [(ids[0],)], "x array<int>", masking.boundary(F.col("x"), lab, 2)) == [[7, 1, 6, 8]]
    assert values(spark, [(ids[0],)], "x array<int>", masking.tail(F.col("x"), lab, 2)) == [[1, 6, 8]]
    assert values(spark, [(ids[0],)], "x array<int>", masking.truncated(F.col("x"), 2)) == [[7, 1]]


def test_attempts(spark):
    rows = [(1, 1, "schema"), (1, 2, "ok"), (1, 3, "ok"), (2, 1, "api"), (2, 2, "ok"), (3, 1, "parse"), (3, 2, "parse"), (3, 3, "parse"), (3, 4, "ok")]
    got = {r.row: (r.attempts, r.good_attempt, r.success, r.errors) for r in knobs.resolve(spark.createDataFrame(rows, "row long, attempt int, outcome string")).collect()}
    assert got == {1: (2, 2, True, "1:schema"), 2: (1, None, False, "1:api"), 3: (3, None, False, "1:parse,2:parse,3:parse")}
    ids = knobs.running_ids(spark.createDataFrame([(0, True), (1, False), (2, True)], "row long, success boolean"), 9, bucket_rows=2)
    assert [r.example_id for r in ids.orderBy("row").collect()] == [9, None, 10]


def test_judging_and_feedback(spark):
    raws = ["no json", "```json\n{\n```", '```json\n{"account": 1}\n```', None]
    df = spark.createDataFrame([(1, i + 1, r, "down" if r is None else None) for i, r in enumerate(raws)], "row long, attempt int, raw string, api_error string")
    assert [r.outcome for r in knobs.judged(df).orderBy("attempt").collect()] == ["no_block", "parse", "schema", "api"]
    (c,) = knobs.conversations(df, spark.createDataFrame([(1, "go")], "row long, prompt string"), retries=4).collect()
    assert [m.role for m in c.messages] == ["user"] + ["assistant", "user"] * 3 and "- at account: type" in c.messages[-1].content


def test_next_id_and_cost(spark):
    names = spark.createDataFrame([("example-007.json",), ("example-1000.json",), ("x",)], "name string")
    assert knobs.next_id(names).first()[0] == 1001 and knobs.next_id(names, three_digits=True).first()[0] == 101
    assert knobs.next_id(names.where("false")).first()[0] == 1
    assert values(spark, [142, 143], "n int", knobs.over_cap(F.col("n"))) == [False, True]
    assert values(spark, ["a, b,,c "], "s string", knobs.edge_case_list(F.col("s"))) == [["a", "b", "c"]]


def test_matrix(spark):
    rows = knobs.matrix(spark, "qbr", 2000).collect()
    counts = [sum(len(r.edge_cases) == n for r in rows) / 2000 for n in range(4)]
    assert all(abs(a - b) < 0.04 for a, b in zip(counts, [0.2, 0.4, 0.3, 0.1], strict=True)) and all(len(set(r.edge_cases)) == len(r.edge_cases) for r in rows)
    assert len({r.account_shape for r in rows}) == 8 and len({r.source_mix for r in rows}) == 7
    fixed = knobs.matrix(spark, "qbr", 2000, edge_cases=["audit_cycle"]).collect()
    assert [r.account_shape for r in rows] == [r.account_shape for r in fixed] and {tuple(r.edge_cases) for r in fixed} == {("audit_cycle",)}
    with pytest.raises(ValueError):
        knobs.matrix(spark, "none", 1)


def test_report_flags_use_unrounded_values(spark):
    assert values(spark, [94.96, 95.0, None], "x double", metrics.meets(F.col("x"), "m1")) == [False, True, None]
    s = spark.createDataFrame([("a", "qbr", True, 9, 10, 0, 0), ("b", "?", False, 0, 1, 0, 0)], "id string, surface string, schema_valid boolean, cov_n int, cov_d int, attr_n int, attr_d int")
    rows = {r.surface: r for r in report.report(s).collect()}
    assert rows["OVERALL"].m3 == 100 * 9 / 11 and rows["OVERALL"].m5 is None and rows["OVERALL"].gate_passed is False and rows["qbr"].gate_passed is None
    ids = spark.createDataFrame([("a",), ("a",), ("c",)], "id string")
    assert report.join_predictions(ids, s).count() == 2 and report.join_predictions(ids, s, "count").count() == 3 and [r.id for r in report.missing_ids(ids, s).collect()] == ["c"]
    assert report.lines([rows["OVERALL"]])[0].endswith("n/a")


def test_monitor(spark):
    log = spark.createDataFrame([(0, 9.0, 1.0), (3, 5.0, 7.0), (4, None, 2.0), (5, None, 3.0), (10, 1.0, 4.0)], "step long, loss double, peak_alloc_gb double")
    assert [tuple(r) for r in monitor.ticks(log).orderBy("step").collect()] == [(5, 5.0, 7.0), (10, 1.0, 4.0)]
    assert {r.step for r in monitor.newest(log, 2).collect()} == {5, 10}
    m = spark.createDataFrame([("m1", 1, 99.0), ("m1", 2, 96.5), ("m1", 3, 95.0)], "metric string, checkpoint int, value double")
    assert [r.regressed for r in monitor.regressions(m).orderBy("checkpoint").collect()] == [False, True, False]


def test_bundle(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y")], "k string, at int, v string")
    keys = spark.createDataFrame([("a", 5), ("a", 6), ("b", 9)], "k string, now int")
    assert {(r.k, r.now): r.v for r in asof.latest_before(rows, keys, "k", "at", "now").collect()} == {("a", 5): "x", ("a", 6): "y", ("b", 9): None}
    got = values(spark, [([("low", 1), ("critical", 2), ("?", 3), ("low", 0)],)], "e array<struct<urgency:string,n:int>>", bundle.ranked_by_urgency(F.col("e")))
    assert [x.n for x in got[0]] == [2, 1, 0, 3]


def test_grounding(spark):
    claims = spark.createDataFrame([("high", True), ("high", True), ("low", False)], "confidence string, grounded boolean")
    rates = grounding.hallucination(claims, ["confidence"])
    assert {r.confidence: r.rate for r in rates.collect()} == {"high": 0.0, "low": 100.0} and grounding.monotonic(rates).first()[0]
    phrase = grounding.grounded_by_phrase(spark.createDataFrame([("a", "x y"), ("a", "z")], "id string, phrase string"), spark.createDataFrame([("a", "w x y")], "id string, text string"))
    assert [r.phrase for r in phrase.collect()] == ["x y"]


def test_lints(spark):
    check = lambda xs, f: values(spark, xs, "x string", f(F.col("x")))
    assert check(["0013h00000V5oXJAAZ", "001"], lints.account_id) == [True, False]
    assert check(["6929", "0692", "ZL-1"], lints.customer_id) == [True, False, False]
    assert check(["A: B, Q32025", "A Q22926", "none"], lints.plain_quarter) == [True, False, True]
    assert check(["Müller", "北京"], lints.latin) == [True, False]
    assert check(["a Robust plan", "fine"], lints.no_forbidden_phrase) == [False, True]
    assert check([" USA", "France"], lints.country) == ["United States", "France"]
    assert check(["2026-01-01T00:00:00Z", "soon"], lints.iso_time) == [True, False]
    assert check(["SF data", "case 1"], lints.specific_ref) == [False, True]
    assert values(spark, [("qbr", ["renewal", "pricing_history", "must_address"]), ("qbr", ["timeline"])], "s string, f array<string>", lints.emphasis(F.col("s"), F.col("f"))) == [True, False]
    assert values(spark, [("qbr", ["timeline"])], "s string, f array<string>", lints.honest_empty(F.col("s"), F.col("f"))) == [False]


def test_sources_and_sinks(spark, tmp_path):
    for n, text in (("example-001", '{"a": 1}'), ("example-002", "{bad")):
        (tmp_path / f"{n}.json").write_text(text)
    docs = io.documents(spark, f"{tmp_path}/example-*.json")
    assert {r.id: r.raw for r in docs.collect()} == {"example-001": '{"a": 1}', "example-002": "{bad"}
    (tmp_path / "ids.txt").write_text("# no\n\n example-001 \nexample-001\nexample-009\n")
    ids = io.id_list(spark, f"{tmp_path}/ids.txt")
    assert ids.count() == 3 and io.id_list(spark, f"{tmp_path}/ids.txt", True).count() == 2
    assert io.documents_by_id(spark, str(tmp_path), ids).where("raw is null").count() == 1
    rec = spark.createDataFrame([("a", [("user", "x")], "train"), ("", [("user", "y")], "eval")], "id string, messages array<struct<role:string,content:string>>, split string")
    io.write_records(rec, f"{tmp_path}/out")
    assert io.records(spark, f"{tmp_path}/out/split=train").count() == 1 and io.without_id(spark, f"{tmp_path}/out/split=eval").count() == 1
    assert io.records(spark, f"{tmp_path}/out/split=eval", first=3).first().id == "line0"
    io.write_predictions(docs.select("id", "raw"), f"{tmp_path}/pred")
    assert spark.read.parquet(f"{tmp_path}/pred/raw").count() == 2 and spark.read.parquet(f"{tmp_path}/pred/json").count() == 1
    assert io.file_names(spark, f"{tmp_path}/example-*.json", f"{tmp_path}/*.txt").count() == 3
    assert io.export_documents(docs.where("id = 'example-001'"), f"{tmp_path}/pretty").first().bytes > 8
    assert json.loads((tmp_path / "pretty/example-001.json").read_text()) == {"a": 1} and io.resource(spark, f"{tmp_path}/example-001.json") == '{"a": 1}'


def test_streaming_scores(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"surface": "qbr"}')
    q = streaming.score_stream(streaming.arriving(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert [(r.id, r.surface, r.schema_valid) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("a", "qbr", False)]


def test_score_plan_has_no_python_and_one_parse(spark):
    df = spark.createDataFrame([("a", "{}")], "id string, raw string")
    plan = metrics.score(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_top_similar_in_blocks_equals_brute_force(spark):
    import math
    import random

    from docloom.operators import bundle
    from docloom.plans import queries as own

    rng = random.Random(12)
    rows = [(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for i in range(90)]  # many ties
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 5 = 0").selectExpr("vec_id as q_id", "embedding as q")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    cosine = lambda a, b: dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))
    want = {(i, r + 1, j) for i, a in rows if i % 5 == 0 for r, (_, j) in enumerate(sorted((-cosine(b, a), j) for j, b in rows if j != i)[:4])}
    found = bundle.top_similar(vectors, asked, 4, vector_block=17, question_block=4)
    assert {(r.q_id, r["rank"], r.vec_id) for r in found.collect()} == want
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    sf = "/root/testdata/sf0.001"
    ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 50 = 0").select("vec_id").collect()}
    assert {r.q_id for r in own.queries()["top_similar_every_50th"](spark, sf).collect()} == ids


def test_top_similar_of_odd_vectors_and_of_near_ties(spark):
    from docloom.operators import bundle

    copies = [(i, [0.1, 0.7, 0.3]) for i in range(40, 60)]  # copies of one vector: exact ties, wherever they stand
    odd = [(1, [1e-160, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [1.0, None, 2.0]), (5, [1.0, 2.0]), (6, []), (7, [1.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame(copies + odd, "vec_id long, embedding array<double>").repartition(3)
    asked = vectors.where("vec_id in (3, 7, 45)").selectExpr("vec_id as q_id", "embedding as q")
    for blocks in ((100, 100), (3, 2)):
        found = {q: [] for q in (3, 7, 45)}
        for r in bundle.top_similar(vectors, asked, 8, *blocks).orderBy("rank").collect():
            found[r.q_id].append((r.vec_id, r.similarity))
        assert [v for v, _ in found[45]] == [2, 40, 41, 42, 43, 44, 46, 47] or [v for v, _ in found[45]] == [1, 2, 40, 41, 42, 43, 44, 46]
        assert len({s for v, s in found[45] if v >= 40}) == 1
        assert [v for v, _ in found[3]] == [1, 2, 4, 5, 6, 7, 40, 41] and all(s is None for _, s in found[3])
        assert found[7][0][0] in (1, 2) and 3 not in dict(found[7])
    few = bundle.top_similar(vectors.where("vec_id < 8"), asked.where("q_id = 7"), 9).orderBy("rank").collect()
    assert len(few) == 6 and [r.vec_id for r in few][2:] == [3, 4, 5, 6]


def test_top_similar_multiplies_blocks(spark):
    from docloom.operators import bundle

    vectors = spark.range(50).selectExpr("id as vec_id", "array(cast(id as double), 1d) as embedding")
    plan = bundle.top_similar(vectors, vectors.selectExpr("vec_id as q_id", "embedding as q"))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "SortMergeJoin" not in plan  # a row a pair before
