"""Operators that cut hot keys and large groups, against plain definitions, on odd rows."""

import random
import statistics

import pytest

from docloom.operators import asof, bundle, grounding, matching, selection


@pytest.mark.parametrize("chunk_rows", [1_000_000, 40])
@pytest.mark.parametrize("inclusive", [False, True])
def test_as_of_join(spark, chunk_rows, inclusive):
    rng = random.Random(chunk_rows)
    hot = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    rows = [(hot(), rng.choice([None, *range(60)]), rng.choice([None, 1, 2, 3]), "x") for _ in range(400)]
    keys = [(hot(), rng.choice([None, *range(-3, 64)]), k // 2) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, at int, v int, asked string")
    found = asof.latest_before(df.withColumnRenamed("asked", "w"), spark.createDataFrame(keys, "k string, now int, n int"), "k", "at", "now", inclusive, chunk_rows)
    assert found.columns == ["k", "now", "n", "at", "v", "w"]

    def best(k, now):
        fit = [(at, v is not None, v or 0) for kk, at, v, _ in rows if k is not None and now is not None and kk == k and at is not None and (at < now or inclusive and at == now)]
        return max(fit)[0::2] if fit else (None, None)

    want = sorted((k or "", now if now is not None else -99, n, *(x or 0 for x in best(k, now))) for k, now, n in keys)
    assert sorted((r.k or "", r.now if r.now is not None else -99, r.n, r["at"] or 0, r.v or 0) for r in found.collect()) == want


def test_as_of_join_rows_out_are_linear(spark):
    """One user has all rows: the plan's largest operator gives as many rows as both sides have, however they are ordered."""
    rows = spark.range(20_000).selectExpr("1 as k", "id as at")
    found = asof.latest_before(rows, rows.selectExpr("k", "at as now"), "k", "at", "now", chunk_rows=3_000)
    assert found.count() == 20_000 and found.where("at = now - 1").count() == 19_999


def test_as_of_of_empty_sides(spark):
    rows, keys = spark.createDataFrame([("a", 1)], "k string, at int"), spark.createDataFrame([("a", 2)], "k string, now int")
    assert [tuple(r) for r in asof.latest_before(rows.limit(0), keys, "k", "at", "now").collect()] == [("a", 2, None)]
    assert asof.latest_before(rows, keys.limit(0), "k", "at", "now").collect() == []


def linear(values, p):
    values = sorted(values)
    place = p * (len(values) - 1)
    low = int(place)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (place - low)


@pytest.mark.parametrize("task_rows", [1_000_000, 50, 7])
def test_percentiles_of_groups_of_any_size(spark, task_rows):
    rng = random.Random(4)
    groups = {
        "tied": [rng.choice([1.0, 1.0, 1.0, 2.0]) for _ in range(900)], "one": [3.0] * 400, "wide": [10.0 ** rng.uniform(-200, 200) * rng.choice([-1, 1]) for _ in range(1_200)],
        None: [float(k) for k in range(333)], "few": [5.0, 7.0], "dense": [rng.gauss(0, 1) for _ in range(3_000)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("tied", None), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    ps = [0.0, 0.05, 0.5, 0.95, 1.0]
    found = {r.g: r for r in selection.percentiles(df, "v", ps, ["g"], task_rows).collect()}
    assert found.keys() == groups.keys()
    for g, values in groups.items():
        assert found[g].n == len(values) and found[g]["values"] == pytest.approx([linear(values, p) for p in ps], rel=1e-9)
    every = [v for vs in groups.values() for v in vs]
    whole = selection.percentiles(df, "v", [0.5], None, task_rows).first()
    assert whole.n == len(every) and whole["values"][0] == pytest.approx(statistics.median(every))
    assert selection.percentiles(df.limit(0), "v", ps, ["g"], task_rows).collect() == []


def test_held_out_is_exact_and_the_same_for_any_partitioning(spark):
    rows = [(k, "big" if k % 3 else None, k % 2) for k in range(900)] + [(1_000 + k, f"s{k}", 0) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, s string, t int")
    one, other = (sorted(r.id for r in selection.held_out(df.repartition(n), "id", ["s", "t"]).collect()) for n in (1, 7))
    assert one == other and len(set(one)) == 50
    assert len(selection.held_out(df.limit(20), "id", ["s", "t"]).collect()) == 20
    assert selection.held_out(df.limit(0), "id", ["s"]).collect() == []


def test_rounds_of_percentiles_read_what_the_round_before_left(spark, monkeypatch):
    kept, left = selection._kept, []

    def count(df, tag):
        out = kept(df, tag)
        if tag == "rows":
            left.append(out.count())
        return out

    monkeypatch.setattr(selection, "_kept", count)
    rows = spark.range(4_000).selectExpr("double(id * 7919 % 4000) AS v")
    assert selection.percentiles(rows, "v", [0.5], None, 500).first()["values"] == [1999.5]
    assert left and left[0] <= 500


def test_percentiles_cut_groups_only_around_wanted_ranks(spark, monkeypatch):
    """A row is compared with two values a rank, and what a round leaves is near the ranks; groups of every number, of few and of one value."""
    kept, left, cuts = selection._kept, [], []

    def seen(df, tag):
        out = kept(df, tag)
        if tag == "rows":
            left.append(out.count())
        if tag == "cuts":
            cuts.append(len(out.columns) - 1)
        return out

    monkeypatch.setattr(selection, "_kept", seen)
    rows = spark.range(40_000).selectExpr("explode(array('all', 'few', 'one')) AS g", "id").selectExpr("g", "double(case g when 'all' then id * 7919 % 40000 when 'few' then id % 7 else 3 end) AS v")
    found = {r.g: r["values"] for r in selection.percentiles(rows, "v", [0.5, 0.95], ["g"], 500).collect()}
    assert found == {"all": pytest.approx([19999.5, 37999.05]), "few": [3.0, 6.0], "one": [3.0, 3.0]}
    assert left[0] <= 600 and set(cuts) == {8}


def test_tasks_of_briefs_grow_in_number_with_the_input(spark):
    from docloom.plans.synth import briefs

    small, large = (briefs(spark, f"/root/testdata/{sf}").rdd.getNumPartitions() for sf in ("sf0.001", "sf0.1"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        fewer = briefs(spark, "/root/testdata/sf0.1").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(least))
    assert small == least <= large and fewer >= 3


WORDS = ["ab", "abc", "b", "", "the", "x.", "Été", "a b"]


def test_phrases_are_found_as_contains_has_it(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    inputs = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, "", text(5), text(40)])) for _ in range(80)] + [(1, "ab the " * 5_000)]
    claims = [(rng.choice([1, 1, 1, 2, 3, 4, None]), rng.choice([None, "", "b", "b the x", "ab  the", " ", text(2), text(3), text(4)[1:], text(5), text(9)])) for _ in range(400)]
    found = matching.phrases_in_texts(spark.createDataFrame(claims, "id int, phrase string"), spark.createDataFrame(inputs, "id int, text string"))
    want = {(i, p) for i, p in claims if i is not None and p is not None and any(j == i and t is not None and p in t for j, t in inputs)}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 20


def test_texts_of_few_phrases_are_not_taken_apart(spark, monkeypatch):
    """Texts list their runs of words only for ids with more phrases than a list holds."""
    claims = spark.createDataFrame([(1, "b the x y"), (1, "the z w v"), (2, "a b c d"), (2, "b c d e")], "id int, phrase string")
    inputs = spark.createDataFrame([(1, "ab the x b the x yes"), (2, "a b c d e"), (3, None)], "id int, text string")
    for chunk in (1, 500):
        monkeypatch.setattr(matching, "CHUNK", chunk)
        if chunk == 500:
            monkeypatch.setattr(matching, "_grams", lambda words, n: matching.F.transform(words, lambda w: matching.F.raise_error(w).cast("bigint")))
        assert sorted(tuple(r) for r in matching.phrases_in_texts(claims, inputs).collect()) == [(1, "b the x y"), (2, "a b c d"), (2, "b c d e")]


def test_names_in_no_input(spark):
    named = spark.createDataFrame([(1, "Ada L"), (1, "ADA l"), (2, "Ada L"), (3, "Ada L")], "id int, entity string")
    inputs = spark.createDataFrame([(1, "met ada lovelace"), (2, "nobody")], "id int, text string")
    assert sorted(tuple(r) for r in grounding.not_in_inputs(named, inputs).collect()) == [(2, "Ada L"), (3, "Ada L")]


@pytest.mark.parametrize("block_bytes", [4 << 20, 6])
def test_many_patterns_at_once(spark, block_bytes):
    rng = random.Random(2)
    patterns = ["a", "ab", "aba", "é b", "zz", "", None, "ab", "\n", "never there"]
    texts = [(k % 30, rng.choice([None, "", "".join(rng.choice("ab é\nz") for _ in range(rng.randint(1, 60)))])) for k in range(60)]
    df = spark.createDataFrame(texts, "id int, text string")
    found = matching.pattern_hits(df, spark.createDataFrame([(p,) for p in patterns], "pattern string"), block_bytes=block_bytes)
    count = lambda t, p: sum(t.startswith(p, k) for k in range(len(t)))
    want = sorted((i, p, count(t, p)) for i, t in texts for p in {p for p in patterns if p} if t and p in t)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert matching.pattern_hits(df, spark.createDataFrame([], "pattern string")).collect() == []


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_near_pairs_against_all_pairs(spark, most):
    rng = random.Random(most)
    names = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 9))) for _ in range(150)] + [None, "Ann Bee Ltd", "Ann Bee Ltd", "Ann Bee Ltd.", "Anne Bee Ltd"]
    found = {tuple(r) for r in matching.near_pairs(spark.createDataFrame([(n,) for n in names], "name string"), most=most).collect()}
    known = sorted({n for n in names if n is not None})
    assert found == {(a, b, edits(a, b)) for a in known for b in known if a < b and edits(a, b) <= most}


def test_names_that_share_half_their_letters_meet_only_their_like(spark, monkeypatch):
    names = spark.range(2_000).selectExpr("concat('Customer#', lpad(id * 7, 9, '0')) AS name")
    pairs = matching.near_pairs(names, most=1).count()
    monkeypatch.setattr(matching.F, "levenshtein", lambda a, b, most: matching.F.lit(0))
    assert 0 < pairs == matching.near_pairs(names, most=1).count()  # what meets is what is near


def test_keys_of_names_are_not_sent_through_the_driver(spark, tmp_path):
    """The files of a million names are small enough for a broadcast; their 38 million keys aren't."""
    spark.range(500).selectExpr("concat('Customer#', lpad(id, 9, '0')) AS name").write.parquet(str(tmp_path / "names"))
    found = matching.near_pairs(spark.read.parquet(str(tmp_path / "names")), most=1)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 500 * (9 + 9 + 4) // 2  # three digits, the first of them up to 4


def test_attached_lists_of_an_account_with_most_rows(spark):
    """First rows and counts of accounts, one of which holds nearly all; accounts without rows; ranks are cut before rows are sent."""
    accounts = spark.createDataFrame([("hot",), ("few",), ("none",)], "k string")
    rows = spark.range(5_000).selectExpr("if(id % 1000 = 7, 'few', 'hot') as k", "5000 - id as at", "id as v")
    made = bundle.attach(accounts, rows, "k", "items", ["v"], "at", most=3)
    assert made._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2  # one of them ahead of the exchange
    got = {r.k: (r.n_items, [(x["at"], x.v) for x in r["items"]]) for r in made.collect()}
    assert got == {"hot": (4_995, [(1, 4_999), (2, 4_998), (3, 4_997)]), "few": (5, [(993, 4_007), (1_993, 3_007), (2_993, 2_007)]), "none": (0, [])}


def test_hits_leave_a_task_in_small_batches():
    from types import SimpleNamespace

    import pyarrow as pa

    run = matching._matcher(SimpleNamespace(value=["a", "b"]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(30_000)), pa.array(["ab a"] * 30_000)], names=["id", "text"])
    found = list(run(iter([batch])))
    assert max(b.num_rows for b in found) <= matching.HITS + 1 and sum(b.num_rows for b in found) == 60_000  # one batch of 60,000 before
    rows = [r for b in found for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(rows) == sorted([(k, "a", 2) for k in range(30_000)] + [(k, "b", 1) for k in range(30_000)])
