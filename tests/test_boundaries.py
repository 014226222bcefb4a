"""Argument checks, gates, settings, batches, streams with a watermark, exports of awkward ids."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import bundle, grounding, knobs, masking, monitor
from docloom.sources import io
from docloom.streaming import score


def test_arguments():
    assert knobs.one_of("surface", "qbr", ("qbr",)) == "qbr" and knobs.one_of("surface", None, ("qbr",)) is None
    with pytest.raises(ValueError, match="surface must be one of qbr, handoff"):
        knobs.one_of("surface", "x", ("qbr", "handoff"))
    assert knobs.exactly_one(gold=True, model=None) == "gold"
    for given in ({"gold": True, "model": "m"}, {"gold": False, "model": None}):
        with pytest.raises(ValueError, match="exactly one of gold, model"):
            knobs.exactly_one(**given)


def test_gates(spark, tmp_path):
    there = tmp_path / "a"
    there.write_text("x")
    assert knobs.gates(spark, 142, files=(f"file://{there}",), free_gb=60) == []
    assert knobs.gates(spark, 143) == ["cost 20.08 is over the cap of 20.00"] and knobs.gates(spark, 143, dry_run=True) == []
    assert knobs.gates(spark, 1, cap=0.1404) == []  # at the cap
    assert knobs.gates(spark, 1, files=(f"file://{there}b",), free_gb=59.5) == [f"absent: file://{there}b", "59.5 GB free, 60 needed"]


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("SOME_KEY", "env")
    assert io.setting(spark, "some.key", "SOME_KEY", "none") == "env" and io.setting(spark, "some.key", default="none") == "none"
    spark.conf.set("some.key", "session")
    assert io.setting(spark, "some.key", "SOME_KEY") == "session"
    spark.conf.unset("some.key")


def test_upstream_by_table_and_format(spark, tmp_path):
    spark.range(4).selectExpr("id as Id", "id * 2 as Amount").createOrReplaceTempView("upstream_rows")
    source = {"format": "table", "path": "upstream_rows", "columns": {"Id": "account_id"}, "where": "Amount > 2"}
    assert sorted(r.account_id for r in io.upstream(spark, source).collect()) == [2, 3]
    (tmp_path / "x.csv").write_text("Id;Amount\n1;2\n")
    read = io.upstream(spark, {"format": "csv", "path": f"file://{tmp_path}/x.csv", "options": {"header": "true", "sep": ";"}})
    assert [tuple(r) for r in read.collect()] == [("1", "2")]


@pytest.mark.parametrize("size, chunk", [(16, 10), (3, 4096), (1, 1)])
def test_batches_are_consecutive(spark, size, chunk):
    keys = [3 * k for k in range(50)]
    got = sorted((r.k, r.batch) for r in masking.batches(spark.createDataFrame([(k,) for k in keys], "k long"), "k", size, chunk=chunk).collect())
    assert got == [(k, i // size) for i, k in enumerate(keys)]


def test_losses_are_carried_over_chunks(spark):
    log = [(s, 1.0 * s if s in (1, 2, 11) else None, 0.5 * s) for s in range(40)]
    df = spark.createDataFrame(log, "step long, loss double, peak_alloc_gb double")
    want = {s: (2.0 if s < 11 else 11.0, 0.5 * s) for s in range(5, 40, 5)}
    for chunk in (1, 7, 1000):
        assert {r.step: (r.last_loss, r.tick_peak) for r in monitor.ticks(df, chunk=chunk).collect()} == want


def test_stream_of_ticks_lets_go_of_old_ones(spark, tmp_path):
    schema = "ts timestamp, step long, peak_alloc_gb double"

    def arrive(name, rows):
        spark.createDataFrame(rows, "ts string, step long, peak_alloc_gb double").select(F.to_timestamp("ts").alias("ts"), "step", "peak_alloc_gb").coalesce(1).write.parquet(f"file://{tmp_path}/in/{name}")

    def run():
        log = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
        ticks = score.step_ticks(log, time="ts", late="1 minute", gap="10 minutes")
        q = ticks.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return q.lastProgress, sorted(tuple(r) for r in spark.read.schema("tick long, tick_peak double").parquet(f"file://{tmp_path}/out").collect())

    arrive("a", [("2026-01-01 00:00:00", 1, 1.0), ("2026-01-01 00:05:00", 5, 4.0), ("2026-01-01 00:06:00", 6, 2.0)])
    assert run()[1] == []
    arrive("b", [("2026-01-01 03:00:00", 7, 9.0)])
    progress, found = run()
    assert found == [(1, 4.0), (2, 2.0)]
    assert progress.stateOperators[0].numRowsTotal == 1


def test_export_keeps_keys_in_order_and_ids_as_they_are(spark, tmp_path):
    docs = [("a b", '{"z":1,"a":{"k":[1,"é"]}}'), ("x=1+%2F", "{}")]
    sizes = io.export_documents(spark.createDataFrame(docs, "id string, raw string"), f"file://{tmp_path}")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a b.json", "x=1+%2F.json"]
    for i, raw in docs:
        assert (tmp_path / f"{i}.json").read_text() == json.dumps(json.loads(raw), indent=2, ensure_ascii=False)
    assert {r.id: r.bytes for r in sizes.collect()} == {i: (tmp_path / f"{i}.json").stat().st_size for i, _ in docs}
    with pytest.raises(ValueError, match="repeated"):
        io.export_documents(spark.createDataFrame([("a", "{}"), ("a", "{}")], "id string, raw string"), f"file://{tmp_path}/twice")


def test_names_in_summaries(spark):
    texts = ["Yesterday we met Ada Lovelace. Then came Grace with 12345 chips.", "New York is big. it rains in Paris", None, ""]
    got = [r.e for r in spark.createDataFrame([(t,) for t in texts], "t string").select(grounding.entities(F.col("t")).alias("e")).collect()]
    assert got == [["12345", "Ada Lovelace", "Grace"], ["New York", "Paris"], None, []]


def test_cases_that_count(spark):
    rows = [(1, "incident", "ann"), (2, "incident", None), (3, "incident", "bot"), (4, None, "ann"), (5, "chore", "ann")]
    df = spark.createDataFrame(rows, "k long, kind string, author string")
    assert sorted(r.k for r in bundle.counted_cases(df, "kind", ("incident",), "author", ("bot",)).collect()) == [1, 2]
