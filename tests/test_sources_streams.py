"""Feeds, named files, counts of one pass, line numbers, ticks with state, and the library in SQL."""

import json
import os
import time
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter

from docloom.functions import sql
from docloom.operators import lints
from docloom.sources import feeds, io, named_files
from docloom.streaming import ticks

RSS = "<rss><channel><title>all</title><item><guid>{0}</guid><title>T {0}</title><link>http://x/?a=1&amp;b={0}</link><description>é &lt;b&gt;</description></item>{1}</channel></rss>"
WIKI = '<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/"><page><title>P</title><id>7</id><revision><id>99</id><timestamp>2024</timestamp><text>body</text></revision></page></mediawiki>'


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path + ".tmp~", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(path + ".tmp~", path)


def test_feeds_of_all_kinds(spark, tmp_path):
    put(tmp_path, "news-1.rss", RSS.format(1, ""))
    put(tmp_path, "sub/news-2.rss", RSS.format(2, "<item><guid>3</guid>")[:-20])
    put(tmp_path, "help.wiki.xml", WIKI)
    put(tmp_path, "docs.jsonl", '{"id": 5, "title": null, "url": "u"}\n\n[1]\n{"id": \n{"id": "6"}')
    put(tmp_path, "readme.txt", "not a feed")
    read = feeds.register(spark).read.format("feed").option("partitionBytes", 1).load(str(tmp_path))
    rows = {(r.feed, r.item_id): r for r in read.where("error is null").collect()}
    assert rows.keys() == {("news", "1"), ("news", "2"), ("help", "7"), ("docs", "5"), ("docs", "6")}
    assert rows["news", "1"].link == "http://x/?a=1&b=1" and rows["news", "1"].text == "é <b>" and rows["help", "7"].published == "2024" and rows["docs", "5"].title is None
    assert sorted(r.feed for r in read.where("error is not null").collect()) == ["docs", "docs", "news"]
    assert read.rdd.getNumPartitions() == 4
    one = read.where("feed in ('help', 'docs') and item_id > '5'")
    assert sorted(r.item_id for r in one.collect()) == ["6", "7"] and one.rdd.getNumPartitions() == 2  # files of other feeds aren't read
    os.makedirs(tmp_path / "none")
    assert spark.read.format("feed").load(str(tmp_path / "none")).count() == 0


def test_long_feeds_need_little_memory(tmp_path):
    put(tmp_path, "big.rss", "<rss><channel>" + "<item><guid>1</guid><description>x</description></item>" * 20_000 + "</channel></rss>")
    import tracemalloc

    tracemalloc.start()
    assert sum(1 for _ in feeds.items(str(tmp_path / "big.rss"), str(tmp_path))) == 20_000
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()


def test_feed_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        rows = feeds.register(spark).readStream.format("feed").load(source)
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.item_id for r in spark.read.parquet(out).collect())

    put(source, "news-1.rss", RSS.format(1, ""))
    assert run() == ["1"]
    time.sleep(0.01)
    put(source, "news-0.rss", RSS.format(2, ""))  # an earlier name, a later file
    assert run() == ["1", "2"] and run() == ["1", "2"]


def test_named_files(spark, tmp_path):
    docs = spark.createDataFrame([(f"doc {k}é", json.dumps({"b": k, "a": None})) for k in range(40)], "id string, raw string").repartition(5)
    folder = str(tmp_path / "out")
    sizes = io.export_documents(docs, folder)
    assert sizes.count() == 40 and sorted(os.listdir(folder)) == sorted(f"doc {k}é.json" for k in range(40))
    with open(f"{folder}/doc 3é.json", encoding="utf-8") as f:
        assert f.read() == '{\n  "b": 3,\n  "a": null\n}'
    io.export_documents(docs.limit(3), folder)  # again: the same names
    assert len(os.listdir(folder)) == 40


def test_many_small_files_are_few_partitions_with_the_rows_of_sparks_reader(spark, tmp_path):
    for k in range(300):
        put(tmp_path, f"n {k}é%20.json", "" if k == 7 else f'{{"k": {k}}}\n')
    for name in ("_hidden.json", ".hidden.json", "other.txt", "inner/a.json"):
        put(tmp_path, name, "{}")
    (tmp_path / "broken.json").write_bytes(b"\xff{}")
    found, glob = io.documents(spark, f"file://{tmp_path}/*.json"), f"{tmp_path}/*.json"
    plain = spark.read.text(glob, wholetext=True).select("_metadata.file_name", "_metadata.file_path", F.hex(F.col("value").cast("binary")))
    want = {(unquote(n).removesuffix(".json"), p, v) for n, p, v in plain.collect()}  # without the empty file
    rows = [tuple(r) for r in found.select("id", "path", F.hex(F.col("raw").cast("binary"))).collect()]
    assert len(rows) == 301 and {r for r in rows if r[2]} == want and [r[0] for r in rows if not r[2]] == ["n 7é%20"]
    assert found.rdd.getNumPartitions() == 1  # a task for 32 files before
    assert io.file_names(spark, glob).count() == 301 and io.documents(spark, f"{tmp_path}/none*.json").count() == 0
    many = spark.read.format("whole_files").option("partitionBytes", 1 << 16).load(str(tmp_path))
    assert many.rdd.getNumPartitions() > 10 and many.count() == 302


def test_what_tasks_of_feeds_and_named_files_hold_is_bounded(tmp_path):
    put(tmp_path, "docs-1.jsonl", "".join(json.dumps({"id": k, "text": "x" * 100_000}) + "\n" for k in range(200)))
    for reader in (feeds.FeedReader({"path": str(tmp_path)}), feeds.FeedStream({"path": str(tmp_path)})):
        found = list(reader.read(feeds.Portion([str(tmp_path / "docs-1.jsonl")])))  # rows that Spark puts into batches of 10,000 before
        assert [k for b in found for k in b.column("item_id").to_pylist()] == [str(k) for k in range(200)]
        assert len(found) > 3 and max(b.nbytes for b in found) < 5 << 20
    assert list(feeds.FeedReader({"path": str(tmp_path)}).read(feeds.Portion([]))) == []
    assert issubclass(named_files.Writer, DataSourceArrowWriter)  # no row of a batch is an object before its file is written


@pytest.mark.parametrize("bad", ["a/b", "", None, "_x", ".x"])
def test_a_failed_job_leaves_no_files(spark, tmp_path, bad):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"n{k}", "t") for k in range(30)] + [(bad, "t")], "name string, text string").repartition(6)
    named_files.register(spark)
    with pytest.raises(Exception, match="no name for a file|Job aborted|failed"):
        rows.write.format("named_files").mode("append").save(folder)
    assert os.listdir(folder) == []


def test_counts_of_the_same_pass_and_line_numbers(spark, tmp_path):
    lines = ['{"id": "a", "messages": []}', "", '{"messages": []}', '{"id": "", "messages": []}', '{"id": "b", "messages": []}']
    put(tmp_path, "in/1.jsonl", "\n".join(lines))
    put(tmp_path, "in/2.jsonl", "\n".join(lines[1:]))
    path = str(tmp_path / "in")
    found, seen = io.records_counted(spark, path)
    assert sorted(r.id for r in found.select("id", F.size("messages").alias("n")).collect()) == ["a", "b", "b"] and seen.get == {"lines": 7, "skipped": 4}
    assert [r.id for r in io.records(spark, path, first=6).collect()] == ["a", "line1", "line2", "b", "line4", "line5"]
    assert [r.id for r in io.records(spark, path, limit=2).collect()] == ["a", "b"]


def test_ticks_with_late_steps_and_restarts(spark, tmp_path):
    ticks.prepare(spark, ends=True)
    source, out, kind = str(tmp_path / "in"), str(tmp_path / "out"), "run string, step long, loss double, peak double"

    def run(rows, **how):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        keep = lambda df, n: df.write.mode("append").parquet(out)
        ticks.ticks(spark.readStream.schema(kind).parquet(source), **how).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return {(r.run, r.step): (r.last_loss, r.tick_peak) for r in ticks.latest(spark.read.parquet(out)).collect()}

    assert run([("a", 1, 9.0, 1.0), ("a", 5, None, 3.0), ("a", 10, None, 2.0), ("b", 5, None, None), (None, 5, 1.0, 1.0)]) == {("a", 5): (9.0, 3.0), ("a", 10): (9.0, 2.0), ("b", 5): (None, None)}
    found = run([("a", 15, 4.0, 1.0), ("a", 20, None, 1.0), ("a", 3, 8.0, 7.0)])  # step 3 is late: it changes ticks 5 and 10, not 15
    assert found == {("a", 5): (8.0, 7.0), ("a", 10): (8.0, 2.0), ("a", 15): (4.0, 1.0), ("a", 20): (4.0, 1.0), ("b", 5): (None, None)}


def test_steps_however_late_change_their_ticks(spark, tmp_path):
    ticks.prepare(spark, ends=True)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    log = spark.range(12_000).selectExpr("'a' as run", "id as step", "if(id % 4 = 0, double(id), null) as loss", "double(id % 97) as peak")
    for odd in (0, 1):
        log.where(f"step % 2 = {odd}").coalesce(1).write.mode("append").parquet(source)
        keep = lambda df, n: df.write.mode("append").parquet(out)
        ticks.ticks(spark.readStream.schema(log.schema).parquet(source)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    found = {r.step: (r.last_loss, r.tick_peak) for r in ticks.latest(spark.read.parquet(out)).collect()}
    assert found == {t: (float(t - t % 4), float(max(x % 97 for x in range(t - 4, t + 1)))) for t in range(5, 12_000, 5)}


def test_old_ticks_are_folded_and_their_loss_goes_on():
    held = {"ticks": {k: [1.0, True, None if k % 4 else float(k), -1 if k % 4 else 5 * k] for k in range(1, 12)}, "folded": -1, "loss": None}
    ticks.TickProcessor(5, 3, 1)._fold(held)
    assert sorted(held["ticks"]) == [9, 10, 11] and held["loss"] == 8.0 and held["folded"] == 8


def test_functions_of_sql_are_the_library_s(spark):
    names = sql.register_functions(spark)
    assert "lint_account_id" in names and len(names) == len(sql.FUNCTIONS)
    values = ["Q12025", "Q1202", "customer success", "Ünïcode", "京", "001abcABC123abcABC1", "http://x.y/z", "korea", "[x]", None, "it's \\ robust", "sf data", "0" * 201]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    df.createOrReplaceTempView("some_values")
    for name, (function, arguments) in sql.FUNCTIONS.items():
        if list(arguments.items()) == [("x", "string")]:
            assert [r[0] for r in spark.sql(f"SELECT {name}(x) FROM some_values").collect()] == [r[0] for r in df.select(function(F.col("x"))).collect()], name
    assert spark.sql("SELECT m3(1, 8) AS a, m5(1, 0) AS b, lint_near_names('abc', 'abd') AS c, lint_messy_amount(10000) AS d").first()[:] == (12.5, None, True, False)
    assert lints.customer_id is sql.FUNCTIONS["lint_customer_id"][0]


def test_views_of_briefs(spark):
    docs = spark.createDataFrame([("a", '{"surface": "qbr", "must_address": ["x"]}'), ("b", "no json")], "id string, raw string")
    sql.register_briefs(spark, docs, "note")
    assert [r.id for r in spark.sql("SELECT id FROM notes_of_surface('qbr')").collect()] == ["a"]
    assert spark.sql("SELECT count(*) FROM note_violations WHERE id = 'a' AND keyword = 'required'").first()[0] > 0
    assert {r.section for r in spark.sql("SELECT section FROM note_sections WHERE id = 'a'").collect()} >= {"must_address"}
