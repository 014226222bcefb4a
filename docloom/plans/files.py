"""Registered queries of sources, sinks and streams: rows are written by a sink into the shared folder and read back by a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import jsonx
from docloom.operators import knobs
from docloom.plans.registry import query
from docloom.plans.synth import EXPECTED_SQL, briefs, table
from docloom.sources import feeds, io, named_files
from docloom.streaming import score, ticks


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(knobs.id_name(k).alias("id"), F.to_json(F.struct(k.alias("key"), F.col("n_name").alias("name"))).alias("raw"), k)


@query("""SELECT 'example-' || lpad(doc_id::VARCHAR, CAST(greatest(3, length(doc_id::VARCHAR)) AS INT), '0') AS id, md5('{' || chr(10) || '  "key": ' || doc_id || ',' || chr(10) || '  "lang": "' || lang || '",' || chr(10) ||
  '  "text_md5": "' || md5(text) || '"' || chr(10) || '}') AS raw_md5 FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL""")  # fmt: skip
def exported_documents(spark, sf_dir):
    """A file a document, named by tasks."""
    folder = io.shared_folder(spark, "exported")
    docs = table(spark, sf_dir, "documents").where("lang is not null and text is not null")
    raw = F.to_json(F.struct(F.col("doc_id").alias("key"), "lang", F.md5(F.col("text").cast("binary")).alias("text_md5")))
    io.export_documents(docs.select(knobs.id_name(F.col("doc_id")).alias("id"), raw.alias("raw")), folder)
    return io.documents(spark, f"{folder}/*.json").select("id", F.md5("raw").alias("raw_md5"))


@query("""SELECT id, id NOT LIKE '%x' AS found FROM (SELECT 'example-' || lpad(n_nationkey::VARCHAR, 3, '0') || CASE WHEN n_nationkey % 3 = 0 THEN 'x' ELSE '' END AS id FROM nation
  UNION ALL SELECT 'example-001' FROM nation WHERE n_nationkey < 3)""")  # fmt: skip
def listed_documents(spark, sf_dir):
    """Ids from a list with comments and blank lines; some are repeated, some have no file."""
    folder, names = io.shared_folder(spark, "listed"), io.shared_folder(spark, "ids")
    docs = _nations(spark, sf_dir)
    io.export_documents(docs, folder)
    lines = docs.select(F.explode(F.array(
        F.lit("# a comment"), F.lit("  "), F.concat(F.lit(" "), "id", F.when(F.col("n_nationkey") % 3 == 0, "x").otherwise("")), F.when(F.col("n_nationkey") < 3, "example-001").otherwise(""),
    )).alias("value"))
    lines.write.text(names)
    return io.documents_by_id(spark, folder, io.id_list(spark, names)).select("id", F.col("raw").isNotNull().alias("found"))


@query("SELECT n_regionkey % 2 AS half, count(DISTINCT n_regionkey) AS n FROM nation GROUP BY 1")
def distinct_ids(spark, sf_dir):
    names = io.shared_folder(spark, "ids")
    table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("value")).write.text(names)
    return io.id_list(spark, names, distinct=True).groupBy((F.col("id").cast("int") % 2).alias("half")).agg(F.count("*").alias("n"))


@query("SELECT max(n_nationkey) + 1 AS next_id FROM nation")
def next_id_of_files(spark, sf_dir):
    """File names of two folders."""
    folders, docs = [io.shared_folder(spark, f"listing{k}") for k in (0, 1)], _nations(spark, sf_dir)
    for k, folder in enumerate(folders):
        io.export_documents(docs.where(F.col("n_nationkey") % 2 == k), folder)
    return knobs.next_id(io.file_names(spark, *[f"{f}/*.json" for f in folders]))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a conversation; every fifth has no id; conversations of even number are for training."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    k = F.col("conv_id")
    return turns.select(
        "conv_id", F.when(k % 5 != 0, k.cast("string")).alias("id"), F.when(k % 2 == 0, "train").otherwise("eval").alias("split"),
        F.transform("t", lambda x: F.struct(x.role.alias("role"), x.text.alias("content"))).alias("messages"),
    )


@query("""SELECT CASE WHEN conv_id % 2 = 0 THEN 'train' ELSE 'eval' END AS split, count(DISTINCT conv_id) FILTER (conv_id % 5 <> 0) AS n, count(DISTINCT conv_id) FILTER (conv_id % 5 = 0) AS skipped,
  CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1""")  # fmt: skip
def records_by_split(spark, sf_dir):
    folder = io.shared_folder(spark, "records")
    io.write_records(_records(spark, sf_dir), folder)
    files = {s: f"{folder}/split={s}" for s in ("train", "eval")}
    chars = io.dataset(spark, files).select("split", F.aggregate("messages", F.lit(0).cast("long"), lambda s, m: s + F.length(m.content)).alias("c")).groupBy("split").agg(F.sum("c").alias("chars"))
    for name, read in (("n", io.records), ("skipped", io.without_id)):
        one = [read(spark, path).agg(F.count("*").alias(name)).withColumn("split", F.lit(s)) for s, path in files.items()]
        chars = chars.join(one[0].unionByName(one[1]), "split")
    return chars.select("split", "n", "skipped", "chars")


@query("""SELECT CASE WHEN conv_id % 2 = 0 THEN 'train' ELSE 'eval' END AS split, count(DISTINCT conv_id) FILTER (conv_id % 5 <> 0) AS n, count(DISTINCT conv_id) FILTER (conv_id % 5 = 0) AS skipped,
  count(DISTINCT conv_id) AS lines FROM conversations GROUP BY 1""")  # fmt: skip
def records_read_once(spark, sf_dir):
    """Records, and what the same pass skipped."""
    folder = io.shared_folder(spark, "records")
    io.write_records(_records(spark, sf_dir), folder)
    rows = []
    for split in ("train", "eval"):
        found, seen = io.records_counted(spark, f"{folder}/split={split}")
        n = found.agg(F.count("messages")).first()[0]
        rows.append((split, n, seen.get["skipped"], seen.get["lines"]))
    return spark.createDataFrame(rows, "split string, n long, skipped long, lines long")


def _feed_files(spark: SparkSession, sf_dir: str) -> str:
    """Pages as portions of three feeds, a hundred pages a file: RSS, a wiki dump and JSON lines; the last RSS file breaks off."""
    folder = io.shared_folder(spark, "feeds")
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    i, url, html = F.col("page_id").cast("string"), F.col("url"), F.regexp_replace("html", r"\r\n?|[\x00-\x08\x0B\x0C\x0E-\x1F]", "\n")
    forms = {
        "news": (".rss", "<rss><channel><title>all</title>", F.concat(F.lit("<item><guid>"), i, F.lit("</guid><link>"), plain(url), F.lit("</link><description>"), plain(html), F.lit("</description></item>")), "</channel></rss>"),
        "wiki": (".wiki.xml", '<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/">', F.concat(F.lit("<page><title>"), plain(url), F.lit("</title><id>"), i, F.lit("</id><revision><id>9</id><text>"), plain(html), F.lit("</text></revision></page>")), "</mediawiki>"),
        "docs": (".jsonl", "", F.concat(F.to_json(F.struct(i.alias("id"), url.alias("url"), html.alias("text"))), F.lit("\n")), "not json"),
    }
    for k, (feed, (end, head, item, foot)) in enumerate(forms.items()):
        pages = table(spark, sf_dir, "pages").where((F.col("page_id") % 3 == k) & F.col("html").isNotNull())
        files = pages.groupBy(F.floor(F.col("page_id") / 300).alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", item.alias("x")))), lambda s: s.x), "").alias("items"))
        cut = (F.col("part") == 0) if feed == "news" else F.lit(False)
        named = files.select(F.concat_ws("-", F.lit(feed), "part").alias("name"), F.concat(F.lit(head), "items", F.when(cut, F.lit("<item><guid>")).otherwise(F.lit(foot))).alias("text"))
        named_files.register(spark)
        named.write.format("named_files").mode("append").option("suffix", end).save(folder)
    return folder


_FEEDS = r"""WITH p AS (SELECT page_id, ['news', 'wiki', 'docs'][1 + page_id % 3] AS feed, url, regexp_replace(html, '\r\n?|[\x00-\x08\x0B\x0C\x0E-\x1F]', chr(10), 'g') AS html FROM pages WHERE html IS NOT NULL)
  SELECT feed, page_id::VARCHAR AS item_id, url AS place, md5(html) AS text_md5, false AS broken FROM p {where}"""
_BROKEN = """ UNION ALL SELECT 'docs', NULL, NULL, NULL, true FROM (SELECT DISTINCT page_id // 300 FROM p WHERE feed = 'docs') UNION ALL SELECT DISTINCT 'news', NULL, NULL, NULL, true FROM p WHERE feed = 'news' AND page_id // 300 = 0"""


def _feed_rows(found: DataFrame) -> DataFrame:
    return found.select("feed", "item_id", F.coalesce("link", "title").alias("place"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("error").isNotNull().alias("broken"))


@query(_FEEDS.format(where="") + _BROKEN)
def feed_items(spark, sf_dir):
    return _feed_rows(feeds.register(spark).read.format("feed").load(_feed_files(spark, sf_dir)))


@query(_FEEDS.format(where="WHERE feed = 'wiki'"))
def feed_items_of_one(spark, sf_dir):
    """The condition chooses files before any is opened."""
    return _feed_rows(feeds.register(spark).read.format("feed").load(_feed_files(spark, sf_dir)).where("feed = 'wiki'"))


@query(_FEEDS.format(where="") + _BROKEN)
def feed_items_streamed(spark, sf_dir):
    folder, out = _feed_files(spark, sf_dir), io.shared_folder(spark, "feed-stream")
    rows = _feed_rows(feeds.register(spark).readStream.format("feed").load(folder))
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("""WITH l AS (SELECT event_id % 50 AS run, event_id // 50 AS step, CASE WHEN event_id % 4 = 0 THEN value END AS loss, value FROM events),
  c AS (SELECT *, last_value(loss IGNORE NULLS) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS last_loss, max(value) OVER (PARTITION BY run, CAST(ceil(step / 5.0) AS BIGINT)) AS tick_peak FROM l)
  SELECT run, step, last_loss, tick_peak FROM c WHERE step <> 0 AND step % 5 = 0""")  # fmt: skip
def carried_ticks_streamed(spark, sf_dir):
    """The log arrives in four files, even steps before odd ones, and the stream is started again for each."""
    folder = io.shared_folder(spark, "carried-ticks")
    ticks.prepare(spark, ends=True)
    loss = F.when(F.col("event_id") % 4 == 0, F.col("value"))
    log = table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("run"), F.floor(F.col("event_id") / 50).alias("step"), loss.alias("loss"), F.col("value").alias("peak"))
    for k in (0, 2, 1, 3):
        log.where(F.col("step") % 4 == k).write.mode("append").parquet(f"{folder}/in")
        stream = ticks.ticks(spark.readStream.schema(log.schema).parquet(f"{folder}/in"))
        keep = lambda rows, n: rows.write.mode("append").parquet(f"{folder}/out")
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return ticks.latest(spark.read.parquet(f"{folder}/out"))


@query("""WITH c AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS line FROM (SELECT DISTINCT conv_id FROM conversations))
  SELECT 'first' AS kind, CASE WHEN conv_id % 5 = 0 THEN 'line' || line ELSE conv_id::VARCHAR END AS id FROM c WHERE line < 7
  UNION ALL SELECT 'limit', conv_id::VARCHAR FROM (SELECT * FROM c WHERE conv_id % 5 <> 0 ORDER BY conv_id LIMIT 7)
  UNION ALL SELECT 'one', CASE WHEN conv_id % 5 = 0 THEN 'line0' ELSE conv_id::VARCHAR END FROM c WHERE line = 0""")
def first_records(spark, sf_dir):
    """The first lines, the first records with an id, and the first record, of one file."""
    path = io.shared_folder(spark, "one-file")
    _records(spark, sf_dir).orderBy("conv_id").coalesce(1).select("id", "messages").write.json(path)
    kinds = {"first": io.records(spark, path, first=7), "limit": io.records(spark, path, limit=7), "one": io.first_record(spark, path)}
    out = None
    for kind, found in kinds.items():
        one = found.select(F.lit(kind).alias("kind"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT conv_id || '-' || turn AS id, CASE WHEN (conv_id + turn) % 3 = 0 THEN length(text) END AS chars FROM conversations WHERE text IS NOT NULL")
def written_predictions(spark, sf_dir):
    """Raw texts of all, objects of those that have one."""
    folder = io.shared_folder(spark, "predictions")
    good = (F.col("conv_id") + F.col("turn")) % 3 == 0
    raw = F.when(good, F.to_json(F.struct(F.col("text").alias("t")))).otherwise("no object")
    io.write_predictions(table(spark, sf_dir, "conversations").where("text is not null").select(F.concat_ws("-", "conv_id", "turn").alias("id"), raw.alias("raw")), folder)
    objects = spark.read.parquet(f"{folder}/json").select("id", F.length(F.get_json_object("json", "$.t")).cast("long").alias("chars"))
    return spark.read.parquet(f"{folder}/raw").join(objects, "id", "left").select("id", "chars")


@query("""SELECT 'quarantine' AS kind, 'FAILED-batch7-row' || lpad(n_nationkey::VARCHAR, 2, '0') AS name FROM nation UNION ALL SELECT 'log', n_name FROM nation UNION ALL SELECT 'log', r_name FROM region
  UNION ALL SELECT 'sanity ' || n_regionkey, '=== ' || n_name FROM nation""")  # fmt: skip
def written_logs(spark, sf_dir):
    """Failures, a log appended to twice, and raw texts of checkpoints."""
    folder = io.shared_folder(spark, "logs")
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    io.quarantine(nations.select(F.col("n_nationkey").alias("row"), F.lit("no block").alias("errors")), f"{folder}/failed", 7)
    for names in (nations.select(F.col("n_name").alias("name")), regions.select(F.col("r_name").alias("name"))):
        io.append_log(names, f"{folder}/log")
    io.write_sanity(nations.select(F.col("n_regionkey").alias("step"), F.col("n_name").alias("id"), F.lit("text").alias("text")), folder)
    read = lambda kind, path: spark.read.json(path).select(F.lit(kind).alias("kind"), "name")
    sanity = spark.read.text(f"{folder}/sanity").where("value like '===%'").select(F.concat(F.lit("sanity "), F.col("step").cast("string")).alias("kind"), F.col("value").alias("name"))
    return read("quarantine", f"{folder}/failed").unionByName(read("log", f"{folder}/log")).unionByName(sanity)


@query("SELECT s_suppkey AS account_id, s_nationkey AS dc_code FROM supplier WHERE s_acctbal > 0")
def upstream_rows(spark, sf_dir):
    return io.upstream(spark, {"format": "parquet", "path": f"{sf_dir}/supplier.parquet", "columns": {"s_suppkey": "account_id", "s_nationkey": "dc_code"}, "where": "s_acctbal > 0"})


@query("SELECT event_id % 50 AS run, CAST(ceil((event_id // 50) / 5.0) AS BIGINT) AS tick, max(value) AS tick_peak FROM events WHERE event_id // 50 > 0 GROUP BY 1, 2")
def streamed_ticks(spark, sf_dir):
    """The log arrives as a stream of files."""
    folder = io.shared_folder(spark, "ticks")
    source = f"{sf_dir}/event[s].parquet"
    log = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    log = log.select((F.col("event_id") % 50).alias("run"), F.floor(F.col("event_id") / 50).alias("step"), F.col("value").alias("peak_alloc_gb"))
    ticks = score.step_ticks(log, run="run")
    keep = lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/out")
    ticks.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("run", "tick").agg(F.max("tick_peak").alias("tick_peak"))


@query("SELECT 'example-' || lpad(n_nationkey::VARCHAR, 3, '0') AS id, false AS schema_valid, CASE WHEN n_nationkey % 2 = 0 THEN 'qbr' ELSE '?' END AS surface FROM nation")
def streamed_scores(spark, sf_dir):
    """Briefs of which every other is cut off arrive as files."""
    folder = io.shared_folder(spark, "arriving")
    k = F.col("n_nationkey")
    whole = table(spark, sf_dir, "nation").select(knobs.id_name(k).alias("id"), F.to_json(F.struct(F.lit("qbr").alias("surface"), F.col("n_name").alias("name"))).alias("raw"), k)
    text = F.when(k % 2 == 0, F.col("raw")).otherwise(F.substring("raw", F.lit(1), F.length("raw") - 1))
    whole.select("id", text.alias("value")).write.option("maxRecordsPerFile", 1).partitionBy("id").text(f"{folder}/in")
    files = spark.readStream.format("text").option("wholetext", "true").schema("value string, id string").load(f"{folder}/in")
    score.score_stream(files.select("id", F.col("value").alias("raw")), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("id", "schema_valid", "surface")


@query(f"WITH {EXPECTED_SQL} SELECT id, schema_valid, surface, CAST(cov_n AS INT) AS cov_n, CAST(cov_d AS INT) AS cov_d FROM sc")
def streamed_brief_scores(spark, sf_dir):
    """All briefs arrive as files of JSON lines, a few files a batch; whole ones and broken ones are scored as they come."""
    folder = io.shared_folder(spark, "arriving")
    briefs(spark, sf_dir).select("id", "raw").write.json(f"{folder}/in")
    arriving = spark.readStream.schema("id string, raw string").option("maxFilesPerTrigger", 3).json(f"{folder}/in")
    score.score_stream(arriving, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("id", "schema_valid", "surface", F.col("cov_n").cast("int").alias("cov_n"), F.col("cov_d").cast("int").alias("cov_d"))


@query("SELECT n_name AS name, length(n_name) AS chars FROM nation WHERE n_nationkey = 7")
def resource_text(spark, sf_dir):
    path = io.shared_folder(spark, "resource")
    table(spark, sf_dir, "nation").where("n_nationkey = 7").coalesce(1).select(F.col("n_name").alias("value")).write.text(path)
    name = jsonx.strip(F.lit(io.resource(spark, path)))
    return spark.range(1).select(name.alias("name"), F.length(name).cast("long").alias("chars"))
