"""Generation plans and their outcomes: seeded parameter matrices, costs, ids, attempt logs."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.jsonx import fenced_or_braced, fields, parse_strict
from docloom.functions.vocab import ACCOUNT_SHAPES, EDGE_CASES, SOURCE_MIXES, SURFACES
from docloom.operators.records import prompt
from docloom.operators.validate import shown, violations

# Tokens and prices behind the cost estimate, and the default cap.
INPUT_TOKENS, OUTPUT_TOKENS, INPUT_PRICE, OUTPUT_PRICE, RETRY_FACTOR, COST_CAP = 6000, 6000, 3.0, 15.0, 1.3, 20.0
#: Planned examples by surface.
BATCH_PLAN = {s: 60 if s == "meeting_prep" else 100 for s in SURFACES}


def draw(seed: int, row: Column, slot: str, buckets: int) -> Column:
    """A number in 0..buckets-1 from the first 28 bits of md5(seed:row:slot)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string"), F.lit(slot)))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") % buckets


def matrix(
    spark: SparkSession, surface: str, count: int, shape: str | None = None, edge_cases: list[str] | None = None, source_mix: str | None = None,
    account_hint: str | None = None, seed: int = 42, rows: DataFrame | None = None,
) -> DataFrame:
    """``count`` parameter rows, or one for each of ``rows`` (row). Shape is uniform; 0, 1, 2 or 3 edge cases come with weights 2:4:3:1, without repeats; the mix is
    uniform over the mixes and none. Given slots override. Draws are hashes of seed and row, so rows are independent."""
    one_of("surface", surface or "", SURFACES), one_of("shape", shape or None, ACCOUNT_SHAPES), one_of("source_mix", source_mix or None, SOURCE_MIXES)
    row = F.col("row")
    pick = lambda options, slot: F.element_at(F.array(*[F.lit(o) for o in options]), (draw(seed, row, slot, len(options)) + 1).cast("int"))
    ten = draw(seed, row, "n", 10)
    n = F.when(ten < 2, 0).when(ten < 6, 1).when(ten < 9, 2).otherwise(3)
    order = F.array_sort(F.array(*[F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string"), F.lit(e))).alias("k"), F.lit(e).alias("e")) for e in EDGE_CASES]))
    chosen = F.transform(F.slice(order, F.lit(1), n), lambda x: x.e) if edge_cases is None else F.array(*[F.lit(e) for e in edge_cases]).cast("array<string>")
    numbered = spark.range(count).withColumnRenamed("id", "row") if rows is None else rows.select("row")
    params = numbered.withColumn("surface", F.lit(surface)).withColumns({
        "account_shape": F.lit(shape) if shape else pick(ACCOUNT_SHAPES, "shape"), "edge_cases": chosen,
        "source_mix": F.lit(source_mix) if source_mix else pick((*SOURCE_MIXES, None), "mix"), "account_hint": F.lit(account_hint).cast("string"),
    })
    return params.withColumn("prompt", prompt(F.col("surface"), F.col("account_shape"), F.col("edge_cases"), F.col("source_mix"), F.col("account_hint")))


def edge_case_list(argument: Column) -> Column:
    """A comma-separated argument as a list without blanks."""
    return F.filter(F.transform(F.split(argument, ","), lambda x: F.trim(x)), lambda x: x != "")


def cost(count: Column) -> Column:
    return count * (INPUT_TOKENS * INPUT_PRICE / 1e6 + OUTPUT_TOKENS * OUTPUT_PRICE / 1e6) * RETRY_FACTOR


def over_cap(count: Column, cap: float = COST_CAP) -> Column:
    return cost(count) > cap


def one_of(name: str, value: str | None, allowed: tuple | list) -> str | None:
    """``value``, if it is allowed or not given."""
    if value is not None and value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(map(str, allowed))}")
    return value


def exactly_one(**given) -> str:
    """The name of the only argument that is given (true)."""
    found = [k for k, v in given.items() if v]
    if len(found) != 1:
        raise ValueError(f"give exactly one of {', '.join(given)}")
    return found[0]


def gates(spark: SparkSession, count: int, cap: float = COST_CAP, dry_run: bool = False, files: tuple = (), free_gb: float | None = None, least_gb: float = 60.0) -> list[str]:
    """What stands against a run, nothing if it may start: cost over the cap (at the cap is fine), files that are absent, too
    little free disk. A dry run spends nothing, so its cost is not held against it."""
    found = []
    total = count * (INPUT_TOKENS * INPUT_PRICE / 1e6 + OUTPUT_TOKENS * OUTPUT_PRICE / 1e6) * RETRY_FACTOR
    if not dry_run and total > cap:
        found.append(f"cost {total:.2f} is over the cap of {cap:.2f}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    for f in files:
        if not path(f).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(f)):
            found.append(f"absent: {f}")
    if free_gb is not None and free_gb < least_gb:
        found.append(f"{free_gb:g} GB free, {least_gb:g} needed")
    return found


def planned() -> Column:
    """Map from surface to the examples planned for it."""
    return F.create_map(*[F.lit(x) for pair in BATCH_PLAN.items() for x in pair])


def run_summary(resolved: DataFrame) -> DataFrame:
    """One row: rows that succeeded, rows that failed, attempts in all."""
    return resolved.agg(F.count_if("success").alias("good"), F.count_if(~F.col("success")).alias("failed"), F.sum("attempts").alias("attempts"))


def next_id(names: DataFrame, column: str = "name", three_digits: bool = False) -> DataFrame:
    """One row: the largest id in names like ``example-007`` plus 1, from 1. ``three_digits`` reads the first three digits only."""
    digits = r"example-(\d{3})" if three_digits else r"example-(\d{3,})"
    found = F.nullif(F.regexp_extract(F.col(column), digits, 1), F.lit(""))
    return names.agg((F.coalesce(F.max(found.cast("long")), F.lit(0)) + 1).alias("next_id"))


def id_name(number: Column) -> Column:
    return F.format_string("example-%03d", number)


def judged(attempts: DataFrame) -> DataFrame:
    """Attempts (row, attempt, raw, api_error) with their outcome: ok, api, no_block, parse or schema, and the violations."""
    body = fenced_or_braced(F.col("raw"))
    v = F.col("_v")
    return (
        attempts.withColumn("_body", body).withColumn("_v", parse_strict(F.col("_body")))
        .withColumn("violations", F.when(v.isNotNull(), violations("_v")))
        .withColumn("outcome", F.when(F.col("api_error").isNotNull(), "api").when(F.col("_body").isNull(), "no_block").when(v.isNull(), "parse")
                    .when(F.size("violations") > 0, "schema").otherwise("ok"))
    )


def feedback(found: Column, outcome: Column, most: int = 15) -> Column:
    """What the next attempt is told, by kind of failure."""
    listed = F.array_join(F.transform(F.slice(found, 1, most), lambda x: F.concat(F.lit("- at "), shown(x))), "\n")
    return (
        F.when(outcome == "no_block", "No ```json``` block was found. Answer with the brief alone, in one fenced json block.")
        .when(outcome == "parse", "The JSON could not be parsed. Write it again with valid syntax.")
        .when(outcome == "schema", F.concat(F.lit("The brief breaks the contract in "), F.size(found).cast("string"), F.lit(" places:\n\n"), listed,
                                            F.lit("\n\nKeep the content, use only fields of the contract and its exact values.")))
    )


def resolve(attempts: DataFrame, retries: int = 3, outcome: str = "outcome") -> DataFrame:
    """One row per ``row``: attempts used, the first good attempt (NULL if none), success, the error log.

    At most ``retries`` attempts count; an API error ends a row at once.
    """
    stop = F.min(F.when(F.col(outcome).isin("ok", "api"), F.col("attempt")))
    log = F.sort_array(F.collect_list(F.when(F.col(outcome) != "ok", F.struct("attempt", F.col(outcome).alias("outcome")))))
    found = attempts.where(F.col("attempt") <= retries).groupBy("row").agg(
        stop.alias("_stop"), F.max("attempt").alias("_last"), F.min(F.when(F.col(outcome) == "ok", F.col("attempt"))).alias("_ok"), log.alias("_log")
    )
    used = F.coalesce("_stop", "_last")
    ok = F.col("_ok") == F.col("_stop")
    return found.select(
        "row", used.alias("attempts"), F.when(ok, F.col("_ok")).alias("good_attempt"), F.coalesce(ok, F.lit(False)).alias("success"),
        F.array_join(F.transform(F.filter("_log", lambda x: x.attempt <= used), lambda x: F.concat(x.attempt.cast("string"), F.lit(":"), x.outcome)), ",").alias("errors"),
    )


def running_ids(results: DataFrame, start: int, bucket_rows: int = 1_000_000) -> DataFrame:
    """Ids for successes only, in order of ``row``: failed rows get NULL and use up none.

    Ranges of rows are summed first, so the running count is not taken over all rows in one task.
    """
    ok = F.col("success").cast("long")
    dealt = results.withColumn("_b", F.floor(F.col("row") / bucket_rows))
    sums = dealt.groupBy("_b").agg(F.sum(ok).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("_b", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum(ok).over(Window.partitionBy("_b").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    numbered = dealt.join(sums, "_b").withColumn("example_id", F.when(F.col("success"), F.lit(start) + F.col("_before") + within - 1))
    return numbered.drop("_b", "_before")


def conversations(attempts: DataFrame, prompts: DataFrame, retries: int = 3) -> DataFrame:
    """(row, messages): the prompt, then each failed attempt with its feedback. API errors add nothing and end the row."""
    told = judged(attempts).where(F.col("attempt") <= retries)
    w = Window.partitionBy("row").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("_over", F.coalesce(F.max(F.col("outcome").isin("ok", "api").cast("int")).over(w), F.lit(0)))
    told = told.where("_over = 0 and outcome not in ('ok', 'api')")
    turns = told.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("attempt", "raw", feedback(F.col("violations"), F.col("outcome")).alias("reply")))).alias("_t"))
    pair = lambda t: F.array(F.struct(F.lit("assistant").alias("role"), t.raw.alias("content")), F.struct(F.lit("user").alias("role"), t.reply.alias("content")))
    first = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    more = F.coalesce(F.flatten(F.transform("_t", pair)), F.array().cast("array<struct<role:string,content:string>>"))
    return prompts.join(turns, "row", "left").select("row", F.concat(first, more).alias("messages"))


def objects(v: Column) -> Column:
    return fields(v).isNotNull()


def stamped(rows: DataFrame, started: float, name: str = "run") -> DataFrame:
    """Rows of one run with its stamp in UTC, as in ``20260131-235959``: the same for all rows, whenever a task runs."""
    stamp = datetime.fromtimestamp(started, UTC).strftime("%Y%m%d-%H%M%S")
    return rows.withColumn(name, F.lit(stamp))


def elapsed(attempts: DataFrame, began: str, ended: str, by: str = "row") -> DataFrame:
    """Per row of a run: seconds from its first attempt's begin to its last attempt's end; NULL while one of them has no end."""
    seconds = F.col(ended).cast("double") - F.col(began).cast("double")
    total = F.max(F.col(ended).cast("double")) - F.min(F.col(began).cast("double"))
    return attempts.groupBy(by).agg(F.when(F.count_if(F.col(ended).isNull()) == 0, total).alias("elapsed_s"), F.sum(seconds).alias("busy_s"))
