"""Runs over folders: ``python -m docloom.cli plan|format|predictions|eval ...``; anything Spark reads and writes can be a folder.

The exit code is 0 if all went well, 1 if there is nothing to work on or a gate is missed, 2 if a run may not start.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docloom.functions.jsonx import configure
from docloom.functions.vocab import ACCOUNT_SHAPES, SOURCE_MIXES, SURFACES
from docloom.operators import knobs, metrics, records
from docloom.plans import report
from docloom.sources import io


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docloom", description=__doc__.split("\n")[0])
    commands = p.add_subparsers(dest="command", required=True)
    plan = commands.add_parser("plan", help="parameter rows of a generation run, as JSON lines")
    plan.add_argument("--surface", required=True, choices=SURFACES)
    plan.add_argument("--count", type=int, default=1)
    plan.add_argument("--shape", choices=ACCOUNT_SHAPES)
    plan.add_argument("--source-mix", choices=SOURCE_MIXES)
    plan.add_argument("--edge-cases", help="comma-separated")
    plan.add_argument("--seed", type=int, default=42)
    plan.add_argument("--cap", type=float, default=knobs.COST_CAP, help="dollars that the run may cost")
    plan.add_argument("--dry-run", action="store_true", help="say what it would cost, write nothing")
    plan.add_argument("--out", required=True)
    form = commands.add_parser("format", help="documents to chat records, split by a list of eval ids")
    for name, text in (("docs", "folder of {id}.json"), ("prompt", "file of the system prompt"), ("eval-ids", "file of ids"), ("out", "folder")):
        form.add_argument(f"--{name}", required=True, help=text)
    form.add_argument("--on-bad", choices=("fail", "quarantine"), default="fail")
    keep = commands.add_parser("predictions", help="generated texts (JSON lines of id, raw) to raw texts and objects; what was there goes")
    keep.add_argument("--texts", required=True)
    keep.add_argument("--out", required=True)
    check = commands.add_parser("eval", help="report card of documents or predictions")
    source = check.add_mutually_exclusive_group(required=True)
    source.add_argument("--gold", help="folder of {id}.json")
    source.add_argument("--model", help="folder that 'predictions' wrote")
    check.add_argument("--eval-ids", required=True)
    check.add_argument("--missing", choices=("drop", "count"), default="drop")
    check.add_argument("--gate", action="store_true", help="exit 1 if a target is missed")
    return p


def plan(spark: SparkSession, a: argparse.Namespace) -> int:
    against = knobs.gates(spark, a.count, a.cap, a.dry_run)
    if against:
        print("\n".join(against), file=sys.stderr)
        return 2
    print(f"{a.count} rows, about ${spark.range(1).select(knobs.cost(F.lit(a.count))).first()[0]:.2f}")
    if a.dry_run:
        return 0
    cases = [c.strip() for c in a.edge_cases.split(",") if c.strip()] if a.edge_cases else None
    knobs.stamped(knobs.matrix(spark, a.surface, a.count, a.shape, cases, a.source_mix, seed=a.seed), time.time()).write.mode("overwrite").json(a.out)
    return 0


def format_records(spark: SparkSession, a: argparse.Namespace) -> int:
    docs = io.documents(spark, f"{a.docs}/*.json")
    found = records.chat_records(docs, io.resource(spark, a.prompt), on_bad=a.on_bad)
    io.write_records(records.split(found, io.id_list(spark, a.eval_ids, distinct=True)), a.out)
    done = io.dataset(spark, {"records": f"{a.out}/split=*"})
    if done.isEmpty():
        print("no documents", file=sys.stderr)
        return 1
    for r in records.summary(found).orderBy("surface").collect():
        print(f"{r.surface}: {r.n} records, {r.n_warnings} without a known shape")
    return 0


def predictions(spark: SparkSession, a: argparse.Namespace) -> int:
    texts = spark.read.schema("id string, raw string").json(a.texts).where("id is not null")
    io.write_predictions(texts, a.out)
    n, parsed = (spark.read.parquet(f"{a.out}/{kind}").count() for kind in ("raw", "json"))
    print(f"{n} texts, {parsed} with an object")
    return 0 if n else 1


def evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    ids = io.id_list(spark, a.eval_ids)
    docs = io.documents(spark, f"{a.gold}/*.json").select("id", "raw") if a.gold else spark.read.parquet(f"{a.model}/json").select("id", F.col("json").alias("raw"))
    scores = metrics.score(docs.join(ids.distinct(), "id", "left_semi"))
    joined = report.join_predictions(ids, scores, a.missing)
    if joined.isEmpty():
        print("no predictions of the listed ids", file=sys.stderr)
        return 1
    for r in report.card(joined, ids).orderBy("part", "line").collect():  # a bounded number of lines
        print(f"[{r.part[2:]}] {r.line}")
    passed = report.report(joined).where(F.col("surface") == report.OVERALL).first().gate_passed
    return 1 if a.gate and not passed else 0


COMMANDS = {"plan": plan, "format": format_records, "predictions": predictions, "eval": evaluate}


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = configure(SparkSession.builder.appName(f"docloom {a.command}").getOrCreate())
    return COMMANDS[a.command](spark, a)


if __name__ == "__main__":
    sys.exit(main())
