"""The commands over folders, from documents to a report card."""

import json
import os

import pytest

from docloom import cli


def test_plan_writes_rows_within_the_cap(spark, tmp_path, capsys):
    out = str(tmp_path / "plan")
    assert cli.main(["plan", "--surface", "qbr", "--count", "5", "--out", out]) == 0
    rows = spark.read.json(out).collect()
    assert len(rows) == 5 and {r.surface for r in rows} == {"qbr"} and len({r.run for r in rows}) == 1 and "5 rows, about $0.70" in capsys.readouterr().out
    assert cli.main(["plan", "--surface", "qbr", "--count", "500", "--out", out + "2"]) == 2 and not os.path.exists(out + "2")
    assert cli.main(["plan", "--surface", "qbr", "--count", "500", "--dry-run", "--out", out + "2"]) == 0 and not os.path.exists(out + "2")
    with pytest.raises(SystemExit):
        cli.main(["plan", "--surface", "nothing", "--out", out])


def test_documents_to_records_and_report(spark, tmp_path, capsys):
    docs = tmp_path / "docs"
    docs.mkdir()
    for k in range(6):
        (docs / f"example-00{k}.json").write_text(json.dumps({"surface": "qbr", "must_address": [], "_meta": {"shape_constraints": "enterprise"}}))
    (tmp_path / "prompt.txt").write_text("You write briefs.")
    (tmp_path / "ids.txt").write_text("# eval\nexample-001\n\nexample-004\nexample-009\n")
    out, ids = str(tmp_path / "records"), str(tmp_path / "ids.txt")
    assert cli.main(["format", "--docs", str(docs), "--prompt", str(tmp_path / "prompt.txt"), "--eval-ids", ids, "--out", out]) == 0
    assert {r.split: r["count"] for r in spark.read.json(out).groupBy("split").count().collect()} == {"train": 4, "eval": 2}
    assert "qbr: 6 records" in capsys.readouterr().out
    assert cli.main(["eval", "--gold", str(docs), "--eval-ids", ids]) == 0
    shown = capsys.readouterr().out
    assert "[surface] qbr 2" in shown and "[missing] example-009" in shown
    assert cli.main(["eval", "--gold", str(docs), "--eval-ids", ids, "--gate"]) == 1
    with pytest.raises(SystemExit):
        cli.main(["eval", "--gold", "a", "--model", "b", "--eval-ids", ids])


def test_texts_to_predictions_and_report(spark, tmp_path, capsys):
    (tmp_path / "texts.jsonl").write_text("\n".join(json.dumps({"id": f"e{k}", "raw": 'Here: {"surface": "qbr"} done' if k else "nothing"}) for k in range(4)))
    (tmp_path / "ids.txt").write_text("e0\ne1\ne2\n")
    out = str(tmp_path / "out")
    assert cli.main(["predictions", "--texts", str(tmp_path / "texts.jsonl"), "--out", out]) == 0
    assert "4 texts, 3 with an object" in capsys.readouterr().out
    assert cli.main(["eval", "--model", out, "--eval-ids", str(tmp_path / "ids.txt"), "--missing", "count"]) == 0
    assert "[total] OVERALL 3" in capsys.readouterr().out
    (tmp_path / "other.txt").write_text("x\n")
    assert cli.main(["eval", "--model", out, "--eval-ids", str(tmp_path / "other.txt")]) == 1
