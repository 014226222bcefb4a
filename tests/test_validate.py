"""One mutant per keyword and place, an independent plain validator, and metamorphic checks."""

import copy
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import jsonx
from docloom.functions.contract import BRIEF, List, Map, spark_type
from docloom.operators.metrics import score
from docloom.operators.validate import violations

SRC = [{"type": "news", "ref": None, "snippet": "s"}]
GOOD = {
    "account": {"name": "A", "type": None}, "surface": "qbr", "generated_at": "soon", "executive_summary": "", "confidence": {"overall": "low", "per_section": {"renewal": "high"}},
    "empty_sections": ["timeline"], "sources_used": ["news", "email"],
    "must_address": [{"topic": "t", "urgency": "low", "what_happened": "w", "open_in_meeting": "o", "sources": SRC}],
    "pipeline": {"items": [{"name": "n", "stage": "s", "amount": None, "probability": 0.5, "sources": []}]},
    "support_health": {"open_cases_count": 2.0, "items": [{"case_number": "1", "subject": "s", "priority": None, "status": "x"}], "trend": None},
    "relationship_map": {"champions": [{"name": "c", "engagement": None, "sources": SRC}]}, "recent_activity": [{"date": "d", "type": "call", "summary": "s"}],
    "renewal": {"days_to_renewal": None, "risk_signals": [{"signal": "s", "severity": "low"}]}, "_meta": {"anything": [1]},
}


def plain(x, kind, path=""):
    """Violations by a plain recursive walk, as a check on the compiled column."""
    at = lambda n: f"{path}/{n}" if path else str(n)
    if isinstance(kind, dict):
        if not isinstance(x, dict):
            return [(path, "type")]
        names = {k.rstrip("!"): v for k, v in kind.items()}
        out = [(path, "additionalProperties")] if set(x) - set(names) else []
        out += [(path, "required") for k in kind if k[-1] == "!" and k[:-1] not in x]
        return out + [e for k, v in x.items() if k in names for e in plain(v, names[k], at(k))]
    if isinstance(kind, Map):
        return [e for k, v in x.items() for e in plain(v, kind.of, at(k))] if isinstance(x, dict) else [(path, "type")]
    if isinstance(kind, List):
        if not isinstance(x, list):
            return [(path, "type")]
        out = [(path, "maxItems")] if kind.most is not None and len(x) > kind.most else []
        out += [(path, "uniqueItems")] if kind.unique and len({json.dumps(i, sort_keys=True) for i in x}) < len(x) else []
        return out + [e for i, v in enumerate(x) for e in plain(v, kind.of, at(i))]
    if isinstance(kind, tuple):
        out = [] if isinstance(x, str) or x is None and None in kind else [(path, "type")]
        return out + ([] if isinstance(x, (str, type(None))) and x in kind else [(path, "enum")])
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    ok = {"str": isinstance(x, str), "num": number, "int": number and math.floor(x) == x, "obj": isinstance(x, dict)}[kind[:3]] or "?" in kind and x is None
    out = [] if ok else [(path, "type")]
    return out + ([(path, "minimum")] if ">=" in kind and number and x < 0 else [])


def found(spark, docs):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, raw string").withColumn("v", jsonx.parse_strict(F.col("raw")))
    return [[(e.path, e.keyword) for e in r.x] for r in df.select("i", violations("v").alias("x")).orderBy("i").collect()]


def mutants(rng, n):
    junk = [None, 1, -1, 1.0, 2.5, True, "zzz", [], {}, ["a", "a"], [{"x": 1}], "high", {"name": 3}]
    for _ in range(n):
        d = copy.deepcopy(GOOD)
        for _ in range(rng.randint(1, 3)):
            node = d
            while True:
                keys = list(node) if isinstance(node, dict) else range(len(node))
                if not keys:
                    break
                k = rng.choice(list(keys))
                if isinstance(node[k], (dict, list)) and node[k] and rng.random() < 0.75:
                    node = node[k]
                    continue
                act = rng.random()
                if act < 0.25 and isinstance(node, dict):
                    del node[k]
                elif act < 0.35 and isinstance(node, dict):
                    node["extra"] = 1
                elif act < 0.45 and isinstance(node, list):
                    node.extend(copy.deepcopy(node[:1] * 30))
                else:
                    node[k] = rng.choice(junk)
                break
        yield d


def test_good_document_is_valid(spark):
    assert found(spark, [GOOD]) == [[]]


def test_mutants_agree_with_a_plain_walk(spark):
    docs = list(mutants(random.Random(3), 400)) + [[], "x", 3, None, {}]
    for doc, got in zip(docs, found(spark, docs), strict=True):
        assert sorted(got) == sorted(plain(doc, BRIEF)), doc


@pytest.mark.parametrize(
    "path, value, expected",
    [
        (("pipeline", "items", 0, "amount"), 210000, [("pipeline/items/0/amount", "type")]),
        (("support_health", "open_cases_count"), True, [("support_health/open_cases_count", "type")]),
        (("support_health", "open_cases_count"), -1, [("support_health/open_cases_count", "minimum")]),
        (("sources_used",), ["news", "news"], [("sources_used", "uniqueItems")]),
        (("talking_points",), list("abcdef"), [("talking_points", "maxItems")]),
        (("confidence", "per_section"), {"renewal": "sure"}, [("confidence/per_section/renewal", "enum")]),
        (("surface",), 3, [("surface", "enum"), ("surface", "type")]),
        (("account", "tier"), 1, [("account", "additionalProperties")]),
    ],
)
def test_one_violation(spark, path, value, expected):
    d = copy.deepcopy(GOOD)
    node = d
    for k in path[:-1]:
        node = node[k]
    node[path[-1]] = value
    assert found(spark, [d]) == [expected]


def test_missing_key_and_null_differ(spark):
    d = copy.deepcopy(GOOD)
    del d["support_health"]["items"][0]["priority"]
    assert found(spark, [d]) == [[("support_health/items/0", "required")]]


def scores(spark, docs):
    df = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "id int, raw string")
    return [(r.surface, r.schema_valid, r.cov_n, r.cov_d, r.attr_n, r.attr_d) for r in score(df).orderBy("id").collect()]


def test_scores_by_hand(spark):
    esc = {"surface": "escalation", "empty_sections": ["must_address", "support_health", "recent_activity", "asks_and_next_steps"]}
    act = {"surface": "renewal_alert", "renewal": {"days_to_renewal": 30}, "carryover": " ", "recent_activity": [{"sources": []}, {"sources": [1]}, "x"], "relationship_map": {"blockers": [{"sources": [1]}]}}
    got = scores(spark, [esc, act, {"surface": "other"}, "{bad", "[]", {"surface": 3, "empty_sections": "renewal"}])
    assert [g[0] for g in got] == ["escalation", "renewal_alert", "other", "?", "?", "?"]
    assert [g[2:4] for g in got] == [(4, 4), (1, 9), (0, 0), (0, 1), (0, 1), (0, 0)]
    assert [g[4:] for g in got] == [(0, 0), (1, 2), (0, 0), (0, 0), (0, 0), (0, 0)]


def test_metamorphic(spark):
    more = copy.deepcopy(GOOD)
    more["_meta"] = {"x": 1}
    shuffled = dict(reversed(list(GOOD.items())))
    sourced = copy.deepcopy(GOOD)
    sourced["pipeline"]["items"][0]["sources"] = SRC
    empty = copy.deepcopy(GOOD)
    empty["empty_sections"].append("landmines")
    a, b, c, d, e = scores(spark, [GOOD, more, shuffled, sourced, empty])
    assert a == b == c and d[4] == a[4] + 1 and e[2] >= a[2]


def test_typed_projection_parses(spark):
    ddl = spark_type().replace("`_meta`: variant, ", "")
    assert spark.sql(f"select from_json('{json.dumps(GOOD)}', '{ddl}') as d").select("d.account.name").first()[0] == "A"
