"""Extraction and parsing against hand-derived expectations."""

import json

from pyspark.sql import functions as F

from docloom.functions import jsonx


def rows(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column(F.col("t")).alias("x"))
    return [r.x for r in df.orderBy("i").collect()]


def test_fenced_or_braced(spark):
    texts = ["a\n```json\n{\"a\": 1}\n```\nb", 'pre {"a":"}"} post', "none", '{"a":1', "```json \n ```", 'x {"a":{"b":1}} y {"c":2}', None, ""]
    assert rows(spark, texts, jsonx.fenced_or_braced) == ['{"a": 1}', '{"a":"}', None, None, "", '{"a":{"b":1}}', None, None]


def test_first_object(spark):
    texts = ['{"a":1}{"_meta":{}}', 'pre {"a":"}"} post', '```json {"a":1}\nx', '```json {"a":1}', '{"a":NaN}', "[1]", "", None, '```json\n{"a":2}\n```', '{"a":1,"a":3}']
    got = [None if x is None else json.loads(x) for x in rows(spark, texts, lambda t: F.to_json(jsonx.first_object(t)))]
    assert got == [{"a": 1}, {"a": "}"}, None, {"a": 1}, None, None, None, None, {"a": 2}, {"a": 3}]


def test_parse_strict(spark):
    texts = ['{"a":1}', ' {"a":1}\n', '{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1}] junk', '{"a":', "", "3", "[]", None]
    got = rows(spark, texts, lambda t: jsonx.parse_strict(t).isNotNull())
    assert got == [True, True, False, False, False, False, False, False, True, True, False]


def test_missing_is_not_null(spark):
    v = lambda t: F.try_parse_json(t)
    assert rows(spark, ['{"a":null}', "{}"], lambda t: jsonx.get(v(t), "a").isNotNull()) == [True, False]


def test_strip_takes_any_white_space(spark):
    assert rows(spark, ["  a b\t\n", "  ", None], jsonx.strip) == ["a b", "", None]
    assert rows(spark, [" ", "x"], jsonx.not_blank) == [False, True]
