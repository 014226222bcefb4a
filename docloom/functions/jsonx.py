"""JSON out of noisy text: fenced blocks, first objects, strict parsing, and access to VARIANT values. All JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_SENTINEL = "\\u0001end of value\\u0001"
_SENTINEL_TEXT = "\x01end of value\x01"


def configure(spark: SparkSession) -> SparkSession:
    """Duplicate keys: the last one wins, as in common decoders."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def strip(text: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def not_blank(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def parse_strict(text: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing else; NULL otherwise (for NaN too).

    The parser stops behind the first value. So the text is put into an array before a marker: unless the array has
    exactly the value and the marker, something else stood there.
    """
    both = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_SENTINEL}"]'))), "$", "array<variant>")
    alone = lambda a: (F.size(a) == 2) & (F.try_variant_get(F.try_element_at(a, F.lit(2)), "$", "string") == _SENTINEL_TEXT)
    return bind(both, lambda a: F.when(alone(a), F.try_element_at(a, F.lit(1))))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, and outside generated code, which keeps that small."""
    return F.transform(F.array(value), body)[0]


def fields(v: Column) -> Column:
    """Map of an object's fields; NULL for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def items(v: Column) -> Column:
    """Elements of a list; NULL for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def get(v: Column, *path: str) -> Column:
    """The value at a path of field names: SQL NULL if missing, VARIANT null if it is JSON null."""
    return F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path), "variant")


def get_string(v: Column, *path: str) -> Column:
    """The string at a path; NULL for other types."""
    x = get(v, *path)
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def fenced_or_braced(text: Column) -> Column:
    """The block of the first ```json fence, stripped; without a fence the first balanced braces, strings not regarded.

    NULL if there is neither; '' for a fence of white space only. Braces are folded run by run, not sign by sign.
    """
    fence = r"(?s)```json\s*(.+?)```"
    tail = F.substring(text, F.locate("{", text), F.length(text))
    runs = F.regexp_extract_all(tail, F.lit(r"(?s)[^{}]*[{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    end = F.aggregate(
        runs, start,
        lambda a, run: F.when(a.done, a).otherwise(
            F.struct(
                (a.depth + F.when(run.endswith("{"), 1).otherwise(-1)).alias("depth"), (a.n + F.length(run)).alias("n"),
                (a.depth + F.when(run.endswith("{"), 1).otherwise(-1) == 0).alias("done"),
            )
        ),
    )
    braced = F.when(end.done, F.substring(tail, F.lit(1), end.n))
    return F.when(text.rlike(fence), strip(F.regexp_extract(text, fence, 1))).when(F.locate("{", text) > 0, braced)


def first_object(text: Column) -> Column:
    """VARIANT of the first complete object, whatever follows it. A leading fence line is dropped whole. NULL if none parses."""
    bare = strip(text)
    newline = F.locate("\n", bare)
    body = F.when(bare.startswith("```") & (newline > 0), F.substring(bare, newline + 1, F.length(bare))).otherwise(bare)
    v = F.try_parse_json(F.when(F.locate("{", body) > 0, F.substring(body, F.locate("{", body), F.length(body))))
    return F.when(fields(v).isNotNull(), v)


def without_field(v: Column, name: str) -> Column:
    """An open object as a map without one of its fields."""
    return F.map_filter(fields(v), lambda k, _: k != name)
