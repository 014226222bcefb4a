"""Chat records from briefs: reconstructed prompts, message lists, splits, chat text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.jsonx import fields, get, get_string, items, parse_strict, without_field
from docloom.functions.vocab import ACCOUNT_SHAPES, EDGE_CASE_HINTS, SOURCE_MIXES

# The words that decide between shapes when no shape is named, in order.
SHAPE_CUES = (
    (("mid-market", "midmarket"), "mid_market_active", ("active", "high engagement", "multi-deal", "expanding pipeline"), "mid_market_quiet"),
    (("enterprise",), "enterprise_expanding", ("expanding", "expansion", "growth"), "enterprise_steady"),
    (("small", "strategic"), "small_strategic", (), None),
    (("stalled", "at risk", "at-risk"), "stalled_at_risk", (), None),
    (("handoff", "hand-off"), "fresh_handoff", (), None),
    (("incident", "p1"), "incident_acute", (), None),
)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def shape(constraints: Column) -> Column:
    """The leftmost named shape, in any case; else by the first group of cues that applies; else NULL."""
    low = F.lower(F.coalesce(constraints, F.lit("")))
    named = F.nullif(F.regexp_extract(low, "(" + "|".join(ACCOUNT_SHAPES) + ")", 1), F.lit(""))
    guess = F.lit(None).cast("string")
    for words, found, more, otherwise in reversed(SHAPE_CUES):
        value = F.when(_any(low, more), found).otherwise(otherwise) if more else F.lit(found)
        guess = F.when(_any(low, words), value).otherwise(guess)
    return F.coalesce(named, guess)


def source_mix(constraints: Column) -> Column:
    """The leftmost named mix, case kept, anywhere in a word; NULL if none."""
    return F.nullif(F.regexp_extract(F.coalesce(constraints, F.lit("")), "(" + "|".join(SOURCE_MIXES) + ")", 1), F.lit(""))


def edge_cases(entries: Column, include_canonical: bool = False) -> Column:
    """Tokens told by descriptions, in order of discovery and each once.

    An entry takes the first token of the table that matches and isn't taken yet, so a repeated entry may fall through to a
    later token. With ``include_canonical`` a token's own name tells it, too.
    """
    table = F.array(*[
        F.struct(F.lit(t).alias("token"), F.array(*[F.lit(h) for h in (*hints, *((t,) if include_canonical else ()))]).alias("hints"))
        for t, hints in EDGE_CASE_HINTS.items()
    ])

    def step(taken: Column, entry: Column) -> Column:
        fits = F.filter(table, lambda r: F.exists(r.hints, lambda h: F.lower(entry).contains(h)) & ~F.array_contains(taken, r.token))
        return F.concat(taken, F.slice(F.transform(fits, lambda r: r.token), 1, 1))

    return F.aggregate(F.coalesce(entries, F.array().cast("array<string>")), F.array().cast("array<string>"), step)


def prompt(surface: Column, account_shape: Column, cases: Column, mix: Column, hint: Column | None = None) -> Column:
    """The slot-filled user prompt; absent slots have no line."""
    # The wording of the lines.
    rows = [
        F.lit("Generate one synthetic example with these parameters:"), F.lit(""),
        F.concat(F.lit("- surface: "), surface), F.concat(F.lit("- account_shape: "), account_shape),
        F.when(F.size(cases) > 0, F.concat(F.lit('- edge_cases: ["'), F.array_join(cases, '", "'), F.lit('"]'))),
        F.when(mix != "", F.concat(F.lit("- source_mix: "), mix)),
    ]
    if hint is not None:
        rows.append(F.when(hint != "", F.concat(F.lit("- account_hint: "), hint)))
    return F.array_join(F.array_compact(F.array(*rows)), "\n")


def reconstructed_prompt(meta: Column, surface: Column) -> Column:
    said = get_string(meta, "shape_constraints")
    entries = F.transform(items(get(meta, "edge_cases_included")), lambda x: F.try_variant_get(x, "$", "string"))
    return prompt(surface, F.coalesce(shape(said), F.lit("enterprise_steady")), edge_cases(entries), source_mix(said))


def surface_of(v: Column) -> Column:
    return F.coalesce(F.nullif(get_string(v, "surface"), F.lit("")), get_string(v, "_meta", "surface"))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_records(docs: DataFrame, system_prompt: str, on_bad: str = "fail", text: str = "raw") -> DataFrame:
    """(id, messages, surface, shape) of documents (id, raw). The assistant's message is the document without ``_meta``.

    A text that isn't one JSON object stops the run (``on_bad='fail'``) or is left out ('quarantine', see ``bad_documents``).
    ``shape`` is NULL where it had to be assumed, which is worth a warning. The message has its keys in the order of their names and
    no blanks between them; values stay as they are.
    """
    v = F.col("_v")
    parsed = docs.withColumn("_v", parse_strict(F.col(text)))
    ok = fields(v).isNotNull()
    if on_bad == "fail":
        parsed = parsed.withColumn("id", F.when(ok, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("not one JSON object: "), F.col("id")))))
    elif on_bad == "quarantine":
        parsed = parsed.where(ok)
    else:
        raise ValueError("on_bad must be 'fail' or 'quarantine'")
    meta, surface = get(v, "_meta"), surface_of(v)
    body = F.to_json(without_field(v, "_meta"), {"ignoreNullFields": "false"})
    return parsed.select(
        "id",
        F.array(message("system", F.lit(system_prompt)), message("user", reconstructed_prompt(meta, surface)), message("assistant", body)).alias("messages"),
        surface.alias("surface"), shape(get_string(meta, "shape_constraints")).alias("shape"),
    )


def warnings(records: DataFrame, most: int | None = None) -> DataFrame:
    """(id, warning) of records whose shape had to be assumed; the first ``most`` by id."""
    found = records.where("shape is null").select("id", F.lit("shape not found").alias("warning"))
    return found if most is None else found.orderBy("id").limit(most)


def summary(records: DataFrame) -> DataFrame:
    """Per surface: records, and how many of them have a warning."""
    return records.groupBy("surface").agg(F.count("*").alias("n"), F.count_if(F.col("shape").isNull()).alias("n_warnings"))


def bad_documents(docs: DataFrame, text: str = "raw") -> DataFrame:
    return docs.where(fields(parse_strict(F.col(text))).isNull())


def split(records: DataFrame, eval_ids: DataFrame) -> DataFrame:
    """Records with column ``split``: 'eval' if the id is listed (repeats don't matter), else 'train'. One pass, one join."""
    flagged = eval_ids.select("id").distinct().withColumn("_eval", F.lit(True))
    return records.join(flagged, "id", "left").withColumn("split", F.when(F.col("_eval"), "eval").otherwise("train")).drop("_eval")


def last_turn(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """(conv_id, turn): the last turn of a role in each conversation that has one."""
    return turns.where(F.col("role") == role).groupBy("conv_id").agg(F.max("turn").alias("turn"))


def without_assistant(messages: Column) -> Column:
    return F.filter(messages, lambda m: m.role != "assistant")


def chat_text(messages: Column) -> Column:
    """Messages between turn markers."""
    turn = lambda m: F.concat(F.lit("<|im_start|>"), m.role, F.lit("\n"), m.content, F.lit("<|im_end|>\n"))
    return F.array_join(F.transform(messages, turn), "")


def stratified_sample(docs: DataFrame, strata: list[str], quota: int, seed: int = 42, key: str = "id") -> DataFrame:
    """``quota`` rows a stratum (all, if fewer), chosen by the order of md5(seed:key)."""
    from pyspark.sql import Window

    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(digest, key))
    return docs.withColumn("_r", rank).where(F.col("_r") <= quota).drop("_r")
