"""Phrases, patterns and names in texts without comparing everything with everything."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.sources.io import spread

GRAM = 3  # words of a key at most
HITS = 10_000  # hits that a task holds, and those of one text more
CHUNK = 500  # phrases of one document that a text is compared with at once


# ---- phrases: an inverted index of hashed word n-grams ----


def _grams(words: Column, n: int) -> Column:
    """Hashes of all runs of n words."""
    last = F.size(words) - n
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.lit(n), F.slice(words, i + 1, F.lit(n))))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<bigint>"))


def phrases_in_texts(claims: DataFrame, inputs: DataFrame) -> DataFrame:
    """Distinct ``id, phrase`` of claims (id, phrase) that stand literally in an input text (id, text) of the same id.

    The phrases of an id that has up to ``CHUNK`` of them go to its texts as one list and are looked up in each: a text is read once and
    nothing is made from it. Where an id has more, the words inside a phrase (between its first and its last blank) are whole words of any text
    that holds it. So up to three of them are the phrase's key; the texts of these ids list the keys of all their runs of one to
    three words, and what meets by id and key is verified in the text. Phrases without a word inside are compared in chunks of
    ``CHUNK`` an id. NULL ids, phrases and texts meet nothing; an empty phrase is in any text.
    """
    whole = claims.where("id is not null and phrase is not null").select("id", "phrase").distinct()
    texts = inputs.where("id is not null and text is not null").select("id", "text")
    sizes = whole.groupBy("id").agg(F.count("*").alias("_phrases"))
    many = whole.join(sizes.where(F.col("_phrases") > CHUNK).select("id"), "id", "left_semi").withColumn("_w", F.split("phrase", " "))
    n = F.least(F.size("_w") - 2, F.lit(GRAM))
    keyed = many.where(n >= 1).select("id", "phrase", F.xxhash64(n, F.slice("_w", F.lit(2), n)).alias("_key"))
    mark = F.xxhash64("text")
    words = F.split("text", " ")
    asked = texts.join(keyed.select("id").distinct(), "id", "left_semi")
    listed = asked.select("id", mark.alias("_text"), F.explode(F.array_distinct(F.concat(*[_grams(words, k) for k in range(1, GRAM + 1)]))).alias("_key"))
    met = listed.join(keyed, ["id", "_key"]).select("id", "_text", "phrase").distinct()
    found = met.join(asked.withColumn("_text", mark), ["id", "_text"]).where(F.contains("text", "phrase")).select("id", "phrase")

    few = whole.join(sizes.where(F.col("_phrases") <= CHUNK).select("id"), "id", "left_semi")
    short = many.where(n < 1).select("id", "phrase")
    return found.unionByName(_looked_up(few, texts)).unionByName(_looked_up(short, texts)).distinct()


def _looked_up(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """``id, phrase`` of distinct phrases in a text of their id: each text is compared with lists of about ``CHUNK`` phrases."""
    chunks = phrases.groupBy("id").agg(F.ceil(F.count("*") / CHUNK).alias("_chunks"))
    lists = phrases.join(chunks, "id").groupBy("id", F.pmod(F.xxhash64("phrase"), F.col("_chunks")).alias("_chunk")).agg(F.collect_list("phrase").alias("_phrases"))
    return texts.join(lists, "id").select("id", F.explode(F.filter("_phrases", lambda p: F.contains(F.col("text"), p))).alias("phrase"))


# ---- many patterns: Aho-Corasick automata ----


def pattern_hits(texts: DataFrame, patterns: DataFrame, id_col: str = "id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """``id, pattern, n``: how often each pattern (column ``pattern``) stands in each text, overlaps counted; only where it does.

    Patterns are dealt into blocks of about ``block_bytes`` of UTF-8; a task builds the automaton of a block and reads its texts
    past it once, whatever the number of patterns in it. Texts aren't shuffled; there is a pass over them a block. A task holds an automaton, a batch of texts as Spark sends it
    (``spark.sql.execution.arrow.maxRecordsPerBatch`` and ``maxBytesPerBatch``) and ``HITS`` hits. NULL texts and
    NULL or empty patterns hit nothing; repeated patterns count as one; repeated rows each give their hits.
    """
    spark = texts.sparkSession
    known = patterns.where("pattern <> ''").select("pattern").distinct()
    blocks = int(known.agg(F.ceil(F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0)) / block_bytes)).first()[0])
    kind = texts.schema[id_col].dataType.simpleString()
    read, out = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), None
    for block in range(blocks):
        sent = spark.sparkContext.broadcast([r.pattern for r in known.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block).toLocalIterator()])  # about block_bytes
        one = read.mapInArrow(_matcher(sent), f"id {kind}, pattern string, n long")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else read.limit(0).select("id", F.col("text").alias("pattern"), F.lit(0).cast("long").alias("n"))


def _matcher(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        words = sent.value
        automaton = ahocorasick.Automaton()
        for k, word in enumerate(words):
            automaton.add_word(word, k)
        if words:
            automaton.make_automaton()
        for batch in batches:
            rows, hits, counts = [], [], []
            found = lambda: pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(hits, pa.string()), pa.array(counts, pa.int64())], names=["id", "pattern", "n"])  # noqa: B023, E731
            for row, value in enumerate(batch.column(1)):
                seen: dict[int, int] = {}
                for _, k in automaton.iter(value.as_py() or "") if words else ():
                    seen[k] = seen.get(k, 0) + 1
                rows += [row] * len(seen)
                hits += [words[k] for k in seen]
                counts += seen.values()
                if len(rows) >= HITS:
                    yield found()
                    rows, hits, counts = [], [], []
            yield found()

    return run


# ---- names that differ by few letters: a join on what is left of a name ----


def _left_over(name: Column, most: int) -> Column:
    """Array of structs: up to ``most`` letters taken out (d of them) or masked (s): ``v`` is what is left."""
    size = lambda x: F.length(x.v)
    made = lambda v, s, d, at: F.struct(v.alias("v"), s.cast("int").alias("s"), d.cast("int").alias("d"), at.cast("int").alias("at"))
    level, out = F.array(made(name, F.lit(0), F.lit(0), F.lit(1))), []
    for _ in range(most):
        def edited(x: Column) -> Column:
            places = F.when(x.at <= size(x), F.sequence(x.at, size(x))).otherwise(F.array().cast("array<int>"))
            head, tail = (lambda i: F.substring(x.v, F.lit(1), i - 1)), (lambda i: F.substring(x.v, i + 1, size(x)))
            masked = F.transform(places, lambda i: made(F.concat(head(i), F.lit("\x00"), tail(i)), x.s + 1, x.d, i + 1))
            return F.concat(masked, F.transform(places, lambda i: made(F.concat(head(i), tail(i)), x.s, x.d + 1, i)))

        out.append(level)
        level = F.flatten(F.transform(level, edited))
    return F.concat(*out, level)


def near_pairs(names: DataFrame, column: str = "name", most: int = 2) -> DataFrame:
    """``a, b, distance``: pairs a < b of different names within ``most`` edits of each other, each pair once.

    Of two names that near the same is left when the letters that differ are masked in both and those that only one has are taken out of it. So
    names meet by what is left, the number of masks and the letters taken out on either side, all together ``most`` at most: what meets
    is a pair, however much of their letters all names share; hashes are verified by the distance. Keys a name of n letters:
    about (2 n) ** most / most!. Copies of a name are one name; NULL names take no part.
    """
    all_names = spread(names.where(F.col(column).isNotNull()).select(F.col(column).alias("_n")).distinct(), "_n", task_bytes=512 << 10)
    left = all_names.select("_n", F.explode(_left_over(F.col("_n"), most)).alias("_x")).select("_n", "_x.v", "_x.s", "_x.d")
    pairs = left.where(F.col("s") + F.col("d") <= most).withColumn("_other", F.explode(F.sequence(F.lit(0), most - F.col("s") - F.col("d"))))
    low, high = F.least("d", "_other"), F.greatest("d", "_other")
    keyed = pairs.select("_n", (F.col("d") - F.col("_other")).alias("_more"), F.xxhash64("v", "s", low, high).alias("_key")).distinct()
    # The side with fewer letters taken out asks; with as many on both, the smaller name.
    one, two = keyed.where("_more <= 0").select(F.col("_n").alias("_a"), "_key", "_more"), keyed.where("_more >= 0").select(F.col("_n").alias("_b"), "_key")
    met = one.hint("merge").join(two.hint("merge"), "_key").where("_a <> _b and (_more < 0 or _a < _b)")  # the files are far smaller than the keys: not to be broadcast
    found = met.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
    return found.withColumn("distance", F.levenshtein("a", "b", most)).where("distance >= 0")
