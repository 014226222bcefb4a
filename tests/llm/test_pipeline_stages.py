"""The stages of the pipeline, each on its own input, against plain definitions; rows of every odd kind; empty tables."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from docloom.llm import mixing, queries
from docloom.llm.queries import tokenizer_path
from test_near_text import weighted
from test_rows import cut

DATA = "/root/testdata/sf0.001"
STAGE = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_are_those_of_the_job():
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "line dedup", "minhash near-dedup", "mixing to target weights", "packing"]


def test_quality_keeps_what_the_score_accepts(spark, docs):
    want = {r.doc_id for r in queries.op8_quality(spark, DATA).collect() if r.score >= 0.5}
    kept = by_id(STAGE["quality classifier"](spark, docs, DATA))
    assert kept.keys() == want and all(kept[i] == r for i, r in by_id(docs).items() if i in want)


def test_lines_against_the_quadratic_definition(spark, docs):
    before, after = by_id(docs), by_id(STAGE["line dedup"](spark, docs, DATA))
    want = cut([(i, r.text) for i, r in before.items()])
    assert before.keys() == after.keys()
    for i, r in before.items():
        text, n = want[i, r.text] if r.text is not None else (None, 0)
        assert after[i].text == text and (after[i].n_chars == (len(text) if n else r.n_chars))


def test_near_copies_against_all_pairs(spark, docs):
    before = by_id(docs)
    pairs, texts = weighted([(i, r.text or "") for i, r in before.items()])
    assert not [x for x in pairs.values() if abs(x - 0.8) < 1e-3]
    part = {i: i for i in texts.values()}
    for _ in range(40):
        for (i, j), x in pairs.items():
            if x >= 0.8:
                part[i] = part[j] = min(part[i], part[j])
    kept = by_id(STAGE["minhash near-dedup"](spark, docs, DATA))
    assert kept == {i: r for i, r in before.items() if texts[r.text or ""] == i and part[i] == i}


def test_mixing_orders_all_rows_by_slot(spark, docs):
    slot = {r.doc_id: r.mix_slot for r in mixing.mix(docs).collect()}
    rows = STAGE["mixing to target weights"](spark, docs, DATA).collect()
    assert [slot[r.doc_id] for r in rows] == sorted(slot.values()) and {r.doc_id: r for r in rows} == by_id(docs)


def test_packing_covers_every_document_along_the_schedule(spark, docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array([*model.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for i, r in by_id(docs).items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in STAGE["packing"](spark, docs, DATA).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == ids.keys()
    for i, own in pieces.items():
        end = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == end and r.doc_tokens == len(ids[i]) and r.ids_crc32 == zlib.crc32(ids[i][r.start : r.start + r.length].tobytes())
            end += r.length
        assert end == len(ids[i])
    padding = 0
    for own in sequences.values():
        end = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 4096
        padding += 0 if end & (end - 1) == 0 else 4096 - end
    assert padding < 0.01 * sum(map(len, ids.values()))


def test_packing_follows_the_order_that_mixing_wrote(spark, docs, tmp_path):
    """Whatever order the files hold is the order of the sequences."""
    for k, how in enumerate((F.desc("doc_id"), F.asc("text"))):
        path = str(tmp_path / f"in{k}")
        docs.repartitionByRange(3, how, "doc_id").sortWithinPartitions(how, "doc_id").write.parquet(path)
        place = {r.doc_id: i for i, r in enumerate(docs.orderBy(how, "doc_id").select("doc_id").collect())}
        first = {}
        for r in STAGE["packing"](spark, spark.read.parquet(path), DATA).collect():
            first[r.sequence_id] = min(first.get(r.sequence_id, place[r.doc_id]), place[r.doc_id])
        assert [first[s] for s in sorted(first)] == sorted(first.values())


LONG = " ".join(f"word{k % 977} and{k % 31}" for k in range(40_000))
ODD = [
    (1, "A plain text that has some words in it, and ends here.", "en", "a", 5), (1, "Another text under the same number, with other words.", "en", None, None), (2, None, None, None, None), (3, "", "en", "a", 0),
    (None, "A text without a number stays where it is, they say.", "en", "b", 1), (None, None, None, "b", None), (4, LONG, "en", "c", len(LONG)), (5, LONG, "en", "c", len(LONG)), (6, "\n\n \t\n", "en", "a", 5),
    (7, "A plain text that has some words in it, and ends here.", "en", "a", 5), (7, "A plain text that has some words in it, and ends here.", "en", "a", 5), (8, "x", "en", "a" * 300, 1), (9, "日本語の文章です。" * 20, "ja", "a", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = {"__doc": 1, "__gone": 2, "runs": 3, "mix_slot": 4, "Mix_Block": 5, "lines_removed": 6, "own": 7, "key": 8, "text_key": 9, "__size": 10, "blob": 11, "_id": 12, "_key": 13, "node": 14}


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] + [(None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", list(STAGE)[:-1])
def test_odd_rows(spark, labelled, name):
    plain = spark.createDataFrame(ODD, SCHEMA)
    wide = plain.select("*", *[F.lit(v).alias(c) for c, v in CLASH.items()])
    got = STAGE[name](spark, wide, labelled)
    assert got.columns == wide.columns
    rows = got.collect()
    assert all(tuple(r)[5:] == tuple(CLASH.values()) for r in rows)
    found, all_ = Counter((r.doc_id, r.text) for r in rows), Counter((i, t) for i, t, *_ in ODD)
    if name == "mixing to target weights":
        assert found == all_
    elif name == "quality classifier":
        assert not found - all_
    elif name == "line dedup":
        assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in ODD)
        assert found[4, LONG] == 1 and found[5, ""] == 1 and found[2, None] == 1 and found[7, ""] == 2 and found[None, None] == 1 and found[1, ODD[1][1]] == 1
    else:  # the null text of 2 and the empty one of 3, blanks of 6 aside, are one class
        gone = all_ - found
        assert not found - all_ and gone == Counter({(3, ""): 1, (5, LONG): 1, (7, ODD[0][1]): 2})


def test_odd_rows_are_packed(spark, labelled):
    wide = spark.createDataFrame(ODD, SCHEMA).select("*", *[F.lit(v).alias(c) for c, v in CLASH.items()])
    rows = STAGE["packing"](spark, wide, labelled).collect()
    assert sum(r.start == 0 for r in rows) == len(ODD)
    for i in {i for i, *_ in ODD}:
        assert sum(r.length for r in rows if r.doc_id == i) == sum(r.doc_tokens for r in rows if r.doc_id == i and r.start == 0)


@pytest.mark.parametrize("name", list(STAGE))
def test_empty_tables(spark, labelled, name):
    assert STAGE[name](spark, spark.createDataFrame([], SCHEMA), labelled).count() == 0


def test_run_equals_its_stages(spark, docs):
    found = docs
    for name, stage in list(STAGE.items())[:3]:
        found = stage(spark, found, DATA)
    assert {r.doc_id for r in pipeline.run(spark, DATA).select("doc_id").collect()} == {r.doc_id for r in found.select("doc_id").collect()}
