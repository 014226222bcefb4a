"""Ids of packed documents against the library."""

import zlib

import numpy as np
import pyarrow.parquet as pq

from docloom.llm import packing, queries


def test_ids_of_every_sign_before_and_behind_others():
    own = packing.WordTokenizer(queries.tokenizer_path())
    texts = [f"{c}. {c}, .{c} a{c}! {c}a?; {c}: {c}\t{c}x" for c in map(chr, range(0x20000)) if not 0xD800 <= ord(c) < 0xE000]
    wrong = []
    for at in range(0, len(texts), 10_000):
        part = texts[at : at + 10_000]
        for text, want in zip(part, own.model.encode_batch_fast(part, add_special_tokens=False), strict=True):
            if own.encode(text).tolist() != want.ids:
                wrong.append(text)
    assert wrong == []


def test_registered_query_against_the_library(spark):
    folder = "/root/testdata/sf0.01"
    docs = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    model = packing.tokenizer(queries.tokenizer_path()).model
    ids = {d["doc_id"]: np.array([*e.ids, 2], "<u4") for d, e in zip(docs, model.encode_batch([d["text"] or "" for d in docs], add_special_tokens=False), strict=True)}
    rows = queries.op2_packing(spark, folder).collect()
    assert {r.doc_id for r in rows} == ids.keys()
    assert all(r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in rows)
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
