import random
import zlib

import numpy as np
import pytest
from conftest import ROOT
from tokenizers import Tokenizer

from commerce_marts.llm import packing, queries


def check(rows, docs, length=2048):
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(docs)
    for d, text in docs.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length and at & (at - 1) == 0


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    check(queries.op10_sequences(spark, ROOT).collect(), docs)


def test_encoder_equals_the_tokenizer():
    ours, tokenizer = packing.Encoder(queries.TOKENIZER), Tokenizer.from_file(queries.TOKENIZER)
    random.seed(1)
    letters = " \t\n\r'_sdtrevml.,!aZ09éß×÷ƒ-"
    texts = ["", "<|endoftext|>a", "́e áb", "½ ² ٣ 一二", "😀😀  z", "\x00\x01\x1c a", "don't  'll x\n\n  y", "a b　c"]
    texts += ["".join(random.choice(letters) for _ in range(random.randint(0, 14))) for _ in range(5000)]
    for t in texts:
        assert list(ours.encode(t)) == tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = packing.hilbert(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    assert np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1).max() == 1


def test_odd_rows(odd):
    some = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    packed = packing.pack_documents(some, queries.TOKENIZER)
    rows = packed.collect()
    check(rows, {r["doc_id"]: r["text"] for r in some.select("doc_id", "text").collect()})
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    assert packing.pack_documents(odd.limit(0), queries.TOKENIZER).count() == 0
    assert sum(r["length"] for r in packing.pack_documents(odd, queries.TOKENIZER).collect() if r["doc_id"] is None) > 0
