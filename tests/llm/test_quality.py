import zlib

import numpy as np
from conftest import ROOT
from pyspark.sql import functions as F

from commerce_marts.llm import quality, queries


def model():
    good = [f"the cat number {i} sat on the mat, and it was calm.".encode() for i in range(60)]
    bad = [f"BUY!! NOW!! OFFER!! {i}!! CHEAP!!".encode() for i in range(60)]
    return quality.fit(list(zip(good + bad, [1] * 60 + [0] * 60, strict=True)))


def test_batch_scores_equal_single_scores(documents):
    m = model()
    texts = [r["text"] for r in documents.limit(80).collect()] + ["", "a", "ab", "a b", "é"]
    import pyarrow as pa

    together = quality.score_buffers(*quality.buffers(pa.array(texts)), m)
    for text, got in zip(texts, together, strict=True):
        ids = [g for g in quality.grams_of(np.frombuffer(text.encode(), np.uint8)) if len(g)]
        logit = (m.weights[np.concatenate(ids)].astype(float).mean() if ids else 0.0) + m.bias
        assert abs(1 / (1 + np.exp(-logit)) - got) < 1e-6


def test_learns_and_repeats():
    m = model()
    import pyarrow as pa

    s = quality.score_buffers(*quality.buffers(pa.array(["the dog sat on the mat.", "SALE!! NOW!!", None])), m)
    assert s[0] > 0.8 and s[1] < 0.2 and 0 < s[2] < 1
    assert (model().weights == m.weights).all()


def test_without_labels_scores_half(documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    m = quality.train(documents, none)
    assert quality.score_documents(documents.limit(3), m).filter("score = 0.5").count() == 3


def test_odd_rows(odd):
    got = quality.score_documents(odd, model())
    assert got.columns == odd.columns
    rows = got.select("doc_id", "score").collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 6}) == 1
    assert quality.score_documents(odd.limit(0), model()).count() == 0


def test_held_out_accuracy(spark):
    got = queries.op1_quality(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_labels_of_one_id_are_averaged(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    assert quality.train(docs, labels).bias < 0
    assert ROOT and docs.filter(quality.held_out(F.col("doc_id")).isNull()).count() == 0
