import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_jaccard_join import brute

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

ROOT = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").cache()
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, ROOT).cache()
        assert docs.columns == columns and [f.dataType for f in docs.schema] == [f.dataType for f in before.schema]
        seen[name] = (before.collect(), docs.collect())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    before, after = seen["quality classifier"]
    kept = {r["doc_id"] for r in after}
    right = [(r["doc_id"] in kept) == bool(labels[r["doc_id"]]) for r in before if r["doc_id"] in labels]
    assert sum(right) > 0.95 * len(right)
    before, after = seen["n-gram Jaccard join"]
    groups = brute([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(d for d, _, c in groups if d == c)
    before, after = seen["secret scans"]
    texts = {r["doc_id"]: r for r in after}
    assert len(texts) == len(before)
    for r in before:
        new = texts[r["doc_id"]]
        assert not re.search("[0-9a-f]{24,}", new["text"]) and new["n_chars"] == len(new["text"])
        if "[secret]" not in new["text"]:
            assert new["text"] == r["text"]
    before, after = seen["mixing sources to target weights"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and len(after) > len(before)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, ROOT).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in after}


def test_run_and_odd_documents(spark, tmp_path, odd):
    odd.drop("score").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1), (7, 1), (2, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    odd.drop("score").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_columns_named_like_helpers_stay(spark):
    """Every stage but the last keeps columns that are named like those it works with."""
    names = ["score", "__score", "secret_spans", "secret__spans", "assign", "taken", "words", "random", "__hex", "mix_copies", "mix_key_id", "mix_n", "group_id", "group_one", "text_hash", "size", "hash"]
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    docs = docs.select("*", *[F.col("doc_id").alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, ROOT)
    assert docs.columns[-len(names) :] == names
    assert docs.filter(" OR ".join(f"`{n}` <> doc_id" for n in names)).count() == 0 < docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, ROOT).count() > 0
