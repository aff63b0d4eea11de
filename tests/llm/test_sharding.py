import zlib

import pytest
from conftest import ROOT

from commerce_marts.llm import queries, sharding


def test_shards_and_slots(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    got = queries.op8_shards(spark, ROOT).collect()
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    total = [0] * 8
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        total[r["shard"]] += r["size"]
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert max(total) - min(total) <= 2 * max(r["size"] for r in got)


def test_equal_texts_lie_together_and_large_groups_are_cut(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    placed = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), cell_rows=50).collect()
    sizes = [sum(r["size"] for r in placed if r["shard"] == s) for s in range(8)]
    assert max(sizes) < 1.05 * min(sizes)
    hot = sorted((r["shard"], r["slot"]) for r in placed if r["text"] == "same text")
    order = {(r["shard"], r["slot"]): i for i, r in enumerate(sorted(placed, key=lambda r: (r["shard"], r["slot"])))}
    places = [order[x] for x in hot]
    assert places[-1] - places[0] == len(places) - 1


def test_splitters_are_exact(spark):
    rows = spark.range(5000).selectExpr("shiftrightunsigned(xxhash64(id), 1) AS key", "1 + id % 50 AS size")
    keys = sharding.find_splitters(rows, 40, tolerance=0.0)
    data = [(r["key"], r["size"]) for r in rows.collect()]
    total = sum(s for _, s in data)
    for p, k in enumerate(keys, 1):
        below = sum(s for x, s in data if x < k)
        assert abs(below - total * p / 40) <= 50
    got = rows.select(sharding.part_of(rows["key"], keys).alias("p"), "key").collect()
    assert all(r["p"] == sum(k <= r["key"] for k in keys) for r in got)


def test_odd_rows(odd):
    got = sharding.shard_documents(odd)
    assert got.columns == [*odd.columns, "size", "slot", "shard"] and got.count() == 12
    assert {(r["doc_id"], r["size"]) for r in got.collect() if r["doc_id"] in (1, 2, 4)} == {(1, 1), (2, 1), (4, 4)}
    assert len({(r["shard"], r["slot"]) for r in got.collect()}) == 12
    assert sharding.shard_documents(odd.limit(0)).count() == 0


@pytest.mark.parametrize("group", [2, 4, 17, 50])
def test_equal_texts_share_a_shard(spark, group):
    rows = [(i * 7, f"text number {i // group} " + "x" * (i // group % 40)) for i in range(4000)]
    placed = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), cell_rows=100).collect()
    where = {}
    for r in placed:
        where.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(x) == 1 for x in where.values())
    sizes = [sum(r["size"] for r in placed if r["shard"] == s) for s in range(8)]
    weight = max(sum(r["size"] for r in placed if r["text"] == t) for t in where)
    assert max(sizes) - min(sizes) <= 2 * weight and min(sizes) > 0
    for s in range(8):
        assert sorted(r["slot"] for r in placed if r["shard"] == s) == list(range(sum(r["shard"] == s for r in placed)))


def test_columns_named_like_helpers_stay(spark):
    docs = spark.createDataFrame([(i, "t", "mine", i) for i in range(20)], "doc_id long, text string, shard_key string, SHARD_CELL long")
    got = sharding.shard_documents(docs)
    assert got.columns == [*docs.columns, "size", "slot", "shard"] and {r["shard_key"] for r in got.collect()} == {"mine"}
