import re

import pytest

from commerce_marts.llm import mixing, queries


def expected_targets(sizes, weights=(3, 1, 2)):
    order = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while budget > 1e-9 and free:
        whole = sum(weight[s] for s in free)
        share = {s: target[s] + budget * weight[s] / whole for s in free}
        budget = sum(max(0, v - 2 * sizes[s]) for s, v in share.items())
        target |= {s: min(v, 2 * sizes[s]) for s, v in share.items()}
        free = {s for s in free if target[s] < 2 * sizes[s]}
    return target


def test_targets_and_sums(spark):
    root = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    got = queries.op2_mixture(spark, root).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in docs.items()}
    assert {r["doc_id"]: r["size"] for r in got} == size
    by = {}
    for i, r in docs.items():
        by[r["source"]] = by.get(r["source"], 0) + size[i]
    want = expected_targets(by)
    taken = dict.fromkeys(by, 0)
    for r in got:
        s = docs[r["doc_id"]]["source"]
        assert r["source_size"] == by[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    longest = max(size.values())
    assert all(abs(taken[s] - want[s]) <= longest for s in by)


def test_reruns_agree_and_order_of_rows_does_not_matter(documents):
    first = {(r["doc_id"], r["mix_copies"]) for r in mixing.mix_sources(documents).collect()}
    again = {(r["doc_id"], r["mix_copies"]) for r in mixing.mix_sources(documents.repartition(7)).collect()}
    assert first == again


def test_larger_share_keeps_what_a_smaller_one_takes(documents):
    less = {r["doc_id"]: r["mix_copies"] for r in mixing.mix_sources(documents, share=0.5, most=1.0).collect()}
    more = {r["doc_id"]: r["mix_copies"] for r in mixing.mix_sources(documents, share=0.8, most=1.0).collect()}
    assert all(more[k] >= v for k, v in less.items()) and sum(more.values()) > sum(less.values())


def test_odd_rows_and_take(odd):
    mixed = mixing.mix_sources(odd)
    assert mixed.count() == 12
    by_id = {r["doc_id"]: r for r in mixed.collect()}
    assert by_id[1]["mix_size"] == 0 and by_id[4]["mix_size"] == 1 and by_id[10]["mix_size"] == 1
    taken = mixing.take(odd, mixed)
    assert taken.columns == odd.columns
    assert taken.count() == sum(r["mix_copies"] for r in mixed.collect())
    assert mixing.mix_sources(odd.limit(0)).count() == 0


def test_ranks_by_code_point(spark):
    names = ["b", "a", "é", "Z", "", None, "\U0001f600", "￿"]
    got = mixing.source_ranks(spark.createDataFrame([(n,) for n in names], "source string")).orderBy("rank").collect()
    assert [r["source"] for r in got] == ["", "Z", "a", "b", "é", "￿", "\U0001f600", None]
    assert [r["rank"] for r in got] == list(range(8))


def test_one_hot_source(spark):
    rows = [(i, "w " * (i % 9 + 1), "hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["mix_copies"] * r["mix_size"] for r in own) - own[0]["mix_target"]) <= 9
