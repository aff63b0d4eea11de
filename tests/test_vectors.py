"""Bounded vector search against brute force."""

import numpy as np
import pytest

from commerce_marts.operators import vectors

KIND = "vec_id bigint, embedding array<double>"


def frames(spark, held, asked):
    data = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in held], KIND).repartition(4)
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in asked], "query_id bigint, query array<double>"), data


def brute(held, asked, k):
    unit = lambda v: np.divide(v, np.linalg.norm(v)) if np.any(v) else np.zeros(len(v))
    out = []
    for q, v in asked:
        if v is not None:
            sims = sorted((-round(float(unit(np.array(v, float)) @ unit(np.array(x, float))), 6), i) for i, x in held if x is not None)
            out += [(q, i, -s + 0.0, n + 1) for n, (s, i) in enumerate(sims[:k])]
    return sorted(out)


def got(df):
    return sorted((r["query_id"], r["vector_id"], r["similarity"] + 0.0, r["rank"]) for r in df.collect())


def same(a, b):
    return [x[:2] + x[3:] for x in a] == [x[:2] + x[3:] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b], atol=2e-6)


def test_clusters_are_pruned_and_results_are_exact(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    held = [(i, centres[i % 40] + 0.05 * rng.normal(size=16)) for i in range(2000)]
    asked = [(i, centres[i] + 0.05 * rng.normal(size=16)) for i in range(30)]
    q, d = frames(spark, held, asked)
    found, seen = vectors.vector_search(q, d, 5, block_rows=50, query_rows=8)
    assert same(got(found), brute(held, asked, 5))
    shares = [r["visited"] / r["blocks"] for r in seen.collect()]
    assert len(shares) == 30 and np.mean(shares) < 0.5


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_ties_zeros_nulls_and_many_copies(spark, block_rows):
    held = [(i, [1, 0, 0]) for i in range(60)] + [(100 + i, [0, 0, 0]) for i in range(20)] + [(200, None), (201, [-1, 0.5, 0]), (202, [0, 1, 0]), (203, [2, 2, 0])]
    asked = [(1, [1, 0, 0]), (2, [0, 0, 0]), (3, [-1, 0, 0]), (4, None), (5, [0, 3, 0])]
    q, d = frames(spark, held, asked)
    for k in (1, 4, 90):
        assert same(got(vectors.vector_topk(q, d, k, block_rows=block_rows, query_rows=2)), brute(held, asked, k))


def test_vectors_without_structure(spark):
    rng = np.random.default_rng(2)
    held, asked = [(i, rng.normal(size=8)) for i in range(500)], [(i, rng.normal(size=8)) for i in range(20)]
    q, d = frames(spark, held, asked)
    assert same(got(vectors.vector_topk(q, d, 7, block_rows=20)), brute(held, asked, 7))


def test_empty_inputs(spark):
    q, d = frames(spark, [(1, [1, 0])], [(1, [1, 0])])
    assert vectors.vector_topk(q.limit(0), d).count() == 0 and vectors.vector_topk(q, d.limit(0)).count() == 0
