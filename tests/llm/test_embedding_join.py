import numpy as np
import pytest
from pyspark.sql import functions as F

from commerce_marts.llm import embedding_join
from commerce_marts.llm.embedding_join import near_vectors


def brute(rows, least=0.9):
    ok = []
    for i, (_, v) in enumerate(rows):
        x = np.array([np.nan if e is None else e for e in v], float) if v else np.zeros(0)
        if len(x) and np.isfinite(x).all() and np.abs(x).max() > 0:
            x = x / np.abs(x).max()
            ok.append((i, x / np.sqrt((x * x).sum())))
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(ok):
        for j, y in ok[a + 1 :]:
            if len(x) == len(y) and x @ y >= least:
                links[i] += 1
                links[j] += 1
                parent[root(j)] = root(i)
    least_id = {}
    for i, (v, _) in enumerate(rows):
        least_id[root(i)] = min(least_id.get(root(i), v), v)
    return sorted((v, links[i], least_id[root(i)], v == least_id[root(i)]) for i, (v, _) in enumerate(rows))


@pytest.mark.parametrize(("cell_rows", "block_rows"), [(40, 16), (10_000, 4096)])
def test_equals_brute_force(spark, cell_rows, block_rows):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 8))
    rows = []
    for i in range(300):
        v = centres[i % 6] + rng.standard_normal(8) * (0.25 if i % 3 else 0.6)
        rows.append((i * 7 % 997, [float(np.float32(e)) for e in v]))
    rows += [(2000 + i, rows[5][1]) for i in range(30)]  # copies
    rows += [(3000, None), (3001, []), (3002, [0.0] * 8), (3003, [1.0, None] + [1.0] * 6), (3004, [float("nan")] * 8), (3005, [float("inf")] + [0.0] * 7), (3006, [1.0, 0.0]), (3007, [2.0, 0.0])]
    rows += [(3008, [e * 3 for e in rows[7][1]]), (3009, [-e for e in rows[7][1]])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, n_links int, kept int")
    got = sorted(tuple(r) for r in near_vectors(frame, cell_rows=cell_rows, block_rows=block_rows).collect())
    as_float = [(i, None if v is None else [None if e is None else float(np.float32(e)) for e in v]) for i, v in rows]
    assert got == brute(as_float)


def test_empty_and_repeated_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert near_vectors(spark.createDataFrame([], kind)).count() == 0
    got = near_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], kind)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_steps_hold_each_vector_once(spark, monkeypatch):
    """Neither a stored step nor an exchange may hold a vector for each cell or block that it meets."""
    rows = [(i, [float(np.float32(e)) for e in v]) for i, v in enumerate(np.random.default_rng(8).standard_normal((400, 32)))]
    steps, plans, settle = {}, {}, embedding_join.settle

    def seen(frame, name):
        stored = settle(frame, name)
        vectors = F.size("n") if "n" in stored.columns and name == "blocks" else F.lit(1)
        steps[name] = max(steps.get(name, 0), stored.agg(F.coalesce(F.sum(vectors), F.lit(0))).first()[0])
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        return stored

    monkeypatch.setattr(embedding_join, "settle", seen)
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), cell_rows=20, block_rows=8)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    assert max(steps.values()) <= 400 and steps["blocks"] == 400
    assert "Exchange hashpartitioning" not in plans["found"]


@pytest.mark.parametrize(("cell_rows", "block_rows", "least"), [(150, 40, 0.9), (100_000, 100_000, 0.9), (300, 100_000, 0.3)])
def test_leading_directions_lose_no_link(spark, cell_rows, block_rows, least):
    rng = np.random.default_rng(9)
    centre = rng.standard_normal((5, 48))
    rows = [(i, rng.standard_normal(48)) for i in range(500)]
    rows += [(500 + i, centre[i % 5] + rng.standard_normal(48) * 0.33) for i in range(300)]
    rows += [(800 + i, centre[0] + rng.standard_normal(48) * 0.01) for i in range(200)]
    # Numbers that single precision cannot hold, far beyond its range, and at the limit from both sides.
    rows = [(i, v if i % 4 else v * 1e200) for i, v in rows]
    x = np.eye(48)[0]
    rows += [(2000 + k, least * x + np.sqrt(1 - least**2) * np.eye(48)[1 + k] * s) for k, s in enumerate((1 - 1e-9, 1 + 1e-9, 1 - 1e-6, 1 + 1e-6))] + [(2100, x)]
    rows += [(3000 + i, rows[520][1]) for i in range(40)]
    rows = [(i, [float(e) for e in v]) for i, v in rows]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least, cell_rows=cell_rows, block_rows=block_rows)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least)


def test_links_of_blocks_wider_than_a_step():
    rng = np.random.default_rng(10)
    x = rng.standard_normal((700, 32))
    x[::7] = x[0] + rng.standard_normal((100, 32)) * 0.02
    unit = embedding_join._unit(x)
    links = unit @ unit.T >= 0.9
    lead = embedding_join._directions(unit, 0.5)
    for directions in (None, lead, np.linalg.qr(rng.standard_normal((32, 15)))[0].astype(np.float32)):
        whole = embedding_join._Block(np.frombuffer(x.tobytes(), np.uint8), 700, 32, directions, 1e-5)
        for step, width in ((128, 4096), (16, 64)):
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(embedding_join, "STEP", step)
                patch.setattr(embedding_join, "WIDTH", width)
                own = np.concatenate([np.stack(p, 1) for p in embedding_join._links(whole, whole, True, 0.9, 1e-5)])
                part = whole.take(np.arange(0, 699, 2))
                both = np.concatenate([np.stack(p, 1) for p in embedding_join._links(part, whole, False, 0.9, 1e-5)])
            assert sorted(map(tuple, own)) == [*zip(*np.nonzero(np.triu(links, 1)), strict=True)]
            assert sorted(map(tuple, both)) == [*zip(*(lambda a, b: (a * 2, b))(*np.nonzero(links[0:699:2])), strict=True)]
