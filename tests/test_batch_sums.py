"""Stored batch sums: repeats, merges, and a crash at any step."""

import random
from collections import Counter

import pytest

from commerce_marts.sources import batch_sums
from commerce_marts.sources.batch_sums import BatchSums, Manifest

SCHEMA = "k string, n bigint, amount decimal(28,2)"


def store(spark, path):
    return BatchSums(spark, str(path), SCHEMA, ["k"])


def rows(spark, *r):
    return spark.createDataFrame(list(r), "k string, n bigint, amount double")


def totals(s):
    return {r["k"]: (r["n"], float(r["amount"])) for r in s.totals().collect()}


def test_batches_count_once_before_and_after_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batch_sums.BatchSums.compact, "__defaults__", (3,))
    s = store(spark, tmp_path / "s")
    assert totals(s) == {}
    for i in range(8):
        assert s.commit(i, rows(spark, ("a", 1, 0.25), (None, i, -1.0)))
        assert totals(s) == {"a": (i + 1, 0.25 * (i + 1)), None: (sum(range(i + 1)), -1.0 * (i + 1))}
        for again in range(i + 1):
            assert not s.commit(again, rows(spark, ("a", 100, 100.0)))
    now = s.manifest()
    assert len(now.files) < 5 and now.absorbed == [(0, 7)] and max(k for _, k in now.files) == 1
    assert s.commit(20, rows(spark)) and not s.commit(20, rows(spark, ("a", 5, 0.0)))
    assert s.manifest().absorbed == [(0, 7), (20, 20)] and totals(s)["a"] == (8, 2.0)


@pytest.mark.parametrize("step", ["_store", "_publish", "_delete"])
def test_a_crash_at_any_step_changes_no_total(spark, tmp_path, monkeypatch, step):
    monkeypatch.setattr(batch_sums.BatchSums.compact, "__defaults__", (2,))
    whole, rng, want = getattr(BatchSums, step), random.Random(5), Counter()
    for batch in range(6):
        while True:  # a new process each time, until the batch is in
            calls, stop = [0], rng.randrange(0, 3)

            def crash(self, *args, calls=calls, stop=stop):
                calls[0] += 1
                late = rng.random() < 0.5
                if calls[0] > stop and not late:
                    raise OSError("killed")
                out = whole(self, *args)
                if calls[0] > stop:
                    raise OSError("killed")
                return out

            s = store(spark, tmp_path / "s")
            monkeypatch.setattr(BatchSums, step, crash)
            try:
                s.commit(batch, rows(spark, ("a", batch + 1, 1.0)))
                done = True
            except OSError:
                done = False
            monkeypatch.setattr(BatchSums, step, whole)
            known = s.manifest().holds(batch)
            assert known or not done
            assert totals(store(spark, tmp_path / "s")).get("a", (0, 0.0)) == (want["n"] + (batch + 1) * known, want["m"] + 1.0 * known)
            if done:
                break
        want["n"] += batch + 1
        want["m"] += 1


def test_ten_thousand_batches_leave_few_folders(spark, tmp_path, monkeypatch):
    kept = Manifest()

    def publish(self, new):
        nonlocal kept
        kept = new

    monkeypatch.setattr(BatchSums, "manifest", lambda self: kept)
    monkeypatch.setattr(BatchSums, "_publish", publish)
    monkeypatch.setattr(BatchSums, "_store", lambda self, sums: f"{len(kept.files)}-{kept.version}")
    monkeypatch.setattr(BatchSums, "_read", lambda self, names: None)
    monkeypatch.setattr(BatchSums, "_sums", lambda self, rows: None)
    monkeypatch.setattr(BatchSums, "_delete", lambda self, name: None)
    s, most = store(spark, tmp_path / "s"), 0
    for i in range(10_000):
        s.commit(i, None)
        most = max(most, len(kept.files))
    assert most <= 7 * 5 and kept.absorbed == [(0, 9_999)] and len(kept.replaced) <= 8


def test_old_manifests_and_folders_go(spark, tmp_path):
    s = store(spark, tmp_path / "s")
    for i in range(17):
        s.commit(i, rows(spark, ("a", 1, 1.0)))
    assert totals(s) == {"a": (17, 17.0)}
    assert len(s._versions()) == 2 and len([p for p in (tmp_path / "s" / "data").iterdir()]) <= 3 + 8
