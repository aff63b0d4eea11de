"""Type 2 history with late changes against brute force."""

import datetime as dt
import itertools
import random
from pathlib import Path

from commerce_marts.sources import history

KIND = "k int, city string, tier int, changed date"
DAYS = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(12)]
END = dt.date(9999, 12, 31)


def brute(changes):
    """Merged periods from all changes at once."""
    out, state = [], {}
    order = lambda s: tuple((x is not None, x) for x in s)
    for k, city, tier, day in changes:
        if day is not None:
            old = state.get((k, day))
            state[k, day] = (city, tier) if old is None else max(old, (city, tier), key=order)
    for k in {k for k, _ in state}:
        kept = []
        for day in sorted(d for x, d in state if x == k):
            if not kept or kept[-1][1] != state[k, day]:
                kept.append((day, state[k, day]))
        ends = [d for d, _ in kept[1:]] + [END]
        out += [(k, *s, d, e, e == END) for (d, s), e in zip(kept, ends, strict=True)]
    return sorted(out, key=str)


def batches(seed, keys, n):
    rng = random.Random(seed)
    return [[(rng.choice(keys), rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice([*DAYS, None])) for _ in range(n)] for _ in range(3)]


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_any_order_of_batches_gives_the_same_periods(spark):
    parts = batches(1, [1, 2, 3, 4, None], 14)
    want = brute(sum(parts, []))
    tracked = ["city", "tier"]
    for order in itertools.permutations(range(3)):
        frames = [spark.createDataFrame(parts[i], KIND) for i in order]
        now = history.late_changes(None, frames[0], "k", tracked, "changed")
        for frame in (*frames[1:], frames[0]):  # the first one is sent twice
            now = history.merge_late(now, frame, "k", tracked, "changed")
        assert rows(history.periods(now, "k")) == want


def test_a_change_between_two_equal_ones_splits(spark):
    make = lambda r: spark.createDataFrame(r, KIND)
    now = history.late_changes(None, make([(1, "a", 1, DAYS[0]), (1, "a", 1, DAYS[6]), (2, "b", 1, DAYS[1])]), "k", ["city", "tier"], "changed")
    assert [r["expiration_date"] for r in history.periods(now, "k").filter("k = 1").collect()] == [END]
    now = history.merge_late(now, make([(1, "c", 1, DAYS[3])]), "k", ["city", "tier"], "changed")
    got = [(r["city"], r["effective_date"], r["expiration_date"]) for r in history.periods(now, "k").filter("k = 1").orderBy("effective_date").collect()]
    assert got == [("a", DAYS[0], DAYS[3]), ("c", DAYS[3], DAYS[6]), ("a", DAYS[6], END)]
    assert [r["city"] for r in history.as_of(now, "2024-01-05").orderBy("k").collect()] == ["c", "b"]
    assert history.late_changes(now, make([]), "k", ["city", "tier"], "changed").count() == 0
    assert history.merge_late(now, make([]), "k", ["city", "tier"], "changed").count() == now.count()


def test_only_buckets_of_named_keys_are_rewritten(spark, tmp_path):
    root, parts = str(tmp_path / "history"), batches(2, list(range(40)), 120)
    files = lambda: {str(p.relative_to(root)) for p in Path(root).rglob("*.parquet")}
    for part in parts:
        history.update_stored(spark.createDataFrame(part, KIND), root, "k", ["city", "tier"], "changed", buckets=8)
    before = files()
    late = [(7, "z", 9, DAYS[2])]
    for _ in range(2):
        history.update_stored(spark.createDataFrame(late, KIND), root, "k", ["city", "tier"], "changed", buckets=8)
    gone = {p.split("/")[0] for p in before - files()}
    assert len(gone) == 1
    stored = spark.read.parquet(root).drop("history_bucket")
    assert rows(history.periods(stored, "k")) == brute(sum(parts, late))
