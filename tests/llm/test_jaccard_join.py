import random
import re

import numpy as np
import pytest

from commerce_marts.llm import jaccard_join as jj

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows):
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int")
    return sorted((tuple(r)[:3] for r in jj.similar_groups(frame).collect()), key=str)


def edit(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"n{rng.randrange(10**6)}"
        elif kind == 1:
            words.insert(at, f"i{rng.randrange(10**6)}")
        elif len(words) > 1:
            words.pop(at)
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, at = [], 0
    common = [f"p{i}" for i in range(60)]  # a passage that many share
    for size in [4, 5, 6, 7, 8, 9, 10, 12, 14, 17, 20, 25, 30, 40, 60, 90, 150]:
        for _ in range(3):
            words = [f"w{rng.randrange(10**5)}" for _ in range(size)]
            for n in (0, 0, 1, 1, 2, 3, size // 25, size // 15):
                text = edit(rng, words, n) + (common if size > 50 and rng.random() < 0.5 else [])
                rows.append((at, " ".join(w.upper() if rng.random() < 0.05 else w for w in text)))
                at += 1
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_large_group_of_near_copies(spark):
    """More near copies than a key's few, in a chain too: each differs a little from the one before."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edit(rng, words, 2))) for i in range(60)]
    chain = [f"c{i}" for i in range(100)]
    for i in range(60, 100):
        chain = [*chain[1:], f"d{i}"]
        rows.append((i, " ".join(chain)))
    assert run(spark, rows) == brute(rows)


def test_owed_pairs_of_full_keys(spark, monkeypatch):
    """With keys that count as full at once, all pairs come from stars and blocks."""
    rng = random.Random(7)
    rows = []
    for group in range(4):
        words = [f"g{group}w{i}" for i in range(30 + 20 * group)]
        rows += [(len(rows) + i, " ".join(edit(rng, words, i % 4))) for i in range(14)]
    classes = [jj.shingle_sets(*_raw(t))[0] for _, t in rows]
    keys = [jj.keys_of(c, jj.class_of(c)) for c in classes if len(c) >= 4]
    assert all(len(k) for k in keys)
    assert run(spark, rows) == brute(rows)


def _raw(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)])


def test_similar_sets_share_a_key():
    """Each pair that is similar enough meets under some key, for sets of all small sizes."""
    rng = np.random.default_rng(5)
    for _ in range(1500):
        size = int(rng.integers(4, 70))
        whole = np.unique(rng.integers(0, 2**63, size * 2, dtype=np.uint64) * np.uint64(2))
        rng.shuffle(whole)
        a = np.sort(whole[:size])
        most = int(jj.differing(np.array([2 * size]))[0])
        out, new = int(rng.integers(0, most // 2 + 1)), int(rng.integers(0, most // 2 + 2))
        b = np.sort(np.concatenate([np.delete(a, rng.permutation(size)[:out]), whole[size : size + new]]))
        if len(b) < 4 or not jj.similar(a, b) or len(a) == len(b) == 0:
            continue
        if len(a) == len(b) and (a == b).all():
            continue
        ka, kb = jj.keys_of(a, jj.class_of(a)), jj.keys_of(b, jj.class_of(b))
        plain = lambda k: set((k[(k & jj._EMPTY) == 0] & jj._HASH).tolist())
        empty = lambda k: set((k[(k & jj._EMPTY) == 1] & jj._HASH).tolist())
        marked = bool((ka & jj._SHORT).any() or (kb & jj._SHORT).any())
        assert plain(ka) & plain(kb) or (marked and empty(ka) & empty(kb))


def test_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((tuple(r)[:3] for r in jj.similar_groups(odd).collect()), key=str)
    assert got == brute(rows)
    assert jj.similar_groups(odd.limit(0)).count() == 0
    kept = jj.keep_one(odd, jj.similar_groups(odd))
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, 7, 9, None, 10], key=str)


def test_one_row_of_each_group_stays(spark):
    """Rows that share an id but not a text stay apart, null ids are reduced too, and the row kept does not depend on the order."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [
        (1, a, "x", 0), (1, b, "x", 0), (2, a + " more", "x", 0), (None, c, "y", 0), (None, c, "x", 0), (None, c + " end", "z", 0), (5, "", "x", 0), (5, "", "x", 0), (5, None, "x", 0), (7, b, "x", 0),
        (1, b, "w", 0),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, group_text string, group_one int")
    want = sorted([(1, a, "x", 0), (1, b, "w", 0), (None, min(c, c + " end", key=lambda t: hashed(spark, t)), None, 0), (5, "", "x", 0), (5, "", "x", 0), (5, None, "x", 0)], key=str)
    for docs in (frame, frame.repartition(5)):
        kept = jj.keep_one(docs, jj.similar_groups(docs))
        assert kept.columns == frame.columns
        got = [tuple(r) if r["doc_id"] is not None else (None, r["text"], None, 0) for r in kept.collect()]
        assert sorted(got, key=str) == want


def hashed(spark, text):
    return spark.createDataFrame([(text,)], "t string").selectExpr("xxhash64(t)").first()[0]
