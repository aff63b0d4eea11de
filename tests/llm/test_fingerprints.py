import hashlib

import numpy as np
import pytest
from conftest import ROOT

from commerce_marts.llm import fingerprints, queries


def test_query_equals_brute_force(spark):
    texts = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()), reverse=True)
    got = {r["doc_id"]: r for r in queries.op9_fingerprints(spark, ROOT).collect()}
    assert len(got) == len(texts)
    better = 0
    for i, (d, t) in enumerate(texts):
        following = texts[(i + 1) % len(texts)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = (fingerprints.text_codes([x]) for x in (t, changed, following))
        assert r["fingerprint"] == fingerprints.digests(*a)[0] and r["edited_fingerprint"] == fingerprints.digests(*b)[0]
        assert r["near_edited"] == pytest.approx(fingerprints.likeness(a, b)[0]) and r["near_next"] == pytest.approx(fingerprints.likeness(a, c)[0])
        assert fingerprints.likeness(fingerprints.parse(r["fingerprint"]), fingerprints.parse(r["edited_fingerprint"]))[0] == pytest.approx(r["near_edited"])
        better += r["near_edited"] > r["near_next"]
    assert better > 0.95 * len(texts)


def test_counts_stay_within_rows():
    one = fingerprints.text_codes(["some text of its own", "ab", "", "é" * 9, "x"])
    for i, t in enumerate(["some text of its own", "ab", "", "é" * 9, "x"]):
        alone = fingerprints.text_codes([t])
        assert (one[1][i] == alone[1][0]).all() and one[0][i] == alone[0][0]


def test_long_texts_are_counted_whole():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 123, 5_000_000, dtype=np.uint8)
    _, codes = fingerprints.codes_of(raw, np.array([0, len(raw)]))
    counts = fingerprints._counts(raw, np.array([0, len(raw)]))
    b = fingerprints.BUCKETS
    cuts = np.sort(counts[0])[[b // 4, b // 2, 3 * b // 4]]
    assert (codes[0] == (counts[0][:, None] > cuts).sum(axis=1)).all()


def test_likeness_is_bounded():
    a, b = fingerprints.text_codes(["abcdefgh " * 30]), fingerprints.text_codes(["0123456789 " * 300])
    assert fingerprints.likeness(a, a)[0] == 1 and 0 <= fingerprints.likeness(a, b)[0] < 0.5


def test_odd_rows(spark, odd):
    got = fingerprints.compare_along(odd).collect()
    assert len(got) == 12
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert fingerprints.compare_along(odd.limit(0)).count() == 0
    one = fingerprints.compare_along(spark.createDataFrame([(5, "abcdefghij")], "doc_id long, text string")).collect()[0]
    assert one["edited_sha256"] == hashlib.sha256(b"abcdeabcde").hexdigest() and one["near_next"] == 1
    assert fingerprints.fingerprint_documents(odd).columns == [*odd.columns, "fingerprint"]
