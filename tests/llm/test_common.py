import random
import re

import numpy as np
import pyarrow as pa

from commerce_marts.llm import common


def test_word_hashes_tell_words_apart():
    texts = ["The the THE", "", " a\tb\nc ", "é É", None, "x" * 10 + " the", "the"]
    words, starts = common.word_hashes(*common.buffers(pa.array(texts)))
    assert list(np.diff(starts)) == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert words[0] == words[1] == words[2] == words[-1] == words[-2]
    assert len({int(w) for w in words}) == len({"the", "a", "b", "c", "é", "É", "x" * 10})


def test_long_rows_hash_like_short_ones():
    text = ("word " * 700_000 + "y" * 3_000_000 + " end").encode()
    raw = np.frombuffer(text, np.uint8)
    words, _ = common.word_hashes(raw, np.array([0, len(raw)]))
    assert len(words) == 700_002 and len(set(words[:-2].tolist())) == 1
    assert words[-1] == common.word_hashes(np.frombuffer(b"end", np.uint8), np.array([0, 3]))[0][0]


def test_buffers_of_slices_and_nulls():
    column = pa.array(["ab", None, "", "cde", "f"]).slice(1, 3)
    raw, offsets = common.buffers(column)
    assert raw.tobytes() == b"cde" and list(offsets) == [0, 0, 0, 3]


def test_components(spark):
    random.seed(2)
    links = [(random.randrange(400), random.randrange(400)) for _ in range(260)]
    links += [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2400)] + [(7, 7), (3000, 3000)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
