"""The inverted index against plain Python."""

import random
import re

import pytest

from commerce_marts.operators.search import keyword_words
from commerce_marts.operators.text_index import TextIndex

WORDS = ["cat", "scatter", "the", "other", "über", "x_1", "c++", "a.b", "--", "1,200", "東京", "ab", "a", "aaaa", "men's"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "document_id bigint, text string")


def asked(spark, terms):
    return spark.createDataFrame([(t,) for t in terms], "term string")


def brute(texts, terms):
    out = {}
    for i, text in enumerate(texts):
        low = (text or "").lower()
        for t in set(terms):
            if t and t in low:
                words = 0 if " " in t else len(re.findall(rf"(?<!\w){re.escape(t)}(?!\w)", low))
                out[i, t] = (words, low.count(t))
    return out


def test_counts_of_all_kinds_of_terms(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "aaaa aa"] + ["".join(rng.choice(WORDS).upper() + rng.choice([" ", "  ", ". ", "\n", "-", ""]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    terms = WORDS + ["cat scatter", "the other", "the c++", "+ +", "c+", "at", "t", "zz", "zzz", "", "aa", ". ", "- -", "the", "über x_1", "'s"]
    terms = [t.strip() for t in terms]
    got = TextIndex(frame(spark, texts), "document_id", "text").counts(asked(spark, terms)).collect()
    assert len(got) == len({(r["document_id"], r["term"]) for r in got})
    assert {(r["document_id"], r["term"]): (r["words"], r["plain"]) for r in got} == brute(texts, terms)


@pytest.mark.parametrize("kind", ["word", "substring"])
def test_places(spark, kind):
    texts = ["cat scatter c++ cat", "aaaa aaa a", "the cat, the cat"]
    terms = ["cat", "c++", "aa", "the cat"]
    index = TextIndex(frame(spark, texts), "document_id", "text")
    rows = [(i, t, kind) for i, text in enumerate(texts) for t in terms if t in text]
    got = {(r["document_id"], r["term"]): r["positions"] for r in index.places(spark.createDataFrame(rows, "document_id bigint, term string, kind string")).collect()}
    want = {}
    for i, t, _ in rows:
        pattern = rf"(?<!\w){re.escape(t)}(?!\w)" if kind == "word" else re.escape(t)
        at = [m.start() + 1 for m in re.finditer(pattern, texts[i])]
        if at:
            want[i, t] = at
    assert got == want


def test_empty_inputs(spark):
    assert TextIndex(frame(spark, ["a"]).limit(0), "document_id", "text").counts(asked(spark, ["a"])).count() == 0
    assert TextIndex(frame(spark, ["a"]), "document_id", "text").counts(asked(spark, ["a"]).limit(0)).count() == 0


def test_a_hundred_thousand_terms(spark):
    rng = random.Random(8)
    syllables = ["ka", "ri", "to", "mu", "se", "len", "ost", "ing", "er"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    texts = [" ".join(word(rng.randrange(1, 5)) for _ in range(30)) for _ in range(150)]
    terms = sorted({word(rng.randrange(2, 9)) for _ in range(200_000)})[:100_000]
    assert len(terms) == 100_000
    terms += ["ing er", "to"]
    index = TextIndex(frame(spark, texts), "document_id", "text")
    got = {(r["document_id"], r["term"]): (r["words"], r["plain"]) for r in index.counts(asked(spark, terms)).collect()}
    want = {}
    for i, text in enumerate(texts):  # a term of letters lies inside a word
        inside = {w[a:b] for w in text.split() for a in range(len(w)) for b in range(a + 1, len(w) + 1)} | {"ing er"}
        want |= brute([text], inside.intersection(terms)) and {(i, t): v for (_, t), v in brute([text], inside.intersection(terms)).items()}
    assert got == want and len(got) > 5_000


def test_postings_grow_with_blocks_not_with_pairs(spark):
    texts = [f"The cat, the {'dog' if i % 3 else 'c++'} no {i % 5}" for i in range(2_000)]
    docs = frame(spark, texts).selectExpr("concat('k', document_id) AS document_id", "text").coalesce(2)
    index = TextIndex(docs, "document_id", "text")
    assert index.postings.count() < len(texts)  # one row for each text and token would be over five times as many as texts
    terms = ["the", "cat", "c++", "og", "no 4", "dog no"]
    got = {(int(r["document_id"][1:]), r["term"]): (r["words"], r["plain"]) for r in index.counts(asked(spark, terms)).collect()}
    assert got == brute(texts, terms)


def test_keywords_are_whole_words(spark):
    texts = ["Word words_ abc abcd, éclair wxyz2 ABCD-efgh\nnaïve x𐐨yzab 𐐨abcd abcd𐐨 good", "", None, "abcdé fine"]
    rows = frame(spark, texts).select("document_id", keyword_words("text").alias("words")).orderBy("document_id").collect()
    assert [r["words"] for r in rows] == [None if t is None else [w for w in re.findall(r"\w+", t.lower()) if re.fullmatch("[a-z]{4,}", w)] for t in texts]
