import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
from conftest import ROOT

from commerce_marts.llm import divergence, queries

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least=3, top=200):
    """The contract, word for word, over (lang, source, text)."""
    rows = [(la or "", so or "", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for la, so, t in rows]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for la, so, t in rows:
        terms = TERM.findall(t)
        seen[la].update(set(terms))
        counts[la, so].update(terms)
    out = set()
    for la in {r[0] for r in rows}:
        kept = [t for t, n in seen[la].items() if n >= least]
        groups = [so for x, so in counts if x == la]
        whole = sum((counts[la, so] for so in groups), Counter())

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // n for t in kept}

        p, q = {so: shares(counts[la, so]) for so in groups}, shares(whole)
        for so in groups:
            pairs = [(sum((p[so][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != so]
            terms = [((p[so][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[la, so][t] and p[so][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(la, so, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)}
    return out


def rows_of(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_sql(spark):
    sql = queries.SQL["op11_divergence"].replace("documents)", f"'{ROOT}/documents.parquet')")
    assert sql.count(ROOT) == 1
    want = {tuple(r) for r in duckdb.sql(f"SELECT lang, source, part, item, value, rank FROM ({sql})").fetchall()}
    assert rows_of(queries.op11_divergence(spark, ROOT)) == want and want


def test_odd_rows(odd):
    got = divergence.audit_sources(odd)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute([(r["lang"], r["source"], r["text"]) for r in odd.collect()])
    assert rows_of(got) == want and any(x[2] == "term" for x in want)
    assert divergence.audit_sources(odd.limit(0)).count() == 0


def test_long_and_foreign_terms(spark, monkeypatch):
    words = ["a" * n for n in (1, 7, 8, 9, 15, 16, 17, 18, 40)] + ["b" * 16 + "a", "b" * 16 + "c", "é" * 4, "é" * 5, "é" * 9, "東京" * 3, "x1y", "Straße"]
    rows = [(i, " ".join(words[: 3 + i % len(words)] * (1 + i % 3)) + "\x00-@[`{\x7f", ("de", None, "fr")[i % 3], f"s{i % 4}" if i % 4 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = brute([(r[2], r[3], r[1]) for r in rows], top=5)
    assert rows_of(divergence.audit_sources(docs, top=5)) == want


def test_no_kept_terms(spark):
    docs = spark.createDataFrame([("only here", "xx", "a"), ("1234", "xx", "b"), (None, "yy", None)], "text string, lang string, source string")
    assert rows_of(divergence.audit_sources(docs)) == {("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)}


def test_pieces_of_one_document_count_once(monkeypatch):
    text = pa.array(["Word longer-than-a-piece " * 500 + "abcdefghijklmnopqrstuvwxyz " * 90])
    raw, offsets = divergence.buffers(text)
    whole = divergence.count_terms(raw, offsets, np.zeros(1, np.uint32))
    monkeypatch.setattr(divergence, "PIECE_BYTES", 300)
    parts = divergence._runs_of(raw, offsets, np.zeros(1, np.uint32))
    as_set = lambda r: {(tuple(w), n, d) for w, n, d in zip(r.words.tolist(), r.n.tolist(), r.docs.tolist(), strict=True)} | set(r.long)
    assert as_set(parts) == as_set(whole) and all(d == 1 for d in parts.docs) and whole.long[0][2:] == (90, 1)


def test_runs_held_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 20))) for _ in range(40)) for _ in range(80)]
    batch = pa.RecordBatch.from_arrays([pa.array(["l1", "l2"] * 40), pa.array(["s"] * 80), pa.array(texts)], ["lang", "source", "text"])

    def sums():
        total = Counter()
        for out in divergence._count_texts(iter([batch, batch])):
            for r in out.to_pylist():
                total[r["lang"], r["term"]] += r["n"]
                total[r["lang"], r["term"], "docs"] += r["docs"]
        return total

    want = sums()
    monkeypatch.setattr(divergence, "HELD_RUNS", 50)
    monkeypatch.setattr(divergence, "PIECE_BYTES", 2000)
    assert sums() == want


def test_languages_in_blocks(spark, monkeypatch):
    rows = [(f"one two three {i % 5} four{'x' * (i % 3)}", f"l{i % 7}", f"s{i % 11}") for i in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    want = rows_of(divergence.audit_sources(docs))
    monkeypatch.setattr(divergence, "GROUPS_AT_ONCE", 12)
    assert rows_of(divergence.audit_sources(docs)) == want == brute([(b, c, a) for a, b, c in rows])


def test_sparse_pairs_equal_full_ones(monkeypatch):
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, (50, 6)) * rng.integers(0, 2, (50, 6))
    wholes = counts.sum(axis=0) + 50
    p = np.stack([divergence._shares(counts[:, s], np.full(50, wholes[s])) for s in range(6)], axis=1)
    full = np.array([[((p[:, a] - p[:, b]) ** 2 // p[:, b]).sum() for b in range(6)] for a in range(6)])
    term, source = np.nonzero(counts)
    assert (divergence.pair_values(term, source, counts[term, source], 50, wholes) == full).all()
