import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from commerce_marts.llm import language_id, queries
from commerce_marts.llm.common import buffers


def plain_grams(text):
    """The n-grams of a text as strings, without hashes or arrays."""
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split()
    line = " " + " ".join(words) + " "
    return [line[i : i + n] for n in language_id.SIZES for i in range(len(line) - n + 1) if " " not in line[i + 1 : i + n - 1]] if words else []


def hashed(texts):
    out = defaultdict(list)
    for hashes, rows in language_id.grams(*buffers(pa.array(texts))):
        for h, r in zip(hashes.tolist(), rows.tolist(), strict=True):
            out[r].append(h)
    return out


TEXTS = ["The cat, sat!", "", None, "a", "1 + 1 = 2", "Ünïted  ÉTATS—d'Amérique", "東京は夜", "no", "ends with letter", "x" * 9, "İstanbul \U0001d400b", " \n ", "z"]


def test_grams_are_those_of_the_definition():
    names, got = {}, hashed(TEXTS)
    for row, text in enumerate(TEXTS):
        want = Counter(plain_grams(text or ""))
        assert sorted(Counter(got[row]).values()) == sorted(want.values()), text
        for gram in want:
            (own,) = hashed([gram.strip()]) or [0]
            names.setdefault(gram, own)
    alone = {t: hashed([t])[0] for t in TEXTS if t}
    assert all(sorted(alone[t]) == sorted(got[i]) for i, t in enumerate(TEXTS) if t)


def samples(n=40):
    rng = np.random.default_rng(4)
    parts = {"aa": "ka ri to mu se", "bb": "str ang ung eit sch", "cc": "ел ов на ст ра"}
    rows = []
    for i in range(n):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang].split(), 3)) for _ in range(30)), lang))
    return rows


def test_filter_equals_sets(spark):
    rows = samples()
    docs = spark.createDataFrame([*rows, (None, "x y z", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs, rows=10**6)
    assert model.langs == ["aa", "bb", "cc"]
    counts = {la: Counter(h for r in rows if r[2] == la for h in hashed([r[1]])[0]) for la in model.langs}
    share = {la: {g: n / sum(c.values()) for g, n in c.items()} for la, c in counts.items()}
    kept = {la: {g for g, s in own.items() if s >= 1e-5 and s >= 0.25 * max(o.get(g, 0) for o in share.values())} for la, own in share.items()}
    texts = [r[1] for r in samples(9)] + ["kari schung", "", "елов kari"]
    total, hits = language_id.language_counts(*buffers(pa.array(texts)), model)
    for i, text in enumerate(texts):
        grams = hashed([text])[0]
        assert total[i] == len(grams)
        exact = [sum(g in kept[la] for g in grams) for la in model.langs]
        # A Bloom filter never misses, and shows next to nothing by chance at this fill.
        assert all(e <= h <= e + 1 for e, h in zip(exact, hits[i], strict=True))
    langs, score = language_id.decide(total, hits, model)
    assert langs[:9] == ["aa", "bb", "cc"] * 3 and langs[10] == "und" and all(0 <= s <= 1 for s in score)


def test_chance_is_taken_off():
    rng = np.random.default_rng(1)
    full, none = rng.random(1 << language_id.SLOT_BITS) < 0.6, np.zeros(1 << language_id.SLOT_BITS, bool)
    model = language_id.Model(["noisy", "empty"], np.array([full.astype(np.uint64) | none.astype(np.uint64) << np.uint64(1)]))
    assert abs(model.chance()[0] - 0.6**3) < 0.01
    text = ["".join(chr(0x61 + i) for i in rng.integers(0, 26, 200_000))]
    total, hits = language_id.language_counts(*buffers(pa.array(text)), model)
    assert abs(hits[0, 0] / total[0] - 0.6**3) < 0.01 and hits[0, 1] == 0


def test_more_languages_than_a_word_has_bits(spark):
    rng = np.random.default_rng(2)
    words = {f"l{i:02d}": ["".join(chr(0x4E00 + x) for x in rng.integers(40 * i, 40 * i + 40, 3)) for _ in range(20)] for i in range(70)}
    rows = [(j * 70 + i, " ".join(rng.choice(w, 12)), la) for j in range(3) for i, (la, w) in enumerate(words.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert len(model.langs) == 70 and model.masks.shape[0] == 2
    assert language_id.predict(docs, model).filter("lang <> lang_pred").count() == 0


def test_odd_rows(odd, spark):
    model = language_id.train(spark.createDataFrame(samples(), "doc_id long, text string, lang string"))
    got = language_id.predict(odd.withColumnRenamed("source", "told"), model)
    assert got.columns == ["doc_id", "text", "lang", "told", "n_chars", "score", "lang_pred"]
    rows = got.collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {1, 2, 3}
    assert language_id.predict(odd.limit(0), model).count() == 0
    nothing = language_id.train(odd.limit(0))
    assert nothing.langs == [] and {r["lang_pred"] for r in language_id.predict(odd, nothing).collect()} == {"und"}
    assert language_id.train(odd).langs == ["en"]


def test_pieces_of_long_texts_and_bytes_that_are_no_text(monkeypatch):
    text = "Wörter und noch mehr Wörter " * 200
    whole, _ = language_id.language_counts(*buffers(pa.array([text, "ab"])), language_id.Model([], np.zeros((1, 1 << 20), np.uint64)))
    monkeypatch.setattr(language_id, "SLICE_BYTES", 500)
    monkeypatch.setattr(language_id, "slices", lambda offsets: ((i, i + 1) for i in range(len(offsets) - 1)))
    parts, _ = language_id.language_counts(*buffers(pa.array([text, "ab"])), language_id.Model([], np.zeros((1, 1 << 20), np.uint64)))
    assert (whole == parts).all() and whole[1] > 0
    list(language_id.grams(np.frombuffer(b"ab\xff\xfecd", np.uint8), np.array([0, 3, 6])))
    long = "é" * 3000
    assert language_id.language_counts(*buffers(pa.array([long])), language_id.Model([], np.zeros((1, 1 << 20), np.uint64)))[0][0] > 11_000


def test_held_out_accuracy(spark):
    root = "/root/testdata/sf0.01"
    got = queries.op13_languages(spark, root)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "lang").collect()}
    rows = got.collect()
    assert len(rows) == len(known) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r["lang_pred"] == known[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(held) / len(held) > 0.99


def test_held_out_rows_teach_nothing(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "train", lambda docs, **k: seen.append(docs) or language_id.Model([], np.zeros((1, 1 << 20), np.uint64)))
    queries.language_model(spark, "/root/testdata/sf0.001")
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in seen[0].select("doc_id").collect())
