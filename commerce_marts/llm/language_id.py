"""Language of a text by filters that tell all languages of an n-gram at once.

Letters are lowered, everything else becomes one blank, and runs of 2 to 5 characters that hold a blank at
most at their ends are hashed to 64 bits. From a sample of documents with a language, a language keeps the
n-grams that make up enough of its text, and not much less than of any other language's. The kept n-grams
form one Bloom filter for each language, stored bit-sliced: slot s is a mask with one bit for each language,
so three lookups and two bitwise ands give the mask of all languages that hold an n-gram. A text counts, for each
language, how many of its n-grams have that bit; the share of bits a filter shows by chance is taken off, and
the language with the most left is the answer. Its part of what all languages have left is the score.

The filter's size does not depend on the data: a language keeps at most 1 / LEAST_SHARE n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, buffers, mix, slices, text_or_empty

#: Documents that a language is learned from, in the mean: those whose id hashes lie below a threshold.
TRAIN_DOCS = 4_000
SIZES = (2, 3, 4, 5)
#: A kept n-gram makes up this share of a language's n-grams, and this part of its share in any other language.
LEAST_SHARE, LEAST_PART = 1e-5, 0.25
#: Slots of the filter, as a power of two; lookups of an n-gram (their bits must fit into 64).
SLOT_BITS, LOOKUPS = 20, 3
#: Different n-grams that a task holds before it sends their counts on.
HELD_GRAMS = 1_000_000
UNKNOWN = "und"


# N-grams


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, lower form) of each code point; forms of several characters are left as they are."""
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(letters).tolist():
        form = chr(c).lower()
        if len(form) == 1:
            lower[c] = ord(form)
    return letters, lower


def _codes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, the rows' offsets in them); bytes that are no UTF-8 become U+FFFD."""
    try:
        codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:], strict=False)]
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, texts)])
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
    return codes, before[offsets]


def grams(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, rows) of all n-grams of some texts, one size after the other; rows do not fall."""
    letters, lower = _tables()
    codes, ends = _codes(raw, offsets)
    size = np.diff(ends)
    text = np.zeros(len(codes) + len(size) + 1, np.uint64)  # each row starts with a blank, and one ends the last
    row = np.append(np.repeat(np.arange(len(size)), size + 1), max(len(size) - 1, 0))
    text[np.arange(len(codes)) + np.repeat(np.arange(len(size)), size) + 1] = np.where(letters[codes], lower[codes], 0)
    keep = text != 0
    keep[1:] |= text[:-1] != 0
    keep[0] = True
    text, row = text[keep], row[keep]
    inside = text != 0
    whole = np.ones(len(text), bool)  # no blank between the ends
    rolling = text
    for n in range(2, max(SIZES) + 1):
        m = len(text) - n + 1
        if m <= 0:
            return
        rolling = rolling[:m] * np.uint64(0x100000001B3) + text[n - 1 :]
        if n > 2:
            whole = whole[:m] & inside[n - 2 : n - 2 + m]
        if n in SIZES:
            at = np.flatnonzero(whole[:m])
            # A blank in front may belong to the row before.
            yield mix(rolling[at] + np.uint64(n)), np.where(inside[at], row[at], row[at + 1])


def _texts(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of slices; a row longer than a slice comes in pieces, cut at blanks or between characters."""
    for a, b in slices(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        while hi - lo > SLICE_BYTES:
            to = lo + SLICE_BYTES
            blanks = np.flatnonzero(raw[lo:to] == 32)
            if len(blanks):
                to = lo + int(blanks[-1]) + 1
            else:
                while to > lo + 1 and raw[to] & 0xC0 == 0x80:
                    to -= 1
            yield a, raw[lo:to], np.array([0, to - lo])
            lo = to
        yield a, raw[lo:hi], (offsets[a : b + 1] - lo if b > a + 1 else np.array([0, hi - lo]))


# Learning


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language number, summed in the task."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        found, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, where, np.concatenate([p[1] for p in parts]))
        return found, total

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            found, total = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), lang, np.int32)), pa.array(found.view(np.int64)), pa.array(total)], ["lang_no", "gram", "n"])

    for batch in batches:
        langs = batch.column(0)
        for lang in pc.unique(langs).to_pylist():
            raw, offsets = buffers(batch.column(1).filter(pc.equal(langs, lang)))
            for _, part, ends in _texts(raw, offsets):
                hashes = [h for h, _ in grams(part, ends)]
                if hashes:
                    held.setdefault(lang, []).append(np.unique(np.concatenate(hashes), return_counts=True))
                    size += len(held[lang][-1][0])
                if size > HELD_GRAMS:
                    held = {k: [merged(v)] for k, v in held.items()}
                    size = sum(len(v[0][0]) for v in held.values())
                    if size > HELD_GRAMS // 2:
                        yield from rows()
                        held, size = {}, 0
    yield from rows()


@dataclass(frozen=True)
class Model:
    """Languages by number (the most frequent first) and the filter, a mask of languages for each slot, 64 of them in a word."""

    langs: list[str]
    masks: np.ndarray  # (words, slots)

    def chance(self) -> np.ndarray:
        """The share of n-grams that each language's filter shows without holding them."""
        return np.array([self.bits(self.masks[i // 64], i).mean() for i in range(len(self.langs))]) ** LOOKUPS

    @staticmethod
    def bits(masks: np.ndarray, lang_no: int) -> np.ndarray:
        return (masks >> np.uint64(lang_no % 64)) & np.uint64(1) == 1


def slots(gram: np.ndarray) -> list[np.ndarray]:
    """The places of some n-grams in the filter: successive bits of their hashes."""
    return [((gram >> np.uint64(i * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for i in range(LOOKUPS)]


def kept_grams(counts: DataFrame) -> DataFrame:
    """(lang_no, gram) of a filter, from counts (lang_no, gram, n) of all languages."""
    whole = counts.groupBy("lang_no").agg(F.sum("n").alias("whole"))  # one row for each language
    shares = counts.join(F.broadcast(whole), "lang_no").withColumn("share", F.col("n") / F.col("whole"))
    # A gram has one row for each language that holds it.
    most = F.max("share").over(Window.partitionBy("gram"))
    return shares.withColumn("most", most).filter((F.col("share") >= LEAST_SHARE) & (F.col("share") >= LEAST_PART * F.col("most"))).select("lang_no", "gram")


def train(docs: DataFrame, rows: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn languages from ``docs``: about ``rows`` documents each, chosen by the hashes of their ids, whole texts.

    Rows with a null language teach nothing; null ids share one hash; a language of empty texts is known but
    never counted. Without rows there are no languages. The driver gets the languages and the filter's slots.
    """
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), text_or_empty(docs, text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("hash")).filter("lang is not null")
    found = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    langs = [r["lang"] for r in found]
    words = max(1, -(-len(langs) // 64))
    masks = np.zeros((words, 1 << SLOT_BITS), np.uint64)
    if langs:
        # Hashes lie evenly between -2^63 and 2^63.
        upto = [(r["lang"], i, max(-(1 << 63), min((1 << 63) - 1, int((min(1.0, rows / r["count"]) - 0.5) * 2**64)))) for i, r in enumerate(found)]
        table = docs.sparkSession.createDataFrame(upto, "lang string, lang_no int, upto long")
        sample = known.join(F.broadcast(table), "lang").filter("hash <= upto").select("lang_no", "text")  # one row for each language
        counts = sample.mapInArrow(_count_grams, "lang_no int, gram long, n long").groupBy("lang_no", "gram").agg(F.sum("n").alias("n"))
        at = F.explode(F.array(*[F.shiftrightunsigned("gram", i * SLOT_BITS).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)) for i in range(LOOKUPS)]))
        filled = kept_grams(counts).select("lang_no", at.alias("slot")).groupBy("slot", F.expr("lang_no div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, lang_no % 64)")).alias("mask"))
        filled = filled.select(F.col("slot").cast("int"), F.col("word").cast("int"), "mask").toArrow()  # at most words times slots
        masks[np.asarray(filled["word"]), np.asarray(filled["slot"])] = np.asarray(filled["mask"]).view(np.uint64)
    return Model(langs, masks)


# Telling


def language_counts(raw: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of each row, for each row and language how many have its bit)."""
    rows = len(offsets) - 1
    total, hits = np.zeros(rows, np.int64), np.zeros((rows, len(model.langs)), np.int64)
    for first, part, ends in _texts(raw, offsets):
        some = len(ends) - 1
        for hashes, row in grams(part, ends):
            total[first : first + some] += np.bincount(row, minlength=some)
            places = slots(hashes)
            for word, masks in enumerate(model.masks):
                of = masks[places[0]]
                for place in places[1:]:
                    of &= masks[place]
                for i in range(64 * word, min(64 * word + 64, len(model.langs))):
                    hits[first : first + some, i] += np.bincount(row[model.bits(of, i)], minlength=some)
    return total, hits


def decide(total: np.ndarray, hits: np.ndarray, model: Model) -> tuple[list[str], np.ndarray]:
    """(language, score) of each row; rows without n-grams have no letter and get UNKNOWN and 0."""
    if not model.langs:
        return [UNKNOWN] * len(total), np.zeros(len(total))
    chance = model.chance()
    left = np.maximum(hits - total[:, None] * chance, 0) / np.maximum(1 - chance, 1e-9)
    best = left.argmax(axis=1)
    whole = left.sum(axis=1)
    score = np.where(whole > 0, left.max(axis=1) / np.where(whole > 0, whole, 1), 0.0)
    return [model.langs[i] if n else UNKNOWN for i, n in zip(best, total, strict=True)], np.where(total > 0, score, 0.0)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Add the language (a learned one, or UNKNOWN for null texts and texts without a letter) and its score (0 to 1).

    Only the text counts: equal texts get equal answers. A text with letters that no language holds gets the
    most frequent language with the score 0. Texts are read whole, very long ones in pieces that n-grams do not
    cross. An empty table stays empty; columns named like the new ones are replaced.
    """

    @F.arrow_udf("lang string, score double")
    def tell(text: pa.Array) -> pa.Array:
        langs, score = decide(*language_counts(*buffers(text), model), model)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score)], ["lang", "score"])

    told = tell(text_or_empty(docs, text_col))
    free = "told"
    while free in docs.columns:
        free += "_"
    out = docs.withColumn(free, told)
    return out.withColumns({lang_col: F.col(free)["lang"], score_col: F.col(free)["score"]}).drop(free)
