"""Quality classifier over hashed n-gram vectors.

A document is the mean of learned vectors of its hashed grams: words, pairs of neighbouring words,
and runs of three to five bytes. Two softmax outputs follow. Vectors and outputs are trained together
by stochastic gradient descent in numpy. As both layers are linear, a trained model folds into one
number for each bucket: a document's logit is the mean of its grams' numbers plus a bias, so scoring
needs one lookup for each gram and texts never leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, SLICE_BYTES, buffers, mix, slices, text_or_empty, word_hashes

#: Labelled rows the model is fitted on: those with the smallest hashes of their ids.
TRAIN_ROWS = 6_000
BUCKET_BITS, DIMS, EPOCHS, RATE = 16, 8, 6, 0.5
#: Few rows are passed more often, up to this many steps.
MIN_STEPS = 12_000
BYTE_GRAMS = (3, 4, 5)
SEED = 11


@dataclass(frozen=True)
class Model:
    """Buckets' contributions to the logit of label 1, and the bias, which is the logit of a text without grams."""

    weights: np.ndarray
    bias: float


def _byte_grams(raw: np.ndarray, n: int) -> np.ndarray:
    """Buckets of all runs of ``n`` bytes."""
    if len(raw) < n:
        return np.zeros(0, np.int64)
    h = np.full(len(raw) - n + 1, 2166136261 + n, np.uint32)
    for i in range(n):
        h = (h ^ raw[i : len(raw) - n + 1 + i]) * np.uint32(16777619)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _word_grams(words: np.ndarray) -> list[np.ndarray]:
    """Buckets of words, of neighbouring pairs, and of a word that equals the first, second or third word before it."""
    grams = [_bucket(words)]
    if len(words) > 1:
        grams.append(_bucket(words[:-1] * np.uint64(3) + words[1:]))
    for back in (1, 2, 3):
        if len(words) > back:
            same = words[back:] == words[:-back]
            grams.append(_bucket(np.where(same, np.uint64(2 * back), np.uint64(2 * back + 1))))
    return grams


def pieces(text: np.ndarray) -> Iterator[np.ndarray]:
    """A text in pieces of bounded size, cut after white space where there is some."""
    at = 0
    while at < len(text):
        to = min(len(text), at + SLICE_BYTES)
        if to < len(text):
            spaces = np.flatnonzero(text[at:to] == 32)
            to = at + int(spaces[-1]) + 1 if len(spaces) else to
        yield text[at:to]
        at = to


def grams_of(text: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of all grams of a text; grams do not cross the pieces of a very long one."""
    for part in pieces(text):
        for n in BYTE_GRAMS:
            yield _byte_grams(part, n)
        yield from _word_grams(word_hashes(part, np.array([0, len(part)]), PLAIN)[0])


def fit(rows: Iterable[tuple[bytes, int]], dims: int = DIMS, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Train vectors and outputs on (text, label) by stochastic gradient descent, one document a step, the rate falling to 0.

    Without rows the model scores 0.5 everywhere; with one label only it leans to that label. Of each
    text only its buckets and their shares are held, six bytes a bucket.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dims, 1 / dims, (1 << BUCKET_BITS, dims)).astype(np.float32)
    out = np.zeros((2, dims), np.float32)
    all_ids, all_parts, ends, known = bytearray(), bytearray(), [0], []
    for text, label in rows:
        grams = [g for g in grams_of(np.frombuffer(text, np.uint8)) if len(g)]
        if grams:
            ids, counts = np.unique(np.concatenate(grams), return_counts=True)
            all_ids += ids.astype(np.uint16).tobytes()
            all_parts += (counts / counts.sum()).astype(np.float32).tobytes()
        ends.append(len(all_ids) // 2)
        known.append(int(label))
    held, shares = np.frombuffer(all_ids, np.uint16), np.frombuffer(all_parts, np.float32)
    labels = np.array(known, np.int64)
    share = float(np.clip((labels.sum() + 1) / (len(labels) + 2), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    prior = np.log(share / (1 - share))
    bias = np.array([0.0, prior], np.float32)
    docs = list(zip(ends, ends[1:], strict=False))
    if docs:
        epochs = max(epochs, MIN_STEPS // len(docs))
    step, steps = 0, max(1, epochs * len(docs))
    for _ in range(epochs):
        for d in rng.permutation(len(docs)):
            first, last = docs[d]
            ids, part = held[first:last], shares[first:last]
            now = rate * (1 - step / steps)
            step += 1
            if not len(ids):
                continue
            own = vectors[ids]
            hidden = part @ own
            logits = out @ hidden + bias
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            wrong = -chance
            wrong[int(labels[d])] += 1
            back = wrong @ out
            out += now * np.outer(wrong, hidden)
            bias += np.float32(0.1 * now) * wrong
            # The mean spreads a document's step thinly over its grams; it is scaled back to a common size.
            vectors[ids] = own + np.float32(now * 20) * np.outer(part, back)
    logit = (vectors @ (out[1] - out[0])).astype(np.float32)
    return Model(logit, float(bias[1] - bias[0]))


def score_buffers(raw: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Scores of a batch of texts."""
    rows = len(offsets) - 1
    total, count = np.zeros(rows), np.zeros(rows)

    def add(values: np.ndarray, ends: np.ndarray, first: int) -> None:
        sums = np.zeros(len(values) + 1)
        np.cumsum(values, out=sums[1:])
        total[first : first + len(ends) - 1] += sums[ends[1:]] - sums[ends[:-1]]
        count[first : first + len(ends) - 1] += np.diff(ends)

    def within(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For runs of n items: which start in a row that holds them whole, and where rows begin among these."""
        size = np.maximum(np.diff(starts) - n + 1, 0)
        keep = np.repeat(np.arange(len(size)), size)
        ends = np.concatenate([[0], np.cumsum(size)])
        return starts[keep] + np.arange(len(keep)) - ends[keep], ends

    for a, b in slices(offsets):
        part, inner = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if b == a + 1 and len(part) > SLICE_BYTES:
            for grams in grams_of(part):
                total[a] += model.weights[grams].sum(dtype=np.float64)
                count[a] += len(grams)
            continue
        for n in BYTE_GRAMS:
            at, ends = within(inner, n)
            if len(at):
                add(model.weights[_byte_grams(part, n)[at]], ends, a)
        words, starts = word_hashes(part, inner, PLAIN)
        if len(words):
            add(model.weights[_bucket(words)], starts, a)
            at, ends = within(starts, 2)
            add(model.weights[_bucket(words[at] * np.uint64(3) + words[at + 1])], ends, a)
            for back in (1, 2, 3):
                at, ends = within(starts, back + 1)
                add(model.weights[_bucket(np.where(words[at] == words[at + back], np.uint64(2 * back), np.uint64(2 * back + 1)))], ends, a)
    logit = np.where(count > 0, total / np.maximum(count, 1), 0.0) + model.bias
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def scorer(model: Model):
    """A column function: text to score."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(score_buffers(*buffers(text), model))

    return score


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit a model on at most ``rows`` labelled documents, those with the smallest hashes of their ids.

    Rows without a label or an id teach nothing. Labels of one id are averaged, a tie counts as 1;
    an id that stands on several rows teaches with each.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg((F.avg(F.col(label_col)) >= 0.5).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    # The bound on the rows above bounds what is broadcast.
    sample = docs.select(F.col(id_col).alias("id"), text_or_empty(docs, text_col).alias("text")).join(F.broadcast(known), "id")
    sample = sample.orderBy(F.xxhash64("id"), "id").limit(rows).select("text", "label")
    # One task fits the model, over that many rows at most; the driver sees the folded weights only.
    row = sample.mapInArrow(_fit_task, "weights binary, bias double").first()
    return Model(np.frombuffer(row["weights"], np.float32), row["bias"]) if row else fit([])


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((text.as_buffer().to_pybytes(), label.as_py()) for batch in batches for text, label in zip(*batch.columns, strict=True))
    model = fit(rows)
    yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], ["weights", "bias"])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that no model may learn from: crc32 of the id as text divides by ``folds``; null counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add ``score_col`` (double, 0 to 1, higher where label 1 is likelier) to every row.

    Only the text counts. Null and empty texts, which hold no gram, get the score of the model's
    bias; equal texts get equal scores; an empty table stays empty. Texts are read whole, very long
    ones in pieces. A column named like the new one is replaced.
    """
    return docs.withColumn(score_col, scorer(model)(text_or_empty(docs, text_col)))
