"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Triplets of bytes that lie close together are hashed to buckets and counted. A bucket's code says in
which quarter of all buckets its count lies; equal texts have equal digests, and a change to a part
of a text moves only some codes. A digest is hexadecimal: the length on a logarithmic scale, then two
bits for each bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, buffers, settle, slices, text_or_empty

BUCKETS = 1024
#: Offsets of the second and third byte of the counted triplets.
TRIPLETS = ((2, 5), (3, 6), (4, 7))
LENGTH_SHARE = 0.05


def _counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Triplet counts by row and bucket; triplets that leave their row go to a last row, which is dropped."""
    rows, reach = len(offsets) - 1, max(j for _, j in TRIPLETS)
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(rows, dtype=np.int64) * BUCKETS, lengths)
    out = np.zeros((rows + 1) * BUCKETS, np.int64)
    base, last = raw.astype(np.uint32) * np.uint32(0x01000193), raw.astype(np.uint32) * np.uint32(0xC2B2AE35)
    shift = np.uint32(32 - (BUCKETS - 1).bit_length())
    # Places from which the longest triplet leaves its row.
    near_end = np.concatenate([offsets[1:][lengths > d] - 1 - d for d in range(reach)]) if rows else np.zeros(0, np.int64)
    left = np.repeat(np.arange(reach), [(lengths > d).sum() for d in range(reach)])
    for kind, (i, j) in enumerate(TRIPLETS):
        n = len(raw) - j
        if n <= 0:
            continue
        h = (base[:n] ^ raw[i : n + i]) * np.uint32(0x85EBCA6B) ^ last[j:]
        h ^= np.uint32(kind * 0x27D4EB2F & 0xFFFFFFFF)
        h *= np.uint32(0x9E3779B1)
        h >>= shift
        at = row[:n] + h
        out_of = near_end[left < j]
        at[out_of[out_of < n]] = rows * BUCKETS
        out += np.bincount(at, minlength=len(out))
    return out[: rows * BUCKETS].reshape(rows, BUCKETS)


def codes_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length codes, bucket codes 0 to 3) of a batch of texts; long texts are counted in overlapping pieces."""
    rows = len(offsets) - 1
    codes = np.zeros((rows, BUCKETS), np.uint8)
    for a, b in slices(offsets):
        part, inner = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if len(part) > 2 * SLICE_BYTES:
            counts = np.zeros((1, BUCKETS), np.int64)
            reach = max(j for _, j in TRIPLETS)
            for at in range(0, len(part), SLICE_BYTES):
                piece = part[at : at + SLICE_BYTES + reach]
                counts += _counts(piece, np.array([0, len(piece)]))
                # Triplets that start in the overlap count with the next piece.
                over = part[at + SLICE_BYTES : at + SLICE_BYTES + reach]
                if len(over):
                    counts -= _counts(over, np.array([0, len(over)]))
        else:
            counts = _counts(part, inner)
        cuts = np.partition(counts, [BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4], axis=1)[:, [BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4]]
        codes[a:b] = (counts[:, :, None] > cuts[:, None, :]).sum(axis=2, dtype=np.uint8)
    return np.round(np.log1p(np.diff(offsets)) * 8).astype(np.uint8), codes


def digests(lengths: np.ndarray, codes: np.ndarray) -> list[str]:
    shifted = codes.reshape(len(codes), BUCKETS // 4, 4) << np.array([6, 4, 2, 0], np.uint8)
    packed = np.bitwise_or.reduce(shifted, axis=2)
    return [f"{int(n):02x}{p.tobytes().hex()}" for n, p in zip(lengths, packed, strict=True)]


def parse(digest: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(digest), np.uint8)
    return raw[:1], ((raw[1:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).reshape(1, BUCKETS)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 minus the difference score, row by row; 1 for equal digests, 0 at the least.

    The difference is the sum of the codes' distances over the largest sum that such codes allow,
    with a small share for the distance of the lengths.
    """
    x, y = a[1].astype(np.int16), b[1].astype(np.int16)
    apart, most = np.abs(x - y).sum(axis=1), np.maximum(x, y).sum(axis=1)
    codes = np.where(most > 0, apart / np.maximum(most, 1), 0.0)
    lengths = np.minimum(np.abs(a[0].astype(np.int16) - b[0].astype(np.int16)) / 32, 1.0)
    return 1 - ((1 - LENGTH_SHARE) * codes + LENGTH_SHARE * lengths)


def text_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return codes_of(*buffers(pa.array(texts, pa.large_string())))


def fingerprint_documents(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """Add the digest of each row's whole text. Null and empty texts have that of no triplets.

    Equal texts have equal digests; an empty table stays empty; a column of the new name is replaced.
    """

    @F.arrow_udf("string")
    def digest(text: pa.Array) -> pa.Array:
        return pa.array(digests(*codes_of(*buffers(text))), pa.string())

    return docs.withColumn(out_col, digest(text_or_empty(docs, text_col)))


def edited(text: str, following: str) -> str:
    """``text`` whose last half (code points, rounded down) is replaced by as many from the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGES = "part int, first_text string, last_text string"


def _compare(ids: list, texts: list[str], own: tuple, following: list[str], after: tuple) -> dict:
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    codes = text_codes(changed)
    return {
        "doc_id": ids, "n_chars": [len(x) for x in texts], "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in changed],
        "fingerprint": digests(*own), "edited_fingerprint": digests(*codes), "near_edited": likeness(own, codes), "near_next": likeness(own, after),
    }


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row of a sorted part with the row after it; the first and the last leave their text for the neighbours."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("first_text", pa.string()), ("last_text", pa.string()),
    ])

    def record(rows: dict, n: int) -> pa.RecordBatch:
        full = {name: rows.get(name, [None] * n) for name in schema.names} | {"part": [part] * n}
        return pa.RecordBatch.from_arrays([pa.array(full[f.name], f.type) for f in schema], schema=schema)

    waiting = None
    for batch in batches:
        ids, column = batch.column(0).to_pylist(), batch.column(1)
        _, offsets = buffers(column)
        for a, b in slices(offsets):
            texts = column.slice(a, b - a).to_pylist()
            lengths, codes = text_codes(texts)
            if waiting is None:
                yield record({"first_text": [texts[0]]}, 1)
                waiting = (ids[a], texts[0], lengths[:1], codes[:1])
                now_ids, now_texts, now = ids[a + 1 : b], texts[1:], (lengths[1:], codes[1:])
            else:
                now_ids, now_texts, now = ids[a:b], texts, (lengths, codes)
            if not now_texts:
                continue
            own = (np.concatenate([waiting[2], now[0][:-1]]), np.concatenate([waiting[3], now[1][:-1]]))
            yield record(_compare([waiting[0], *now_ids[:-1]], [waiting[1], *now_texts[:-1]], own, now_texts, now), len(now_texts))
            waiting = (now_ids[-1], now_texts[-1], now[0][-1:], now[1][-1:])
    if waiting:
        yield record({"doc_id": [waiting[0]], "n_chars": [len(waiting[1])], "last_text": [waiting[1]]}, 1)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for the last rows of parts and the first ones of the parts after them."""
    for batch in batches:
        for i in range(batch.num_rows):  # one pair at a time: edge texts may be long
            doc_id, text, following = (c[i].as_py() for c in batch.columns)
            rows = _compare([doc_id], [text], text_codes([text]), [following], text_codes([following]))
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in rows.items()})


def compare_along(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Compare each document with its half-edited text and with the next document by descending id.

    Documents are range-sorted by id and each sorted part is read as a stream; texts move once. What
    the edges of parts lack is compared after that, one pair for each part. Nulls and empty texts
    count as empty; null ids come last; rows that share an id are ordered by a hash of their text.
    The only row of a table is its own next. An empty table gives no rows. Other columns are not read.
    """
    text = text_or_empty(docs, text_col)
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = settle(rows.mapInArrow(_along, f"{_RESULT}, {_EDGES}"), "fingerprints")
    parts = found.filter("first_text is not null").select("part", "first_text")
    # One row for each part: bounded by the number of partitions.
    around = parts.select("part").withColumn("next", F.lead("part").over(Window.orderBy("part")))
    around = around.crossJoin(parts.agg(F.min("part").alias("start"))).select("part", F.coalesce("next", "start").alias("next"))
    lasts = found.filter("last_text is not null").select("part", "doc_id", "last_text").join(around, "part")
    pairs = lasts.join(parts.withColumnRenamed("part", "next"), "next").select("doc_id", "last_text", "first_text")
    inner = found.filter("edited_sha256 is not null").drop("part", "first_text", "last_text")
    return inner.unionByName(pairs.mapInArrow(_across, _RESULT)).withColumnRenamed("doc_id", id_col)
