"""Pack token ids into sequences along a space-filling curve.

A document's hashed token counts are projected to four numbers, and these to a place on a Hilbert
curve. Documents are range-sorted by that place and cut into sequences in this order, so neighbours
on the curve share sequences. Each sorted part is packed as a stream; what is left at its end is cut
into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, settle, slices, text_or_empty

LENGTH, END = 2048, 1
FEATURES, DIMS, CURVE_BITS = 1024, 4, 8
#: Encoded pieces of text that a Python worker remembers, some 150 MB.
CACHE = 700_000


#: Texts of these characters are split by a pattern of the standard library, all others by the tokenizer.
PLAIN_TEXT = re.compile(r"[\t\n\r -~\u00c0-\u024f]*")
#: The split of byte-level BPE files for such texts.
PIECES = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class Encoder:
    """Token ids of a byte-level BPE file, with a memory of pieces of text that were seen before.

    Merges never cross the pieces into which the file's pre-tokenizer splits a text, so the ids of a
    text are those of its pieces, one after the other. A new piece is merged by the file's ranks.
    Texts with other characters or with a special token's string go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        vocabulary = {k: v for k, v in tokenizer.get_vocab(with_added_tokens=False).items() if k not in special}
        # The file writes bytes as printable characters; single bytes show which.
        letters = {c: i for i, c in _byte_letters(ByteLevel.alphabet()).items()}
        ranks = {bytes(letters[c] for c in k): v for k, v in vocabulary.items()}
        merge = tiktoken.Encoding("file", pat_str="\\s+|\\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        kind = np.uint16 if tokenizer.get_vocab_size() <= 1 << 16 else np.uint32

        class Memory(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= CACHE:
                    self.clear()
                ids = self[piece] = np.array(merge(piece.encode()), kind).tobytes()
                return ids

        self.kind, self.tokenizer, self.memory, self.special = kind, tokenizer, Memory(), special

    def encode(self, text: str) -> np.ndarray:
        if PLAIN_TEXT.fullmatch(text) is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
        return np.frombuffer(b"".join(map(self.memory.__getitem__, PIECES.findall(text))), self.kind)


def _byte_letters(alphabet: list[str]) -> dict[int, str]:
    """The character by which a byte-level file writes each byte: itself if it is one of the alphabet, else the next beyond U+00FF."""
    known = set(alphabet)
    own = {i: chr(i) for i in range(256) if chr(i) in known}
    rest = (chr(256 + n) for n in range(256))
    return own | {i: next(rest) for i in range(256) if i not in own}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _projection() -> np.ndarray:
    return np.random.default_rng(3).standard_normal((FEATURES, DIMS))


def _encode_all(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, projection = encoder(path).encode, _projection()
        for batch in batches:
            texts = batch.column(1)
            _, offsets = buffers(texts)
            for a, b in slices(offsets):
                ids = [encode(t.as_py() or "") for t in texts.slice(a, b - a)]
                counts = np.zeros((b - a, FEATURES))
                for i, x in enumerate(ids):
                    counts[i] = np.bincount((x.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(22), minlength=FEATURES)
                counts = np.sqrt(counts)
                place = counts @ projection / np.maximum(np.sqrt((counts**2).sum(axis=1, keepdims=True)), 1e-9)
                blobs = [np.append(x, np.array(end, x.dtype)) for x in ids]
                columns = [batch.column(0).slice(a, b - a), pa.array([len(x) for x in blobs], pa.int64()), pa.array([x.astype("<u4").tobytes() if x.dtype == np.uint32 else x.astype("<u2").tobytes() for x in blobs], pa.binary())]
                columns.append(pa.array([x.dtype.itemsize for x in blobs], pa.int32()))
                names = ["doc_id", "doc_tokens", "ids", "width", *[f"p{d}" for d in range(DIMS)]]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(place[:, d]) for d in range(DIMS)]], names)

    return run


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (rows) with whole coordinates of ``bits`` bits.

    From the highest bit down, the cube that holds a point is named by one bit for each axis; the
    axes are then turned and flipped as the curve runs through that cube. Orders by Gray code.
    """
    rows, dims = points.shape
    key = np.zeros(rows, np.int64)
    entry, turn = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    full = (1 << dims) - 1

    def rotate_right(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        by = by % dims
        return ((x >> by) | (x << (dims - by))) & full

    def rotate_left(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        return rotate_right(x, dims - by % dims)

    def gray(x: np.ndarray) -> np.ndarray:
        return x ^ (x >> 1)

    def ones(x: np.ndarray) -> np.ndarray:
        """How many low bits of x are set in a row."""
        count, going = np.zeros(rows, np.int64), np.ones(rows, bool)
        for b in range(dims):
            going &= ((x >> b) & 1) == 1
            count += going
        return count

    for bit in range(bits - 1, -1, -1):
        label = np.zeros(rows, np.int64)
        for d in range(dims):
            label |= ((points[:, d].astype(np.int64) >> bit) & 1) << d
        label = rotate_right(label ^ entry, turn + 1)
        place = label.copy()
        for s in (1, 2, 4, 8):
            if s < dims:
                place ^= place >> s
        key = (key << dims) | place
        start = np.where(place == 0, 0, gray(2 * ((place - 1) // 2)))
        along = np.where(place == 0, 0, np.where(place % 2 == 0, ones(np.maximum(place - 1, 0)), ones(place))) % dims
        entry = entry ^ rotate_left(start, turn + 1)
        turn = (turn + along + 1) % dims
    return key


def curve_key(places: list[Column], centres: list[float], spreads: list[float]) -> Column:
    """Hilbert place of a row's projections, each scaled by the table's mean and deviation."""

    @F.arrow_udf("long")
    def key(*columns: pa.Array) -> pa.Array:
        top = (1 << CURVE_BITS) - 1
        points = [np.clip((np.asarray(c) - m) / (s or 1.0) / 6 + 0.5, 0, 1) * top for c, m, s in zip(columns, centres, spreads, strict=True)]
        return pa.array(hilbert(np.stack(points, axis=1).astype(np.int64), CURVE_BITS), pa.int64())

    return key(*places)


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(length: int, with_ids: bool):
    """Cut one sorted part into sequences. Only the open sequence and one batch are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        waiting: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of the open sequence
        filled = sequence = 0

        def close(pieces: list[tuple]) -> None:
            nonlocal sequence
            at = 0
            for doc_id, start, ids, tokens in pieces:
                raw = ids.astype("<u4").tobytes()
                rows.append((doc_id, start, len(ids), zlib.crc32(raw), tokens, first + sequence, at, *([raw] if with_ids else [])))
                at += len(ids)
            sequence += 1

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
        kinds = [*[pa.int64()] * 7, pa.binary()]

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)

        for batch in batches:
            docs, sizes, blobs, widths = (batch.column(i) for i in range(4))
            for doc_id, tokens, blob, width in zip(docs.to_pylist(), sizes.to_pylist(), blobs, widths.to_pylist(), strict=True):
                ids = np.frombuffer(blob.as_buffer(), np.uint16 if width == 2 else np.uint32)
                at = 0
                while at < len(ids):
                    piece = ids[at : at + length - filled]
                    # A copy, so that the batch is not held.
                    waiting.append((doc_id, at, piece.copy(), tokens))
                    at += len(piece)
                    filled += len(piece)
                    if filled == length:
                        close(waiting)
                        waiting, filled = [], 0
                if len(rows) >= 10_000:
                    yield flush()
        # The rest: the largest power of two that fits, again and again.
        while filled:
            room = 1 << (filled.bit_length() - 1)
            filled -= room
            part = []
            while room:
                doc_id, start, ids, tokens = waiting.pop(0)
                part.append((doc_id, start, ids[:room], tokens))
                if len(ids) > room:
                    waiting.insert(0, (doc_id, start + room, ids[room:], tokens))
                room -= min(room, len(ids))
            close(part)
        if rows:
            yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents' token ids, packed into sequences of ``length`` ids.

    A document's ids are those of the tokenizer file ``tokenizer`` for its text (null: empty), then
    ``end``. Returns for each piece: id, start (the document's ids before it), length, ids_crc32
    (of little-endian unsigned 32-bit ids), doc_tokens, sequence_id and offset, with ``with_ids`` also
    ids (binary, the same encoding). Every id lies in one piece. Rows that repeat are packed each;
    null ids are kept; an empty table gives no rows; other columns are not read.
    """
    text = text_or_empty(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    places = [f"p{d}" for d in range(DIMS)]
    schema = "doc_id long, doc_tokens long, ids binary, width int, " + ", ".join(f"{p} double" for p in places)
    encoded = settle(rows.mapInArrow(_encode_all(tokenizer, end), schema), "tokens")
    stats = encoded.agg(*[F.avg(p) for p in places], *[F.stddev_pop(p) for p in places]).first()
    key = curve_key([F.col(p) for p in places], [x or 0.0 for x in stats[:DIMS]], [x or 0.0 for x in stats[DIMS:]])
    order = ["key", F.xxhash64("doc_id", "doc_tokens", "p0"), "doc_id"]
    keyed = encoded.select("doc_id", "doc_tokens", "ids", "width", "p0", key.alias("key"))
    sorted_ = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "doc_tokens", "ids", "width")
    return sorted_.mapInArrow(_pack(length, with_ids), _PIECES + (", ids binary" if with_ids else "")).withColumnRenamed("doc_id", id_col)
