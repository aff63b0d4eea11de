"""Text cleaning and chunking.

Cleaning, splitting and fixed-size chunks are column expressions. Sentence and word chunks carry
state from one chunk to the next, so the fold over one text runs in a small Arrow function; the
texts stay partitioned as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import as_col

BREAK = "\u0001"


def clean_text(text: str | Column) -> Column:
    """Collapse white space, turn symbols other than . ! ? - into spaces, trim."""
    spaced = F.regexp_replace(as_col(text), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(spaced, r"[^\p{L}\p{N}_\s.!?-]", " "))


def _fold(units: list[str], sizes: list[int], limit: int, overlap: int, overlap_units: bool) -> list[tuple[int, int, int]]:
    """Spans (start, end, size) of consecutive units of at most ``limit``, each started with an overlap.

    ``overlap`` counts units, or units of size when ``overlap_units`` is off; then whole trailing
    units are repeated while they fit into it.
    """
    spans, start, size = [], 0, 0
    for i, own in enumerate(sizes):
        if size + own > limit and i > start:
            spans.append((start, i, size))
            first = start
            if overlap_units:
                start = max(first, i - overlap) if overlap else i
            else:
                kept, start = 0, i
                while start > first + 1 and kept + sizes[start - 1] <= overlap:
                    start -= 1
                    kept += sizes[start]
            size = sum(sizes[start:i])
        size += own
    if units:
        spans.append((start, len(units), size))
    return spans


def chunk_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 512, overlap: int = 50, overlap_sentences: bool = False, source: str | None = None) -> DataFrame:
    """Chunks of whole sentences of at most ``size`` words.

    The overlap is counted in words, so a chunk repeats the last sentences of the one before that
    fit into it; ``overlap_sentences`` counts sentences instead. Ids come from source, index and the
    head of the chunk. One row is read at a time and its chunks leave in slices; null texts have none.
    """
    parts = F.split(F.regexp_replace(clean_text(text), r"(?<=[.!?])\s+", BREAK), BREAK, -1)
    prepared = docs.select(F.col(key), parts.alias("parts"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                units = batch.column(1)[i].as_py() or []
                sizes = [len(u.split()) for u in units]
                spans = _fold(units, sizes, size, overlap, overlap_sentences)
                for at in range(0, len(spans), 1000):
                    part = spans[at : at + 1000]
                    columns = [
                        pa.array([batch.column(0)[i].as_py()] * len(part), batch.column(0).type), pa.array(range(at, at + len(part)), pa.int32()),
                        pa.array([" ".join(units[a:b]) for a, b, _ in part], pa.string()), pa.array([b - a for a, b, _ in part], pa.int32()), pa.array([n for *_, n in part], pa.int32()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [key, "chunk_index", "chunk_text", "chunk_size", "word_count"])

    kind = docs.schema[key].dataType.simpleString()
    out = prepared.mapInArrow(fold, f"{key} {kind}, chunk_index int, chunk_text string, chunk_size int, word_count int")
    name = F.lit(source) if source else F.col(key).cast("string")
    digest = F.md5(F.concat(name, F.lit("_"), F.col("chunk_index").cast("string"), F.lit("_"), F.substring("chunk_text", 1, 100)))
    return out.withColumn("chunk_id", F.substring(digest, 1, 16))


def _word_spans(lengths: np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of words whose text, a blank after each word, reaches ``size``; each begins ``overlap`` words back.

    Ends are looked up in the running sum of the lengths, so a chunk costs one search.
    """
    ends = np.concatenate([[0], np.cumsum(lengths + 1)])
    spans, start, closed = [], 0, 0
    while closed < len(lengths):
        reach = max(closed + 1, int(np.searchsorted(ends, ends[start] + size)))
        if reach > len(lengths):
            break
        spans.append((start, reach))
        start, closed = max(start, reach - max(overlap, 0)), reach
    if start < len(lengths):
        spans.append((start, len(lengths)))
    return spans


def chunk_words(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of words that close once they reach ``size`` characters, each started with the last words of the one before.

    One row is read at a time and its chunks leave in slices, so memory follows the longest text.
    """
    prepared = docs.select(F.col(key), F.filter(F.split(as_col(text), r"(?U)\s+"), lambda w: w != "").alias("words"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column(1)[i].as_py() or []
                spans = _word_spans(np.fromiter(map(len, words), np.int64, len(words)), size, overlap)
                for at in range(0, len(spans), 1000):
                    part = spans[at : at + 1000]
                    keys = pa.array([batch.column(0)[i].as_py()] * len(part), batch.column(0).type)
                    index = pa.array(range(at, at + len(part)), pa.int32())
                    yield pa.RecordBatch.from_arrays([keys, index, pa.array([" ".join(words[a:b]) for a, b in part], pa.string())], [key, "chunk_index", "chunk_text"])

    kind = docs.schema[key].dataType.simpleString()
    return prepared.mapInArrow(fold, f"{key} {kind}, chunk_index int, chunk_text string")


def chunk_fixed(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 800) -> DataFrame:
    """Chunks of ``n`` characters with ids made of key and index."""
    size = F.length(text)
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(n)), lambda i: F.substr(F.col(text), i + 1, F.lit(n)))
    out = docs.filter(size > 0).select(F.col(key), F.posexplode(pieces).alias("chunk_index", "chunk_text"))
    return out.withColumn("chunk_id", F.concat(F.col(key).cast("string"), F.lit("-"), F.col("chunk_index").cast("string")))
