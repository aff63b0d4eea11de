"""Helpers of the training-data operators: stored steps, text buffers, hashes, connected components."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

#: White space between words: blank and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bytes of text that one numpy step works on.
SLICE_BYTES = 1 << 20
#: A frame of at most this many narrow rows may be sent to every executor; above it a shuffled join is used.
SMALL_ROWS = 200_000


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later jobs reuse the files, also after lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Mark a stored frame for broadcast if a count shows at most ``limit`` rows; else leave the join to the optimizer."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_or_empty(docs: DataFrame, col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def constant(values: list, kind: str) -> Column:
    """A list as one literal of type ``kind``; the optimizer folds it before the job runs."""
    return F.from_json(F.lit(json.dumps(values)), kind)


# Byte buffers of text columns


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_null()), 0, np.diff(ends))
        if lengths.sum() != ends[-1] - ends[0]:  # bytes below nulls
            column = column.fill_null("" if "string" in str(column.type) else b"")
            return buffers(column)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, rows)
        at = min(to, rows)


# 64-bit hashes; products wrap on purpose

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_STEP_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * _ODD
    x = x ^ (x >> np.uint64(29))
    x = x * _STEP
    return x ^ (x >> np.uint64(32))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: One random number for each byte; capitals A to Z have those of their small letters.
FOLDED = _BYTES[_LOWER]
PLAIN = _BYTES
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


class _Powers:
    """Powers of the hash step and of its inverse, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * SLICE_BYTES)
            for name, step in (("up", _STEP), ("down", _STEP_INVERSE)):
                steps = np.full(size, step, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_powers = _Powers()


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of ``values`` (unsigned 64-bit), the same wherever the span lies."""
    up, down = _powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _words_of(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(table[raw], starts, ends), np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """(a hash for each word, offsets of the rows' words). Long rows are cut at white space, so memory stays small."""
    if offsets[-1] - offsets[0] <= 2 * SLICE_BYTES or len(offsets) > 2:
        return _words_of(raw, offsets, table)
    parts, at = [], 0
    while at < len(raw):
        to = min(len(raw), at + SLICE_BYTES)
        while to < len(raw) and not SPACE[raw[to]]:
            more = np.flatnonzero(SPACE[raw[to : to + SLICE_BYTES]])
            to = to + int(more[0]) if len(more) else min(len(raw), to + SLICE_BYTES)
        parts.append(_words_of(raw[at:to], np.array([0, to - at]), table)[0])
        at = to
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return words, np.array([0, len(words)])


# Connected components


def _forest(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Replace a task's links by links of each node to the smallest node it reaches with them."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def links() -> pa.RecordBatch:
        pairs = [(x, top) for x in parent if (top := root(x)) != x]
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > most:
            yield links()
            parent.clear()
    if parent:
        yield links()


def _star_round(links: DataFrame) -> DataFrame:
    """One round of large and small stars: links move to the smallest neighbour and keep all components."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.filter("a <> b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small_star = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small_star.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (two long columns); component is the smallest node reachable.

    Links with a null end or between a node and itself are left out. Each task first thins its links
    to a forest; star rounds then run on what is left until nothing changes, each written to the
    shared folder. Links never meet in one task or on the driver.
    """
    first, second = links.columns
    links = links.select(F.col(first).alias("a"), F.col(second).alias("b")).filter("a <> b")
    links = settle(links.mapInArrow(_forest, "a long, b long").distinct(), "links")

    def state(frame: DataFrame):
        return frame.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()

    before = state(links)
    while before[0]:
        links = settle(_star_round(links), "links")
        after = state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

