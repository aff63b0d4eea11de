"""Groups of documents whose word shingles have a Jaccard similarity of at least num / den, exactly.

Two sets of sizes a <= b that are similar enough differ in at most H = (a + b)(den - num)/(den + num)
elements. The range of hashes is cut into m segments, and t of these also admit one difference. If
m + t > H, similar sets agree in one segment, or up to one element in one of the t segments. So the
index holds a key for each segment of a set, and for the t segments also keys with one element left
out. m and t are chosen by cost for each band of sizes. A set has keys for its own band and for the
bands of smaller partners.

Segments without elements would match too often, so they have no keys. A set that then has too few
segments for the argument above is marked, and only for marked sets do empty segments count.

Equal sets are one class before all this. Keys with few classes give all their pairs; keys with many
give pairs with one class, and what these do not connect is compared in blocks. Each pair is first
bounded from below by the difference of two small histograms, then verified on the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import erf, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, buffers, components, free_names, mix, settle, slices, text_or_empty, word_hashes

WORDS, NUM, DEN = 5, 4, 5
#: Sizes of a band reach up to this multiple.
BAND = 1.25
#: Keys with at most this many classes give all pairs.
FEW = 8
#: Buckets of the histograms that bound the difference of two sets: for candidate pairs, and for pairs within full keys.
HISTOGRAM, WIDE = 128, 512
#: Closest classes to which each one of a full key is compared at first.
NEAREST = 3
#: Text that a task turns to keys at once; classes that it remembers; classes of a block; bytes of keys for a task.
STEP_BYTES, SEEN, BLOCK, TASK_BYTES = 8 << 20, 500_000, 1024, 64 << 20
#: Parts into which the keys of empty segments are divided; the most parts of all keys.
SALTS, MAX_PARTS = 64, 1 << 16

_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_EMPTY, _SHORT, _MANY = np.uint64(1), np.uint64(2), np.uint64(4)
_HASH, _LOW = ~np.uint64(7), np.uint64((1 << 48) - 1)


# Shingle sets


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: runs of WORDS words, or all words where there are fewer."""
    out = []
    for a, b in slices(offsets):
        words, starts = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        runs = np.zeros(max(len(words) - WORDS + 1, 0), np.uint64)
        for k in range(WORDS):
            runs += words[k : k + len(runs)] * _PLACES[k]
        runs = mix(runs)
        for i in range(b - a):
            first, last = starts[i], starts[i + 1]
            if last - first >= WORDS:
                own = np.sort(runs[first : last - WORDS + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif last > first:
                part = words[first:last]
                out.append(mix((part * _PLACES[: len(part)]).sum(keepdims=True) + np.uint64(len(part))))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def class_of(own: np.ndarray) -> int:
    """A set's 64-bit name."""
    return int(mix(mix(own).sum(keepdims=True) + np.array([len(own)], np.uint64) * _PLACES[0]).view(np.int64)[0])


def histogram(own: np.ndarray, buckets: int) -> bytes:
    counts = np.bincount((mix(own) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def differing(sizes: np.ndarray) -> np.ndarray:
    """The most elements by which sets of a common size sum can differ."""
    return sizes * (DEN - NUM) // (DEN + NUM)


# Bands and their segments


@cache
def band_starts() -> np.ndarray:
    """First sizes of the bands. Sets below the first one are similar to equal sets only."""
    starts, at = [], NUM // (DEN - NUM)
    while at < 1 << 40:
        starts.append(at)
        at = max(at + 1, int(at * BAND))
    return np.array(starts)


@cache
def allocation(band: int) -> tuple[int, int]:
    """(m, t) of a band: the cheapest that holds for all its sizes.

    Cost is the expected number of keys, plus a weight for segments with one element, which match by
    chance, and a heavy one for the share of sets that would have to be marked.
    """
    starts = band_starts()
    low, high = int(starts[band]), int(starts[band + 1]) - 1
    need = int(differing(np.array([high + high * DEN // NUM]))[0]) + 1
    best = None
    for m in sorted({max(1, round(need * f / 20)) for f in range(10, 34)}):
        for t in sorted({max(0, need - m), max(0, need - m) + max(1, m // 16), m // 4, m // 2, m}):
            if t > m or m + t < need:
                continue
            cost = 0.0
            for n in (low, high):
                own_need = int(differing(np.array([n + n * DEN // NUM]))[0]) + 1
                load = n / m
                none, one = exp(-load), load * exp(-load)
                mean = (m - t) * (1 - none) + t * (2 * (1 - none) - one)
                spread = sqrt(max(m * none * (1 - none) + t * (none + one) * (1 - none - one), 1e-9))
                marked = 0.5 * (1 + erf((own_need - 0.5 - mean) / spread / sqrt(2)))
                cost += m * (1 - none) + t * load + 0.5 * m * one + 20 * n * marked
            if best is None or cost < best[0]:
                best = (cost, m, t)
    return best[1], best[2]


def _band_keys(own: np.ndarray, name: int, band: int, smaller: bool) -> tuple[list[np.ndarray], bool]:
    """Keys of a set in a band, and whether it is marked; ``smaller``: it may be the smaller one of a pair there."""
    m, t = allocation(band)
    segment = ((own >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    there = segment[first]
    size = np.diff(np.append(first, len(own)))
    element = mix(own ^ _PLACES[1])
    total = np.add.reduceat(element, first)
    base = mix(np.uint64(band << 32) + np.arange(m, dtype=np.uint64))
    keys = [mix(total + base[there]) & _HASH]
    short = there < t
    if short.any():
        inner = (segment < t) & np.repeat(size > 1, size)
        whole = np.repeat(total, size)
        keys.append(mix(whole[inner] - element[inner] + base[segment[inner]]) & _HASH)
    marked = False
    if smaller:
        score = len(there) + int((short & (size > 1)).sum())
        marked = score < int(differing(np.array([len(own) + len(own) * DEN // NUM]))[0]) + 1
    empty = np.ones(m, bool)
    empty[there[~(short & (size == 1))]] = False
    if empty.any():
        bare = base[empty] ^ _PLACES[2]
        if marked:
            salts = np.arange(SALTS, dtype=np.uint64)
            keys.append((mix(np.add.outer(bare, salts).ravel()) & _HASH) | _EMPTY | _SHORT)
        else:
            keys.append((mix(bare + np.uint64(name % SALTS)) & _HASH) | _EMPTY)
    return keys, marked


def keys_of(own: np.ndarray, name: int) -> np.ndarray:
    """All keys of a set: in its own band and in the bands of smaller partners."""
    n = len(own)
    starts = band_starts()
    if n < starts[0]:
        return np.zeros(0, np.uint64)
    top = int(np.searchsorted(starts, n, "right")) - 1
    low = max(int(np.searchsorted(starts, -(-n * NUM // DEN), "right")) - 1, 0)
    out = []
    for band in range(low, top + 1):
        out += _band_keys(own, name, band, band == top)[0]
    return np.concatenate(out)


# Tasks


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = buffers(batch.column(1))
        for a, b in slices(offsets, STEP_BYTES):
            sets = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([histogram(s, HISTOGRAM) for s in sets], pa.binary()), pa.array([histogram(s, WIDE) for s in sets], pa.binary()),
                ],
                ["doc_id", "text_hash", "n", "class", "histogram", "wide"],
            )


_STEP = "kind int, part int, keys binary, names binary, table binary"


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def _short_keys(keys: np.ndarray, part: np.ndarray | int) -> np.ndarray:
    """The low 48 bits, which travel, below the part's number. Keys that agree in these may still differ: then pairs are verified in vain."""
    return (keys & _LOW) | (np.asarray(part).astype(np.uint64) << np.uint64(48))


def _blob(kind: int, part: int, keys: np.ndarray, names: np.ndarray) -> tuple:
    table, at = np.unique(names, return_inverse=True)
    width = np.uint16 if len(table) <= 1 << 16 else np.uint32
    raw = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6] if kind == 0 else keys.astype("<u8")
    return kind, part, raw.tobytes(), at.astype(width).tobytes(), table.tobytes()


def _unblob(row: dict) -> tuple[np.ndarray, np.ndarray]:
    table = np.frombuffer(row["table"], np.int64)
    if row["kind"] == 0:
        raw = np.frombuffer(row["keys"], np.uint8).reshape(-1, 6)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :6] = raw
        keys = _short_keys(wide.view("<u8").ravel(), row["part"])
    else:
        keys = np.frombuffer(row["keys"], "<u8")
    width = np.uint16 if len(table) <= 1 << 16 else np.uint32
    return keys, table[np.frombuffer(row["names"], width)]


def _order(names: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """An order of classes that depends on two bits of the key, so that a large group has a few first ones."""
    return mix(names.view(np.uint64) ^ ((keys >> np.uint64(3)) & np.uint64(3)))


def _star(keys: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted keys, classes, whether the first of its key) of distinct (key, class)."""
    at = np.lexsort((_order(names, keys), keys))
    keys, names = keys[at], names[at]
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])]) if len(keys) else np.zeros(0, bool)
    keys, names = keys[fresh], names[fresh]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    return keys, names, first


def _index(parts: int):
    """Keys of each class that a task meets, in blobs by part of the key range.

    Keys that many classes of one step share are thinned at once: they give pairs with the first
    class and memberships, and only the first class travels on under the key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            raw, offsets = buffers(batch.column(0))
            for a, b in slices(offsets, STEP_BYTES):
                keys, names = [], []
                for own in shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    if len(own) < band_starts()[0]:
                        continue
                    name = class_of(own)
                    if name in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    keys.append(keys_of(own, name))
                    names.append(name)
                if not keys:
                    continue
                who = np.repeat(np.array(names, np.int64), [len(k) for k in keys])
                key = np.concatenate(keys)
                key = _short_keys(key, _part(key, parts))
                rows = []
                plain = (key & _EMPTY) == 0
                k, w, first = _star(key[plain], who[plain])
                size = np.diff(np.append(np.flatnonzero(first), len(k)))
                many = np.repeat(size > FEW, size)
                if many.any():
                    head = np.repeat(w[first], size)
                    other = many & ~first
                    # Passed on as they are, so any part will do: spread by content, for reruns to agree.
                    place = int(mix(w[many].view(np.uint64)).sum() % np.uint64(parts))
                    rows.append(_blob(1, place, head[other].view(np.uint64), w[other]))
                    rows.append(_blob(2, place, k[many], w[many]))
                    k, w, many = k[first | ~many], w[first | ~many], many[first | ~many]
                    k = k | np.where(many, _MANY, np.uint64(0))
                k, w = np.concatenate([k, key[~plain]]), np.concatenate([w, who[~plain]])
                part = (k >> np.uint64(48)).astype(np.int64)
                at = np.argsort(part, kind="stable")
                k, w, part = k[at], w[at], part[at]
                cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                for x, y in zip(cuts, np.append(cuts[1:], len(k)), strict=True):
                    rows.append(_blob(0, int(part[x]), k[x:y], w[x:y]))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "part", "keys", "names", "table"])

    return run


def _out(kind: int, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(x), 100_000):
        n = len(x[at : at + 100_000])
        columns = [pa.array(np.full(n, kind, np.int32)), pa.array(x[at : at + n].view(np.int64)), pa.array(y[at : at + n].view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "x", "y"])


def _distinct_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.minimum(x, y), np.maximum(x, y)
    x, y = x[x != y], y[x != y]
    at = np.lexsort((y, x))
    x, y = x[at], y[at]
    fresh = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, bool)
    return x[fresh], y[fresh]


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (kind 1: x, y) and members of keys with many classes (kind 2: key, class) of a part of the keys."""
    keys, names = [], []
    for batch in batches:
        for row in batch.to_pylist():
            k, w = _unblob(row)
            if row["kind"] == 0:
                keys.append(k)
                names.append(w)
            elif row["kind"] == 1:
                yield from _out(1, *_distinct_pairs(k.view(np.int64), w))
            else:
                yield from _out(2, k, w)
    if not keys:
        return
    key, who = np.concatenate(keys), np.concatenate(names)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    # Empty segments: marked classes with all others of the key.
    empty = (key & _EMPTY) == 1
    marked = empty & ((key & _SHORT) > 0)
    if marked.any():
        k, w = key[empty] & _HASH, who[empty]
        at = np.argsort(k, kind="stable")
        k, w = k[at], w[at]
        for mk, mw in zip(key[marked] & _HASH, who[marked], strict=True):
            others = w[np.searchsorted(k, mk, "left") : np.searchsorted(k, mk, "right")]
            pairs.append((np.full(len(others), mw), others))
            if sum(len(p[0]) for p in pairs[-1:]) > 1_000_000:
                yield from _out(1, *_distinct_pairs(*pairs.pop()))
    flag = (key & _MANY)[~empty]
    key, who = key[~empty] & _HASH, who[~empty]
    held = np.unique(key[flag > 0])
    # Keys of one class and without a mark have nothing to give.
    at = np.argsort(key, kind="stable")
    key, who = key[at], who[at]
    again = key[1:] == key[:-1]
    used = np.concatenate([[False], again]) | np.concatenate([again, [False]]) if len(key) else np.zeros(0, bool)
    key, who, first = _star(key[used], who[used])
    size = np.diff(np.append(np.flatnonzero(first), len(key)))
    many = np.repeat((size > FEW) | np.isin(key[first], held), size)
    for apart in range(1, FEW):
        same = (key[apart:] == key[:-apart]) & ~many[apart:]
        pairs.append((who[:-apart][same], who[apart:][same]))
    other = many & ~first
    pairs.append((np.repeat(who[first], size)[other], who[other]))
    yield from _out(2, key[many], who[many])
    yield from _out(1, *_distinct_pairs(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])))


def _matrix(column: pa.Array) -> np.ndarray:
    raw, _ = buffers(column)
    return raw.reshape(len(column), -1).astype(np.int16) if len(column) else np.zeros((0, HISTOGRAM), np.int16)


def _near_enough(apart: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Pairs of sets that neither their sizes nor the distance of their histograms rule out."""
    sizes = (np.minimum(nx, ny) * DEN >= np.maximum(nx, ny) * NUM) & (np.minimum(nx, ny) > 0)
    return sizes & (apart <= differing(nx + ny))


def _possible(hx: pa.Array, hy: pa.Array, nx: pa.Array, ny: pa.Array) -> pa.Array:
    return pa.array(_near_enough(np.abs(_matrix(hx) - _matrix(hy)).sum(axis=1), np.asarray(nx), np.asarray(ny)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * DEN >= NUM * (len(a) + len(b) - common)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (x, y) whose texts are similar enough."""
    for batch in batches:
        keep = []
        known: dict[int, np.ndarray] = {}
        for i in range(batch.num_rows):
            own = []
            for c in (0, 1):
                name = batch.column(c)[i].as_py()
                if name not in known:
                    if len(known) >= 64:
                        known.pop(next(iter(known)))
                    known[name] = shingle_sets(*buffers(batch.column(c + 2).slice(i, 1)))[0]
                own.append(known[name])
            keep.append(similar(*own))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(keep))


def _own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (class, text) whose text is that of the class; ids may repeat with other texts."""
    for batch in batches:
        raw, offsets = buffers(batch.column(1))
        sets = [s for a, b in slices(offsets) for s in shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
        same = [len(s) > 0 and class_of(s) == name for s, name in zip(sets, batch.column(0).to_pylist(), strict=True)]
        yield batch.filter(pa.array(same))


def _owed(first: bool, block: np.ndarray, names: np.ndarray, labels: np.ndarray, sizes: np.ndarray, bars: np.ndarray, nearest: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one block, or of two, that lie in different groups so far and that the histograms do not rule out.

    With ``nearest`` only that many for each row, the closest ones.
    """
    if first:
        # Rows of the largest group are compared with all others, not with each other.
        values, counts = np.unique(labels, return_counts=True)
        left, right = np.flatnonzero(labels != values[counts.argmax()]), np.arange(len(names))
    else:
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    found = []
    for at in range(0, len(left), 16):
        own = left[at : at + 16]
        apart = np.stack([np.abs(bars[i] - bars[right]).sum(axis=1) for i in own])
        hit = _near_enough(apart, sizes[own][:, None], sizes[right][None, :]) & (labels[own][:, None] != labels[right][None, :])
        if nearest is not None and hit.shape[1] > nearest:
            closest = np.argpartition(np.where(hit, apart, 1 << 20), nearest, axis=1)[:, :nearest]
            chosen = np.zeros_like(hit)
            np.put_along_axis(chosen, closest, True, axis=1)
            hit &= chosen
        x, y = np.nonzero(hit)
        found.append((names[own[x]], names[right[y]]))
    if not found:
        return names[:0], names[:0]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _compare(batches: Iterator[pa.RecordBatch], nearest: int | None) -> Iterator[pa.RecordBatch]:
    """Owed pairs of rows sorted by (key, p, q); rows of one such unit, two blocks at most, are held at once."""
    held: list[pa.RecordBatch] = []
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def units(rows: pa.RecordBatch) -> np.ndarray:
        unit = np.stack([np.asarray(rows.column(i)).astype(np.int64) for i in range(3)])
        return np.flatnonzero(np.concatenate([[True], (unit[:, 1:] != unit[:, :-1]).any(axis=0)]))

    def compare(rows: pa.RecordBatch, starts: np.ndarray) -> None:
        p, q, block, names, labels, sizes = (np.asarray(rows.column(i)) for i in range(1, 7))
        bars = _matrix(rows.column(7))
        for a, b in zip(starts, np.append(starts[1:], rows.num_rows), strict=True):
            pairs.append(_owed(p[a] == q[a], block[a:b], names[a:b], labels[a:b], sizes[a:b], bars[a:b], nearest))

    def flush() -> Iterator[pa.RecordBatch]:
        x, y = _distinct_pairs(np.concatenate([f[0] for f in pairs]), np.concatenate([f[1] for f in pairs]))
        pairs.clear()
        for at in range(0, len(x), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]), pa.array(y[at : at + 100_000])], ["x", "y"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        starts = units(rows)
        last = int(starts[-1])
        if last:
            compare(rows.slice(0, last), starts[:-1])
        held = [rows.slice(last)]
        if sum(len(f[0]) for f in pairs) > 1_000_000:
            yield from flush()
    if held:
        compare(held[0], np.array([0]))
    if pairs:
        yield from flush()


# The join


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs of classes that are similar, verified on the texts of one document of each class."""
    info = classes.select("class", "n", "histogram")
    for side in ("x", "y"):
        pairs = pairs.join(info.select(F.col("class").alias(side), F.col("n").alias(f"n{side}"), F.col("histogram").alias(f"h{side}")), side)
    pairs = settle(pairs.filter(F.arrow_udf(_possible, "boolean")("hx", "hy", "nx", "ny")).select("x", "y"), "possible")
    needed = pairs.select(F.col("x").alias("class")).unionByName(pairs.select(F.col("y").alias("class"))).distinct()
    needed = settle(needed.join(classes.select("class", "rep"), "class"), "needed")
    if needed.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        needed = F.broadcast(needed)
    texts = docs.join(needed, docs["doc_id"].eqNullSafe(F.col("rep"))).select("class", "text")
    texts = settle(texts.mapInArrow(_own_text, "class long, text string").dropDuplicates(["class"]), "texts")
    for side in ("x", "y"):
        pairs = pairs.join(texts.select(F.col("class").alias(side), F.col("text").alias(f"t{side}")), side)
    return settle(pairs.select("x", "y", "tx", "ty").mapInArrow(_verify, "x long, y long"), "similar")


def _rest(members: DataFrame, groups: DataFrame, classes: DataFrame, nearest: int | None) -> DataFrame:
    """Pairs that keys with many classes still owe: all between classes that no link connects so far.

    With ``nearest`` only those of each class and its closest ones.
    """
    labelled = members.join(groups.select(F.col("node").alias("class"), F.col("component").alias("label")), "class", "left")
    labelled = settle(labelled.select("key", "class", F.coalesce("label", "class").alias("label")), "members")
    open_ = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("sum"))
    # Keys with the same classes owe the same pairs.
    open_ = open_.filter("low < high").groupBy("size", "sum", "low", "high").agg(F.min("key").alias("key"))
    open_ = settle(open_.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "open")
    rows = labelled.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    rows = rows.join(classes.select("class", "n", "wide"), "class").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = rows.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "class", "label", "n", "wide")
    found = placed.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(lambda batches: _compare(batches, nearest), "x long, y long")
    return found.distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, n_shingles (size of its set), component_id (smallest id reachable by links),
    text_hash (with the id the key of a row) and group_id (a hash that names the group; null for empty sets).

    Words are runs without blank or U+0009 to U+000D, A to Z lowered; a set holds the distinct runs of
    five words, or the whole sequence where there are fewer. Rows link when their sets are similar
    enough; equal sets always do. Null texts and texts without words have an empty set and link with
    nothing. Rows that repeat, and rows that share an id, are rows like others. Null ids are never
    the smallest; a group of nulls only has a null component. Sets are named by 64-bit hashes. An
    empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    text = text_or_empty(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    described = settle(rows.mapInArrow(_describe, "doc_id long, text_hash long, n long, class long, histogram binary, wide binary"), "sets")
    known = described.filter("class is not null")
    classes = known.groupBy("class").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("histogram").alias("histogram"), F.min("wide").alias("wide"))
    classes = settle(classes, "classes")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, -(-(described.agg(F.sum("n")).first()[0] or 0) * 10 // TASK_BYTES))
    keyed = rows.select("text").mapInArrow(_index(min(tasks, MAX_PARTS)), _STEP).repartitionById(min(tasks, MAX_PARTS), F.col("part"))
    found = settle(keyed.mapInArrow(_match, "kind int, x long, y long"), "candidates")
    pairs = found.filter("kind = 1").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    links = _links(pairs, classes, rows)
    groups = components(links)
    members = found.filter("kind = 2").select(F.col("x").alias("key"), F.col("y").alias("class")).distinct()
    # The closest pairs connect most of a group of near copies; then all pairs that are still between groups are due.
    for nearest in (NEAREST, None):
        owed = settle(_rest(members, groups, classes, nearest), "owed")
        if not owed.isEmpty():
            links = links.unionByName(_links(owed, classes, rows))
            groups = components(links)
    named = classes.select("class", "rep").join(groups.withColumnRenamed("node", "class"), "class", "left")
    named = settle(named.select("class", "rep", F.coalesce("component", "class").alias("component")), "grouped")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = settle(named.join(least, "component").select("class", "component", "component_id"), "named")
    joined = described.select("doc_id", "text_hash", "n", "class").join(named, "class", "left")
    own = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), "text_hash", F.col("component").alias("group_id"))


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of ``similar_groups``, and all rows that link with nothing; all columns stay.

    The row with the smallest id stays (a null id only where the group has no other), of several with that id the
    one with the smallest hash of its text, and of rows equal in both the one that is least in its columns.
    Ids that different texts share are no reason to drop a row.
    """
    key, hashed, one = free_names(docs, "group_id_", "group_text", "group_one")
    pair = F.struct(F.col(id_col).isNull(), id_col, "text_hash")
    least = groups.filter("group_id IS NOT NULL").groupBy("group_id").agg(F.min(pair).alias("p")).select("p.*")
    alone = groups.filter("group_id IS NULL").select(id_col, "text_hash").distinct()
    wanted = least.select(F.col(id_col).alias(key), F.col("text_hash").alias(hashed), F.lit(True).alias(one))
    wanted = wanted.unionByName(alone.select(F.col(id_col).alias(key), F.col("text_hash").alias(hashed), F.lit(False).alias(one)))
    marked = docs.join(wanted, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(text_or_empty(docs, text_col)) == F.col(hashed)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = marked.filter(F.col(one)).groupBy(key, hashed).agg(F.min(F.struct(*columns)).alias(one)).select(f"{one}.*")
    return kept.unionByName(marked.filter(~F.col(one)).select(*columns))
