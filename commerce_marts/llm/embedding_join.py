"""Exact near-duplicate vectors by a metric range join.

For unit vectors a cosine of at least c is an angle of at most t = arccos(c) and a distance of at
most r = sqrt(2 - 2c). Equal vectors are first merged to one. Pivots, a bounded sample of the
vectors, divide the rest into cells by the nearest pivot; a cell is dealt to blocks of bounded size,
and a block is one row that holds its vectors. Every vector is stored in one block only: blocks are
paired by reading them again, so neither disk nor shuffle grows with the number of pairs. Two blocks
are compared only if a vector of one may lie within reach of one of the other: by the triangle
inequality for angles, seen from both pivots, and by the distances to the plane between the pivots.
The same bounds then leave out single vectors of the two blocks. A pair's cosine is at most that in a
few leading directions plus the product of what is left of both vectors; pairs above the limit by
this are computed in full, and in double precision where single precision does not decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, components, settle

#: Vectors that one pivot stands for, the most pivots, and the vectors of a block.
CELL_ROWS, MAX_PIVOTS, BLOCK_ROWS = 8192, 1024, 16384
#: Bytes of a block in double precision, and the most parts of the blocks; each part meets each other in a task.
BLOCK_BYTES, MAX_PARTS = 1 << 23, 128
#: Vectors that the leading directions are taken from, and rows and columns that are compared at once, a multiple of eight.
SAMPLE_ROWS, STEP, WIDTH = 2048, 128, 4096
#: Links that a task gathers before it thins them.
LINKS = 1 << 20
#: Slack of bounds on angles and distances against rounding.
EPS = 1e-5


def _unit(rows: np.ndarray) -> np.ndarray:
    # Scaling by a power of two keeps the squares finite and all bits.
    rows = np.ldexp(rows.astype(np.float64), -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of a binary column, in single or double precision each, as one matrix."""
    raw, ends = buffers(column)
    size = np.diff(ends)
    out = np.empty((len(size), dims))
    for kind in (np.float32, np.float64):
        wide = dims * np.dtype(kind).itemsize
        rows = np.flatnonzero(size == wide)
        if len(rows):
            out[rows] = np.frombuffer(raw[ends[rows][:, None] + np.arange(wide)].tobytes(), kind).reshape(-1, dims)
    return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, raw bytes of the vector or null if it links with nothing, dimensions).

    The bytes are in single precision where that is exact, else in double precision.
    """
    for batch in batches:
        column = batch.column(1)
        values = column.values.to_numpy(zero_copy_only=False)
        ends = column.offsets.to_numpy().astype(np.int64)
        size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
        raw: list[bytes | None] = [None] * len(column)
        dims = np.zeros(len(column), np.int32)
        for n in np.unique(size[size > 0]):
            some = np.flatnonzero(size == n)
            for rows in np.array_split(some, -(-len(some) * int(n) // (1 << 20))):
                x = values[ends[rows][:, None] + np.arange(n)].astype(np.float64) + 0.0
                top = np.abs(x).max(axis=1)
                with np.errstate(over="ignore", invalid="ignore"):
                    single = x.astype(np.float32)
                narrow = (single == x).all(axis=1)
                for i in np.flatnonzero(np.isfinite(top) & (top > 0)):
                    raw[rows[i]] = (single if narrow[i] else x)[i].tobytes()
                    dims[rows[i]] = n
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "v", "dims"])


def _grid(x: np.ndarray) -> np.ndarray:
    """Numbers of at most 1 as whole ones, whose products add up without rounding: equal vectors get the same cell in any batch."""
    return np.rint(x * 2.0 ** min(20, (52 - int(np.ceil(np.log2(x.shape[1])))) // 2))


def _place(pivots: np.ndarray, first: np.ndarray | None = None, blocks: np.ndarray | None = None):
    """Home cells, or with the cells' blocks each vector in its block; equal ones of a batch are merged."""
    centres, dims = _grid(pivots).T, pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            homes = []
            for at in range(0, batch.num_rows, 2048):
                x = _matrix(batch.column(1).slice(at, 2048), dims)
                homes.append((_grid(x / np.abs(x).max(axis=1, keepdims=True)) @ centres).argmax(axis=1))
            home = np.concatenate(homes) if homes else np.zeros(0, np.int64)
            if first is None:
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), batch.column(2)], ["cell", "h"])
                continue
            deal = batch.column(2).to_numpy().view(np.uint64) % blocks[home].astype(np.uint64)
            table = pa.table({"block": first[home] + deal.astype(np.int64), "rep": batch.column(0), "v": batch.column(1), "n": np.ones(len(home), np.int64)})
            table = table.group_by(["block", "v"], use_threads=False).aggregate([("rep", "min"), ("n", "sum")]).select(["block", "v", "rep_min", "n_sum"])
            yield from table.rename_columns(["block", "v", "rep", "n"]).to_batches()

    return run


def _pack(pivots: np.ndarray, first: np.ndarray):
    """One row for a block: its vectors, and how near they come to the pivots and to the planes between them."""
    dims = pivots.shape[1]

    def run(table: pa.Table) -> pa.Table:
        block, v = table["block"][0].as_py(), table["v"].combine_chunks()
        cell = int(np.searchsorted(first, block, side="right")) - 1
        x = _matrix(v, dims)
        narrow = (np.diff(buffers(v)[1]) == 4 * dims).all()
        cosine = _unit(x) @ pivots.T
        angle = np.arccos(np.clip(cosine, -1, 1))
        apart = np.sqrt(((pivots - pivots[cell]) ** 2).sum(axis=1))
        gap = np.where(apart > 1e-3, (cosine[:, [cell]] - cosine).min(axis=0) / np.maximum(apart, 1e-3), -9.0)
        row = {
            "block": pa.array([block], pa.int64()), "cell": pa.array([cell], pa.int32()), "far": pa.array([angle[:, cell].max()], pa.float64()),
            "near": pa.array([angle.min(axis=0)], pa.list_(pa.float64())), "gap": pa.array([gap], pa.list_(pa.float64())),
            "v": pa.array([x.astype(np.float32 if narrow else np.float64).tobytes()], pa.binary()),
            "n": pa.array([table["n"].to_numpy()], pa.list_(pa.int64())), "rep": pa.array([table["rep"].to_pylist()], pa.list_(pa.int64())),
            "key": pa.array([[hashlib.sha256(b).digest() for b in v.to_pylist()]], pa.list_(pa.binary())),
        }
        return pa.table(row)

    return run


def _directions(sample: np.ndarray, least: float) -> np.ndarray | None:
    """Leading directions that make the comparisons cheapest, by a sample of unit vectors; None if all dimensions do."""
    dims, half = sample.shape[1], len(sample) // 2
    if dims < 24 or half < 24:
        return None
    lead, test = np.linalg.svd(sample[:half], full_matrices=False)[2], sample[half:]
    links = test @ test.T >= least
    best, found = float(dims), None
    for k in (15, 31, 63, 127, 255):
        if k > min(len(lead), 3 * dims // 4):
            break
        part = test @ lead[:k].T
        rest = np.sqrt(np.maximum(1 - (part * part).sum(axis=1), 0))
        false = ((part @ part.T + rest[:, None] * rest >= least) & ~links).mean()
        cost = k + 1 + dims * min(1.0, STEP * false) * min(1.0, WIDTH * false)
        if cost < best:
            best, found = cost, np.ascontiguousarray(lead[:k].T).astype(np.float32)
    return found


class _Block:
    """A block's vectors: as stored, as unit vectors in single precision, and in the leading directions with the rest's length."""

    def __init__(self, v: np.ndarray, rows: int, dims: int, lead: np.ndarray | None, slack: float) -> None:
        self.raw = v.view(np.float32 if len(v) == 4 * rows * dims else np.float64).reshape(rows, dims)
        unit = (self.raw / np.abs(self.raw).max(axis=1, keepdims=True)).astype(np.float32)
        self.unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        self.some, self.short = np.arange(rows), self.unit
        if lead is not None:
            part = self.unit @ lead
            rest = np.sqrt(np.maximum(1 - (part * part).sum(axis=1, keepdims=True), 0) + 8 * slack)
            self.short = np.concatenate([part, rest], axis=1)

    def bytes(self) -> int:
        return self.raw.nbytes + self.unit.nbytes + self.short.nbytes

    def take(self, rows: np.ndarray) -> _Block:
        out = object.__new__(_Block)
        out.raw, out.unit, out.short, out.some = self.raw[rows], self.unit[rows], self.short[rows], self.some[rows]
        return out


def _close(x: _Block, y: _Block, row: np.ndarray, col: np.ndarray, least: float) -> np.ndarray:
    """Whether pairs link, in double precision."""
    out, step = np.zeros(len(row), bool), max(1, BLOCK_BYTES // (8 * x.raw.shape[1]))
    for at in range(0, len(row), step):
        a, b = _unit(x.raw[row[at : at + step]]), _unit(y.raw[col[at : at + step]])
        out[at : at + step] = (a * b).sum(axis=1) >= least
    return out


def _links(x: _Block, y: _Block, same: bool, least: float, slack: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked pairs of two blocks; of a block with itself each pair once."""
    other = np.zeros((y.short.shape[1], -(-len(y.short) // 8) * 8), np.float32)
    other[:, : len(y.short)] = y.short.T
    products, above = np.empty(STEP * WIDTH, np.float32), np.empty(STEP * WIDTH, bool)
    left: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def checked() -> tuple[np.ndarray, np.ndarray]:
        row, col = (np.concatenate([p[i] for p in left]) for i in (0, 1))
        keep = (col < len(y.short)) & ((row < col) | (not same))
        row, col = row[keep], col[keep]
        sure = _close(x, y, row, col, least)
        return x.some[row[sure]], y.some[col[sure]]

    for at in range(0, len(x.short), STEP):
        part = x.short[at : at + STEP]
        for skip in range(at if same else 0, len(y.short), WIDTH):
            shape = len(part), min(WIDTH, other.shape[1] - skip)
            size = shape[0] * shape[1]
            hit = above[:size].reshape(shape)
            np.greater_equal(np.matmul(part, other[:, skip : skip + WIDTH], out=products[:size].reshape(shape)), least - 8 * slack, out=hit)
            # Eight flags are read as one word, as nearly all are unset.
            words = above[:size].view(np.uint64)
            found = np.flatnonzero(words)
            if not len(found):
                continue
            if len(found) <= WIDTH // 8:
                word, bit = np.nonzero(words[found].view(bool).reshape(-1, 8))
                row, col = np.divmod(8 * found[word] + bit, shape[1])
                left.append((row + at, col + skip))
                held += len(row)
                if held > LINKS // 4:
                    yield checked()
                    left.clear()
                    held = 0
                continue
            hit = hit[:, : len(y.short) - skip]
            rows, cols = np.flatnonzero(hit.any(axis=1)) + at, np.flatnonzero(hit.any(axis=0)) + skip
            cosine = x.unit[rows] @ y.unit[cols].T
            sure = cosine >= least + slack
            row, col = np.nonzero((cosine >= least - slack) & ~sure)
            sure[row, col] = _close(x, y, rows[row], cols[col], least)
            row, col = np.nonzero(sure)
            row, col = rows[row], cols[col]
            if same:
                row, col = row[row < col], col[row < col]
            yield x.some[row], y.some[col]
    if left:
        yield checked()


def _join(least: float, pivots: np.ndarray, lead: np.ndarray | None):
    """Link counts of the vectors of paired blocks, and a forest of their links. A vector's number is its block's, times 2^32, plus its position."""
    dims, angle, radius = pivots.shape[1], float(np.arccos(np.clip(least, -1, 1))), float(np.sqrt(max(2 - 2 * least, 0)))
    centres, slack = pivots.astype(np.float32), (dims + 8) * 2.0**-22

    def within(x: _Block, cell: int, other: int, far: float, gap: float) -> _Block:
        """What may lie within reach of a block of another cell."""
        if cell == other:
            return x
        cosine = x.unit @ centres[[cell, other]].T
        apart = float(np.sqrt(((pivots[cell] - pivots[other]) ** 2).sum()))
        keep = (cosine[:, 1] >= np.cos(min(np.pi, far + angle + EPS)) - 2 * slack) & (cosine[:, 0] - cosine[:, 1] <= apart * (radius + EPS - gap) + 4 * slack)
        return x.take(np.flatnonzero(keep)) if keep.mean() < 0.9 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        known: dict[int, _Block] = {}
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        held = size = 0

        def side(batch: pa.RecordBatch, i: int, name: str) -> tuple[int, np.ndarray, _Block]:
            nonlocal size
            block, n = batch[f"{name}_block"][i].as_py(), batch[f"{name}_n"][i].values.to_numpy()
            # The blocks used last stay known; a copy, so that they do not keep the batch.
            ready = known.pop(block, None)
            if ready is None:
                ready = _Block(np.frombuffer(batch[f"{name}_v"][i].as_buffer(), np.uint8).copy(), len(n), dims, lead, slack)
                size += ready.bytes()
                while known and size > 8 * BLOCK_BYTES:
                    size -= known.pop(next(iter(known))).bytes()
            known[block] = ready
            counts.setdefault(block, np.zeros(len(n), np.int64))
            return block, n, ready

        def thin() -> None:
            nonlocal held
            pairs[:] = [_thin(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))]
            held = 0

        for batch in batches:
            for i in range(batch.num_rows):
                a, n, x = side(batch, i, "a")
                b, m, y = side(batch, i, "b")
                cells = batch["a_cell"][i].as_py(), batch["b_cell"][i].as_py()
                if a != b:
                    x = within(x, *cells, batch["b_far"][i].as_py(), batch["b_gap"][i].as_py())
                    y = within(y, *cells[::-1], batch["a_far"][i].as_py(), batch["a_gap"][i].as_py())
                for row, col in _links(x, y, a == b, least, slack):
                    counts[a] += np.bincount(row, m[col], len(n)).astype(np.int64)
                    counts[b] += np.bincount(col, n[row], len(m)).astype(np.int64)
                    pairs.append((row + (a << 32), col + (b << 32)))
                    held += len(row)
                    if held > LINKS:
                        thin()
        some = [(np.flatnonzero(c) + (block << 32), c[c > 0]) for block, c in counts.items() if c.any()]
        for node, links in some:
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node), pa.array(links)], ["a", "b", "links"])
        if pairs:
            thin()
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0][0]), pa.array(pairs[0][1]), pa.array(np.zeros(len(pairs[0][0]), np.int64))], ["a", "b", "links"])

    return run


def _thin(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the smallest node it reaches with the given links."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        now = label.copy()
        np.minimum.at(now, label[u], low)
        np.minimum.at(now, label[v], low)
        now = now[now]
        if (now == label).all():
            break
        label = now
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def near_vectors(
    vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding",
    cell_rows: int = CELL_ROWS, max_pivots: int = MAX_PIVOTS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row for each row: id, n_links, component_id, kept.

    n_links counts the other rows whose vector has a cosine of at least ``least`` (above 0) in double
    precision; component_id is the smallest id reachable by links; kept says that it is the own one.
    Vectors that are null, empty, zero or hold null or non-finite components have no link; vectors of
    different lengths are never linked. Equal rows link with each other. Rows that share an id are
    taken as one vector with as many copies if their vectors agree, else as separate ones of one id.
    Other columns are not read; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    rows = settle(rows.mapInArrow(_vectors, "vec_id long, v binary, dims int"), "vectors")
    alone = rows.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = [alone]
    for dims in sorted(r[0] for r in rows.filter("v is not null").select("dims").distinct().collect()):
        own = rows.filter((F.col("dims") == dims) & F.col("v").isNotNull()).select("vec_id", "v", F.xxhash64("v").alias("h"))
        found.append(_near(own, dims, float(least), cell_rows, max_pivots, block_rows))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _sample(own: DataFrame, dims: int, cell_rows: int, max_pivots: int) -> tuple[np.ndarray, int]:
    """Unit vectors of the smallest hashes, a bounded number, and how many of them are pivots."""
    count = own.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    pivots = max(1, min(max_pivots, -(-count // cell_rows)))
    rows = max(pivots, min(SAMPLE_ROWS, 2 * BLOCK_BYTES // (8 * dims)))
    low = own.filter(F.col("h") <= int(min(2**63 - 1, -(2**63) + 2**64 * min(1.0, 4 * rows / max(count, 1)))))
    pick = lambda frame: frame.select("h", "v").dropDuplicates(["h"]).orderBy("h").limit(rows).select("v").toArrow()["v"].combine_chunks()
    found = pick(low)
    return _unit(_matrix(found if len(found) else pick(own), dims)), pivots


def _near(own: DataFrame, dims: int, least: float, cell_rows: int, max_pivots: int, block_rows: int) -> DataFrame:
    sample, pivots = _sample(own, dims, cell_rows, max_pivots)
    centres, lead = sample[:pivots], _directions(sample, least)
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * dims)))
    homes = own.mapInArrow(_place(centres), "cell int, h long").groupBy("cell").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    sizes = {r["cell"]: r["n"] for r in homes.collect()}
    blocks = np.array([-(-sizes.get(c, 0) // block_rows) for c in range(len(centres))], np.int64)
    first = np.cumsum(blocks) - blocks
    # One exchange: a vector goes to its block, where its copies meet and the block becomes one row.
    placed = own.mapInArrow(_place(centres, first, blocks), "block long, v binary, rep long, n long").repartition("block")
    merged = placed.groupBy("block", "v").agg(F.min("rep").alias("rep"), F.sum("n").alias("n"))
    kind = "block long, cell int, far double, near array<double>, gap array<double>, v binary, n array<long>, rep array<long>, key array<binary>"
    stored = settle(merged.groupBy("block").applyInArrow(_pack(centres, first), kind), "blocks")
    pairs = _pairs(stored, int(blocks.sum()), least)
    found = settle(pairs.mapInArrow(_join(least, centres, lead), "a long, b long, links long"), "found")
    links = found.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = components(found.filter("a <> b").select("a", "b"))
    nodes = stored.select("block", F.posexplode(F.arrays_zip("key", "rep", "n")).alias("at", "of"))
    nodes = nodes.select((F.shiftleft("block", 32) + F.col("at")).alias("node"), "of.key", "of.rep", "of.n")
    # Vectors with neither copies nor links are left out here and named by their own id.
    table = nodes.join(links, "node", "left").filter("n > 1 or links is not null").join(named, "node", "left")
    table = settle(table.select("key", "rep", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")), "linked")
    # A component's name is the smallest id of all its rows.
    smallest = settle(table.groupBy("component").agg(F.min("rep").alias("component_id")), "smallest")
    table = settle(table.join(smallest, "component").select("key", (F.col("n") - 1 + F.col("links")).alias("n_links"), "component_id"), "named")
    members = own.select("vec_id", F.unhex(F.sha2("v", 256)).alias("key")).join(table, "key", "left")
    return members.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def _pairs(stored: DataFrame, blocks: int, least: float) -> DataFrame:
    """Each two blocks that may hold a link, once: parts of the stored blocks are read anew for each other, not shuffled."""
    angle, radius = float(np.arccos(np.clip(least, -1, 1))), float(np.sqrt(max(2 - 2 * least, 0)))
    stored = stored.drop("rep", "key").coalesce(MAX_PARTS)
    a, b = (stored.select([F.col(c).alias(f"{side}_{c}") for c in stored.columns]) for side in "ab")
    # A block meets the half of the others that follows it in a ring, so all parts have the same work.
    step = F.pmod(F.col("b_block") - F.col("a_block"), F.lit(blocks)) * 2
    seen = lambda of, by: F.element_at(of, F.col(by) + 1)
    gaps = seen("a_gap", "b_cell"), seen("b_gap", "a_cell")
    meet = (step < blocks) | ((step == blocks) & (F.col("a_block") < F.col("b_block")))
    meet &= (seen("a_near", "b_cell") <= F.col("b_far") + angle + EPS) & (seen("b_near", "a_cell") <= F.col("a_far") + angle + EPS)
    meet &= gaps[0] + gaps[1] <= radius + EPS
    names = [f"{side}_{c}" for side in "ab" for c in ("block", "cell", "far", "v", "n")]
    return a.join(b, meet).select(*names, gaps[0].alias("a_gap"), gaps[1].alias("b_gap"))
