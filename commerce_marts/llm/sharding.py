"""Sharding by a histogram sort: splitters are found by counting, then rows move once.

A row's key is a 63-bit number: hash bits of its text, then hash bits of its id, so that equal texts
lie side by side and a group that is larger than a shard can still be cut. Exact bytes below
candidate boundaries are counted over all partitions; only the ranges that hold a wanted splitter are
probed again, until each splitter is near enough or its range holds a single key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import constant, free_names, settle, text_or_empty

KEY_BITS = 63
#: Bits below those of the text.
GROUP_SHIFT = 31
#: First round: ranges over all keys; later rounds: parts of each range that holds a splitter.
FIRST_BITS, ROUND_BITS = 12, 8
#: Rows of a cell, the range that one task numbers; and the most cells.
CELL_ROWS, MAX_CELLS = 100_000, 4096


def sort_key(text: Column, doc_id: Column) -> Column:
    high = F.shiftrightunsigned(F.xxhash64(text), 32)
    low = F.shiftrightunsigned(F.xxhash64(doc_id, text), 33)
    return F.shiftleft(high.bitwiseAND(0xFFFFFFFF), GROUP_SHIFT).bitwiseOR(low)


def find_splitters(rows: DataFrame, parts: int, tolerance: float = 0.002) -> list[int]:
    """``parts`` - 1 keys between which the sum of ``size`` is near equal; rows has key and size.

    Row ``key`` belongs to part p when p splitters are at or below it. A splitter is settled when
    the bytes below it miss its goal by at most ``tolerance`` of a part, or when one key is left.
    The driver sees sums of at most 2^FIRST_BITS + parts * 2^ROUND_BITS ranges, whatever the input.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    goals = {p: total * p / parts for p in range(1, parts)}
    near = tolerance * total / parts
    found: dict[int, int] = {}
    shift, step = KEY_BITS - FIRST_BITS, FIRST_BITS
    # Splitter -> (range, bytes below that range).
    within: dict[int, tuple[int, int]] = dict.fromkeys(goals, (0, 0))
    while within:
        ranges = sorted({r for r, _ in within.values()})
        part = rows if step == FIRST_BITS else rows.filter(F.shiftright("key", shift + step).isin(ranges))
        counts = part.groupBy(F.shiftright("key", shift).alias("r")).agg(F.sum("size").alias("size"), F.min("key").alias("least"), F.max("key").alias("last")).collect()
        held: dict[int, list] = {}
        for row in sorted(counts, key=lambda x: x["r"]):
            held.setdefault(row["r"] >> step, []).append(row)
        following = {}
        for p, (parent, below) in within.items():
            inner = held.get(parent, [])
            if not inner:
                found[p] = (parent + 1) << (shift + step)
                continue
            for row in inner:
                if below + row["size"] >= goals[p] or row is inner[-1]:
                    break
                below += row["size"]
            low, high = goals[p] - below, below + row["size"] - goals[p]
            if min(low, high) <= near or row["least"] == row["last"] or shift == 0:
                found[p] = row["least"] if low <= high else row["last"] + 1
            else:
                following[p] = (row["r"], below)
        within = following
        step = min(ROUND_BITS, shift)
        shift -= step
    keys, at = [], 0
    for p in sorted(goals):
        at = max(at, found[p])
        keys.append(at)
    return keys


def between_groups(rows: DataFrame, keys: list[int], cells: int, shards: int) -> list[int]:
    """Splitters of cells, those between shards moved to the nearer border of the group of equal texts they cut.

    A group that weighs more than a shard is cut all the same. Splitters inside shards stay between their shard's.
    """
    outer = {i: keys[i] for i in range(cells - 1, len(keys), cells)}
    group = F.shiftright("key", GROUP_SHIFT)
    # A splitter behind all keys has no group.
    cut = sorted({k for k in outer.values() if k < 1 << KEY_BITS})
    below = [F.sum(F.when(F.col("key") < k, F.col("size")).otherwise(0)).alias(f"b{n}") for n, k in enumerate(cut)]
    held = rows.filter(group.isin([k >> GROUP_SHIFT for k in cut])).groupBy(group.alias("g")).agg(F.sum("size").alias("size"), *below).collect()
    whole = {r["g"]: r for r in held}
    total = rows.agg(F.sum("size")).first()[0] or 0
    for i, k in outer.items():
        row = whole.get(k >> GROUP_SHIFT)
        if row and row["size"] * shards <= total:
            before = row[f"b{cut.index(k)}"]
            outer[i] = (row["g"] + (before * 2 > row["size"])) << GROUP_SHIFT
    out, most = list(keys), (1 << KEY_BITS) - 1
    for i in range(len(keys)):
        start = i // cells * cells
        low, high = outer.get(start - 1, 0), outer.get(start + cells - 1, most)
        out[i] = min(outer[i] if i in outer else min(max(keys[i], low), high), most)
    return out


def part_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are at or below ``key``: a lookup by leading bits, then a short comparison."""
    if not splitters:
        return F.lit(0)
    shift = KEY_BITS - FIRST_BITS
    first, inner = [], [[] for _ in range(1 << FIRST_BITS)]
    for s in splitters:
        inner[min(s >> shift, (1 << FIRST_BITS) - 1)].append(s)
    before = 0
    for group in inner:
        first.append(before)
        before += len(group)
    at = (F.shiftright(key, shift) + 1).cast("int")
    near = F.element_at(constant(inner, "array<array<bigint>>"), at)
    return F.element_at(constant(first, "array<int>"), at) + F.size(F.filter(near, lambda s: s <= key))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS, prefix: str = "") -> DataFrame:
    """Add shard (int) and slot (long, gapless from 0 within a shard) to all rows, plus size in bytes.

    A row weighs the UTF-8 bytes of its text plus 1 (null: 1), and shards weigh near the same. Equal texts
    share a shard unless they weigh more than one. Slots
    follow the sort key; equal rows share a key and take neighbouring slots. Rows with null ids are
    placed like others. An empty table gives no rows. ``prefix`` precedes the three new names, and
    columns of these names are replaced.
    """
    text = text_or_empty(docs, text_col)
    size, key = F.octet_length(text).cast("long") + 1, sort_key(text, F.col(id_col))
    rows = settle(docs.select(key.alias("key"), size.alias("size")), "keys")
    n = rows.count()
    cells = max(1, min(MAX_CELLS // shards, -(-n // (cell_rows * shards)), n)) if n else 1
    cells = max(cells, 8)
    splitters = between_groups(rows, find_splitters(rows, shards * cells), cells, shards)
    cell = part_of(F.col("key"), splitters)
    counts = rows.select(cell.alias("cell")).groupBy("cell").count().collect()
    starts, held = [], {r["cell"]: r["count"] for r in counts}
    for p in range(shards * cells):
        starts.append(0 if p % cells == 0 else starts[-1] + held.get(p - 1, 0))
    at, of = free_names(docs, "shard_key", "shard_cell")
    sized = docs.withColumn(f"{prefix}size", size).withColumn(at, key).withColumn(of, part_of(F.col(at), splitters))
    order = Window.partitionBy(of).orderBy(at, F.col(id_col))
    slot = F.row_number().over(order).cast("long") - 1 + F.element_at(constant(starts, "array<bigint>"), F.col(of) + 1)
    placed = sized.withColumn(f"{prefix}slot", slot.cast("long")).withColumn(f"{prefix}shard", F.floor(F.col(of) / cells).cast("int"))
    return placed.drop(at, of)
