"""Exact nearest vectors by normalised inner product, with bounds that leave out what cannot win.

Vectors are gathered in cells around pivots and cut into blocks of bounded size; a block knows its pivot and the
widest angle to it. By the triangle inequality of angles no vector of a block is more similar to a query than the
cosine of (angle to the pivot less that width). Each query first meets the blocks that look best, which gives it
a k-th similarity to beat, and then only the blocks whose bound reaches that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import top_n

#: Vectors and queries of a block in the mean; a task holds one block of each at a time.
BLOCK_ROWS, QUERY_ROWS = 4_096, 4_096
#: Pivots at most: they are sent to the tasks. Larger cells have several blocks.
MAX_PIVOTS = 1_024
#: Similarities are rounded to this many decimals, and ties are broken by id.
DECIMALS = 6
FOUND = "query_id bigint, vector_id bigint, similarity double"


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def _best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` vectors for each query of one pair of blocks; queries are marked by ``asks``."""
    asks = rows["asks"].to_numpy()
    if asks.all() or not asks.any():
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vector_id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
    ids = rows["id"].to_numpy()
    left, right = (_unit(np.stack(rows["v"].to_numpy()[m])) for m in (asks, ~asks))
    sims = np.round(left @ right.T, DECIMALS)
    # Stable sorts by id, then by similarity: ties keep the smaller id first.
    order = np.argsort(ids[~asks], kind="stable")
    pick = np.argsort(-sims[:, order], axis=1, kind="stable")[:, :k]
    found = np.take_along_axis(sims[:, order], pick, axis=1)
    return pd.DataFrame({"query_id": np.repeat(ids[asks], pick.shape[1]), "vector_id": ids[~asks][order][pick].ravel(), "similarity": found.ravel()})


def _pivots(vectors: DataFrame, rows: int, block_rows: int) -> np.ndarray:
    """Unit vectors of the smallest id hashes, one for each block's worth of rows up to MAX_PIVOTS; zero vectors are none."""
    wanted = max(1, min(MAX_PIVOTS, -(-rows // block_rows)))
    sample = vectors.filter(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(wanted)
    found = np.array([r["v"] for r in sample.collect()])
    return _unit(found) if len(found) else np.zeros((0, 0))


def _cells(pivots: np.ndarray):
    """A step that adds to (id, v) the nearest pivot's number and the angle to it. Zero vectors get number -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column(1)))
            sims = unit @ pivots.T if len(pivots) else np.zeros((len(unit), 1))
            cell = np.where(unit.any(axis=1), sims.argmax(axis=1), -1).astype(np.int32)
            angle = np.arccos(np.clip(sims.max(axis=1), -1.0, 1.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(np.where(cell < 0, 0.0, angle))], ["id", "v", "cell", "angle"])

    return run


def _bounds(pivots: np.ndarray, blocks: pd.DataFrame, k: int):
    """A step from queries to (query_id, block, bound, first) of all blocks; ``first`` marks the best that hold ``k`` vectors."""
    cell, width, count, name = (blocks[c].to_numpy() for c in ("cell", "width", "count", "block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                unit = _unit(_matrix(part.column(1)))
                angles = np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0)) if len(pivots) else np.zeros((len(unit), 1))
                bound = np.cos(np.maximum(angles[:, np.maximum(cell, 0)] - width, 0.0))
                # Zero vectors, and zero queries, have the similarity 0 to all.
                bound = np.where((cell < 0) | ~unit.any(axis=1)[:, None], 0.0, bound)
                order = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(count[order], axis=1) - count[order]
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order, before < k, axis=1)
                ids = np.repeat(np.asarray(part.column(0)), len(name))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(name, len(unit))), pa.array(bound.ravel()), pa.array(first.ravel())], ["query_id", "block", "bound", "first"])

    return run


def vector_search(
    queries: DataFrame, vectors: DataFrame, k: int = 5, query_id: str = "query_id", query_vec: str = "query", id_col: str = "vec_id", vec_col: str = "embedding",
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(the ``k`` most similar vectors of every query, ties by id; query_id, visited and blocks: how much each query saw).

    Rows without a vector are left out. Numbers of blocks follow from the row counts, so a task holds about
    ``block_rows`` vectors and ``query_rows`` queries. Where vectors have no structure the bounds leave out
    nothing, and each block of queries meets each block of vectors.
    """
    asked = queries.select(F.col(query_id).cast("bigint").alias("id"), F.col(query_vec).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    held = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    asked = cut_lineage(asked, "queries")
    rows = held.count()
    groups = max(1, -(-asked.count() // query_rows))
    group = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("qb")
    if rows <= block_rows:  # one block needs no bounds
        right = held.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("qb"), F.lit(False).alias("asks"))
        met = asked.select("id", "v", group, F.lit(True).alias("asks")).unionByName(right).groupBy("qb").applyInPandas(lambda rows: _best(rows, k), FOUND)
        one = F.lit(1).cast("bigint")
        return _ranked(met, k), asked.select(F.col("id").alias("query_id"), one.alias("visited"), one.alias("blocks"))
    pivots = _pivots(held, rows, block_rows)
    placed = cut_lineage(held.mapInArrow(_cells(pivots), "id bigint, v array<double>, cell int, angle double"), "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    # One row for each pivot.
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("block", F.concat_ws("-", "cell", F.pmod(F.xxhash64("id"), F.col("parts"))))
    blocks = dealt.groupBy("cell", "block").agg(F.max("angle").alias("width"), F.count(F.lit(1)).alias("count")).orderBy("block").toPandas()
    bounds = cut_lineage(asked.mapInArrow(_bounds(pivots, blocks, k), "query_id bigint, block string, bound double, first boolean"), "bounds")

    def meet(visits: DataFrame) -> DataFrame:
        left = visits.select(F.col("query_id").alias("id"), "block").join(asked, "id").select("id", "v", "block", group, F.lit(True).alias("asks"))
        wanted = left.select("block", "qb").distinct()
        right = dealt.join(wanted, "block").select("id", "v", "block", "qb", F.lit(False).alias("asks"))
        return left.unionByName(right).groupBy("block", "qb").applyInPandas(lambda rows: _best(rows, k), FOUND)

    near = cut_lineage(meet(bounds.filter("first")), "near")
    least = top_n(near, ["query_id"], [F.desc("similarity"), F.asc("vector_id")], k).groupBy("query_id").agg(F.min("similarity").alias("least"), F.count(F.lit(1)).alias("n"))
    # Rounding moves a similarity by half a unit, and an equal one may have a smaller id.
    beats = (F.col("n") < k) | F.col("n").isNull() | (F.col("bound") + 10.0**-DECIMALS >= F.col("least"))
    more = cut_lineage(bounds.filter("NOT first").join(least, "query_id", "left").filter(beats).select("query_id", "block"), "visits")
    found = near if more.isEmpty() else near.unionByName(meet(more))
    seen = bounds.filter("first").select("query_id").unionByName(more.select("query_id")).groupBy("query_id").agg(F.count(F.lit(1)).alias("visited"))
    return _ranked(found, k), seen.withColumn("blocks", F.lit(len(blocks)).cast("bigint"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return top_n(found, ["query_id"], [F.desc("similarity"), F.asc("vector_id")], k, rank="rank")


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, query_blocks: int | None = None, vector_blocks: int | None = None, **options) -> DataFrame:
    """The ``k`` most similar vectors of every query: query_id, vector_id, similarity, rank; see :func:`vector_search`.

    A wanted number of blocks may be given instead of their sizes.
    """
    for name, frame, blocks in (("query_rows", queries, query_blocks), ("block_rows", vectors, vector_blocks)):
        if blocks:
            options[name] = max(1, -(-frame.count() // blocks))
    return vector_search(queries, vectors, k, **options)[0]


def label_centroids(vectors: DataFrame, label: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Mean vector of each label as (query_id, query), summed per position before any array is built."""
    flat = vectors.select(F.col(label).cast("bigint").alias("query_id"), F.posexplode(vec_col).alias("pos", "x"))
    means = flat.groupBy("query_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy("query_id").agg(F.transform(ordered, lambda p: p["m"]).alias("query"))


def merged_search(results: list[DataFrame], k: int = 5) -> DataFrame:
    """Best ``k`` per query over several collections."""
    both = results[0]
    for df in results[1:]:
        both = both.unionByName(df)
    return top_n(both.drop("rank"), ["query_id"], [F.desc("similarity"), F.asc("collection"), F.asc("vector_id")], k, rank="rank")
