"""Mix sources to target weights by hash thresholds.

Every document has a fixed 63-bit hash. A source's budget is met by a threshold: documents whose hash
lies below it are taken once more than the others. Word counts are summed by (source, hash bucket);
the bucket in which a source's running total passes its budget is refined by the next hash bits, all
others are settled by the total, so nothing is sorted and thresholds of a smaller budget lie below
those of a larger one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_names, settle, small, text_or_empty

HASH_BITS = 63
#: Bits by which a boundary bucket is divided in one round.
ROUND_BITS = 9


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_ranks(sources: DataFrame) -> DataFrame:
    """Add ``rank`` (long, from 0) to a frame of distinct ``source`` values: by code point, null last.

    The values are range-sorted; a value's rank is its place in its own part plus the sizes of the
    parts before it, so no task sees more than one part.
    """
    # UTF-8 bytes sort as code points do.
    parts = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), "source")
    place = F.monotonically_increasing_id()
    parts = parts.withColumn("part", F.shiftright(place, 33)).withColumn("place", place.bitwiseAND((1 << 33) - 1))
    parts = settle(parts, "sources")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.alias("x").join(sizes.alias("y"), F.col("y.part") < F.col("x.part"), "left")
    before = before.groupBy("x.part").agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("before"))
    return parts.join(before, "part").withColumn("rank", F.col("place") + F.col("before")).drop("part", "place", "before")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Add ``target`` (double) to (source, source_size, rank).

    ``share`` times all sizes is dealt by weight. A target stops at ``most`` times its source's size
    and the excess is dealt again by weight to the others, until none is above. Each round needs two
    sums over all sources; only these come to the driver.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    whole = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = float(share) * whole
    level, full_before = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("cap")
        row = sources.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        if level and (row[0] == full_before or not row[2]):
            break
        full_before = row[0]
        if not row[2]:
            break
        level = (budget - row[1]) / row[2]
        if level <= 0:
            break
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return sources.withColumn("target", target).drop("weight", "cap")


def thresholds(rows: DataFrame, budgets: DataFrame, bits: int = ROUND_BITS) -> DataFrame:
    """(source_id, below): the documents of a source whose hash is under ``below`` weigh about its budget.

    ``rows`` has source_id, hash and size; ``budgets`` has source_id and budget (double). The rounds
    end when the boundary bucket of each source holds one hash; that one is taken if the total then
    lies nearer to the budget.
    """
    settled, shift = None, HASH_BITS
    active = budgets.select("source_id", F.col("budget").alias("left"), F.lit(0).cast("long").alias("bucket"))
    while shift > 0:
        step = min(bits, shift)
        shift -= step
        own = F.shiftright("hash", shift)
        inside = rows.withColumn("bucket", F.shiftright("hash", shift + step)).join(small(active), ["source_id", "bucket"])
        counts = inside.groupBy("source_id", own.alias("bucket")).agg(
            F.sum("size").alias("weight"), F.min("hash").alias("least"), F.max("hash").alias("last"), F.first("left").alias("left")
        )
        upto = Window.partitionBy("source_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("before", F.sum("weight").over(upto) - F.col("weight"))
        at = F.max_by(F.struct("bucket", "before", "weight", "least", "last", "left"), F.col("bucket"))
        edge = counts.filter("before <= left").groupBy("source_id").agg(at.alias("e")).select("source_id", "e.*")
        edge = settle(edge.withColumn("left", F.col("left") - F.col("before")), "edges")
        # Past the last bucket, or at one hash: whole bucket in or out, whichever is nearer.
        one = (F.col("least") == F.col("last")) | (F.col("left") >= F.col("weight"))
        below = F.when(2 * F.col("left") >= F.col("weight"), F.col("last") + 1).otherwise(F.col("least"))
        done = edge.filter(one).select("source_id", below.alias("below"))
        settled = done if settled is None else settled.unionByName(done)
        active = edge.filter(~one).select("source_id", "left", "bucket")
        if active.isEmpty():
            break
    return settled


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", prefix: str = "mix_",
) -> DataFrame:
    """Each row's part in a mix of sources; keeps ``id_col`` and adds key and figures.

    Returns id, ``text_hash`` (with the id the key of a row), source and, with ``prefix``: size
    (words), source_size, target (words of its source) and copies (how often the mix takes the
    document). Sources are ordered by code point, null last, and take ``weights`` in turn; a null
    source is a source like any other. Null and empty texts weigh 0 and are taken like others. Rows
    that are equal in id and text share a hash and are taken together. An empty table gives no rows.
    Other columns are neither read nor returned, so their names cannot clash.
    """
    text = text_or_empty(docs, text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), text), 1).alias("hash"),
    )
    rows = settle(rows, "sizes")
    sources = source_ranks(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = settle(targets(sources, weights, share, most), "targets")
    # The rank stands for the source from here on.
    named = sources.select(F.col("source").alias("s"), F.col("rank").alias("source_id"), "source_size", "target")
    keyed = rows.join(small(named), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budgets = sources.select(F.col("rank").alias("source_id"), (F.col("target") - whole * F.col("source_size")).alias("budget"))
    below = settle(thresholds(keyed.select("source_id", "hash", "size"), budgets), "thresholds")
    mixed = keyed.join(small(below), "source_id", "left")
    copies = whole + F.when(F.col("hash") < F.col("below"), 1).otherwise(0)
    figures = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": F.least(copies, F.lit(int(most)))}
    return mixed.select(F.col("id").alias(id_col), "text_hash", F.col("source").alias(source_col), *[v.cast("double" if k == "target" else "long").alias(prefix + k) for k, v in figures.items()])


def take(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = "mix_") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``, whatever their names."""
    key, hashed, copies, n = free_names(docs, "mix_key_id", "mix_key_text", "mix_copies", "mix_n")
    parts = mixed.groupBy(F.col(id_col).alias(key), F.col("text_hash").alias(hashed)).agg(F.max(f"{prefix}copies").alias(copies)).filter(F.col(copies) > 0)
    same = F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_or_empty(docs, text_col)) == F.col(hashed))
    repeated = docs.join(parts, same).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return repeated.drop(key, hashed, copies, n)
