"""A Merkle manifest of a table: one leaf for each row, a tree for each language, one root over all.

A row's place in its language is found without sorting rows. The ids of a group form a compressed bitmap:
only words of 64 ids that hold some are kept, the words that tasks find are merged by bitwise or, and
directories hold how many rows lie before a word (inside its block of 64 words) and before a block. A row's
place is the sum of both and of the bits below its own, so one join on the word gives it. Rows that share
an id are placed in the same way by the first 60 bits of their leaf, and equal rows by their row number.

Levels are then reduced by keys: a place divided by 8 names the run, the remainder is the slot in the run's
array of digests. Going down again, each run hands its children the digests beside them, so a row's proof is
known where its run is read.

Results for odd rows: a null language is a group of its own and comes first; null ids come first in their
language; rows that share an id are ordered by their leaf; null columns are part of a leaf as '-'; rows that
repeat are leaves of their own; an empty table gives no rows; columns that are not part of a leaf are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, small

#: Children of a node.
FANOUT = 8
#: Columns of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# Leaves


def digest(parts: Column) -> Column:
    """Lowercase hex SHA-256 of an array of strings, one after the other."""
    return F.sha2(F.concat_ws("", parts), 256)


def leaf_of(values: list[Column]) -> Column:
    """Digest of values, each written as '-' if null, else as its number of UTF-8 bytes, ':' and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def tampered(doc_id: Column) -> Column:
    """Whether the check alters a row: 3 divides the CRC-32 of its decimal id. Null ids are left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 0, F.lit(False))


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Places by bitmaps


def running_before(rows: DataFrame, group: list[str], by: str, value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of the group that come before by ``by``; (group, by) is unique.

    Rows are range-partitioned and stored with their part; a running sum inside each part is added to
    the sums of the parts before it, which are as many as the partitions times the groups in them.
    """

    def before(*keys: str) -> Window:
        return Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)

    parts = settle(rows.repartitionByRange(*group, by).withColumn("m_part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy(*group, "m_part").agg(F.sum(value).alias("m_sum"))
    totals = totals.select(*group, "m_part", F.coalesce(F.sum("m_sum").over(before(*group).orderBy("m_part")), F.lit(0)).alias("m_earlier"))
    inside = F.coalesce(F.sum(value).over(before(*group, "m_part").orderBy(by)), F.lit(0))
    return parts.withColumn("m_inside", inside).join(totals, [*group, "m_part"]).withColumn(out, F.col("m_earlier") + F.col("m_inside")).drop("m_part", "m_inside", "m_earlier")


def _word(value: str) -> Column:
    return F.shiftright(F.col(value), 6)


def _bit(value: str) -> Column:
    return F.col(value).bitwiseAND(F.lit(63)).cast("int")


def bitmap_index(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """The bitmap of each group's values: group, m_word, m_bits, m_more, m_start.

    ``m_start`` rows of the group lie before the word; ``m_more`` lists (bit, further rows) of values that
    repeat, at most 64 of them.
    """
    times = rows.groupBy(*group, _word(value).alias("m_word"), _bit(value).alias("m_bit")).agg(F.count("*").alias("m_n"))
    more = F.when(F.col("m_n") > 1, F.struct("m_bit", (F.col("m_n") - 1).alias("m_n")))
    words = times.groupBy(*group, "m_word").agg(F.bit_or(F.expr("shiftleft(1L, m_bit)")).alias("m_bits"), F.collect_list(more).alias("m_more"), F.sum("m_n").alias("m_count"))
    words = settle(words.withColumn("m_block", F.shiftright("m_word", 6)), "bitmap")
    blocks = running_before(words.groupBy(*group, "m_block").agg(F.sum("m_count").alias("m_size")), group, "m_block", "m_size", "m_before")
    in_block = Window.partitionBy(*group, "m_block").orderBy("m_word").rowsBetween(Window.unboundedPreceding, -1)
    words = words.withColumn("m_inside", F.coalesce(F.sum("m_count").over(in_block), F.lit(0))).join(blocks, [*group, "m_block"])
    return words.select(*group, "m_word", "m_bits", "m_more", (F.col("m_before") + F.col("m_inside")).alias("m_start"))


def ranked(rows: DataFrame, group: list[str], value: str, place: str, same: str) -> DataFrame:
    """Add how many rows of the group have a smaller value (``place``) and how many an equal one (``same``)."""
    bit = _bit(value)
    rows = rows.withColumn("m_word", _word(value)).join(bitmap_index(rows, group, value), [*group, "m_word"])
    below = F.bit_count(F.col("m_bits").bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(-1L, cast({value} & 63 AS int))"))))

    def further(test) -> Column:
        return F.aggregate(F.filter("m_more", test), F.lit(0).cast("long"), lambda total, x: total + x["m_n"])

    places = {place: F.col("m_start") + below + further(lambda x: x["m_bit"] < bit), same: F.lit(1) + further(lambda x: x["m_bit"] == bit)}
    return rows.withColumns(places).drop("m_word", "m_bits", "m_more", "m_start")


def placed(leaves: DataFrame) -> DataFrame:
    """Leaves (grp, doc_id, h, row and more) with their ``place`` in the group and the group's size ``n``; stored.

    Ids may repeat: then the first 60 bits of the leaf decide, and after that the row number. Each step only
    reads the rows that the one before found equal. Null ids have a bitmap of their own, before the others.
    """
    rows = leaves.withColumns({"m_id": F.coalesce(F.col("doc_id"), F.lit(0).cast("long")), "m_known": F.col("doc_id").isNotNull().cast("int"), "m_leaf": F.conv(F.substring("h", 1, 15), 16, 10).cast("long")})
    group, done = ["grp", "m_known"], []
    for value in ("m_id", "m_leaf", "row"):
        if done:
            rows = rows.withColumnRenamed("place", "m_outer")
        rows = ranked(rows, group, value, "place", "m_same")
        if done:
            rows = rows.withColumn("place", F.col("place") + F.col("m_outer")).drop("m_outer")
        rows = settle(rows, "places")
        done.append(rows.filter("m_same = 1").drop("m_same"))
        group, rows = [*group, value], rows.filter("m_same > 1").drop("m_same")
        if rows.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    sizes = small(settle(leaves.groupBy("grp").agg(F.count("*").alias("n"), (F.count("*") - F.count("doc_id")).alias("m_nulls")), "sizes"))
    out = out.join(sizes, "grp").withColumn("place", F.col("place") + F.when(F.col("m_known") == 1, F.col("m_nulls")).otherwise(0))
    return settle(out.drop("m_id", "m_known", "m_leaf", "m_nulls", "row"), "placed")


# Levels up and proofs down


def _up(count: str) -> Column:
    return F.expr(f"{count} div {FANOUT}")


def levels_of(nodes: DataFrame, extra: list[str]) -> list[DataFrame]:
    """The levels above nodes (grp, place, n, h, extra): grp, place, n, kids (slot, h, extra), h; each stored.

    A level has the runs of groups that have more than one node, under the key of their place divided by FANOUT.
    """
    levels, largest = [], nodes.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        kids = F.array_sort(F.collect_list(F.struct((F.col("place") % FANOUT).cast("int").alias("slot"), "h", *extra))).alias("kids")
        runs = nodes.filter("n > 1").groupBy("grp", _up("place").alias("place"), _up(f"(n + {FANOUT - 1})").alias("n")).agg(kids)
        levels.append(settle(runs.withColumn("h", digest(F.col("kids.h"))), "level"))
        nodes, extra, largest = levels[-1], [], -(-largest // FANOUT)
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """grp and h of what remains of each group; stored."""
    out = nodes.filter("n = 1").select("grp", "h")
    for level in levels:
        out = out.unionByName(level.filter("n = 1").select("grp", "h"))
    return settle(out, "tops")


def _beside(kids: str, kid: str) -> Column:
    """The digests left and right of one of a run's children."""
    side = lambda test: F.concat_ws("", F.filter(kids, test)["h"])
    slot = F.col(kid)["slot"]
    return F.struct(side(lambda k: k["slot"] < slot).alias("l"), side(lambda k: k["slot"] > slot).alias("r"))


def paths_down(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """grp, kid and path of all children of the lowest level; a path lists what lies beside a node, from itself up.

    ``above`` (grp, path) is the path of what remains of a group; a group joins in at its own last level.
    """
    start = F.lit(0).cast("long").alias("place")
    paths = above.select("grp", start, "path")
    for k in reversed(range(len(levels))):
        down = levels[k].select("grp", "place", "kids").join(paths, ["grp", "place"]).withColumn("kid", F.explode("kids"))
        down = down.withColumn("path", F.concat(F.array(_beside("kids", "kid")), F.col("path"))).select("grp", "place", "kid", "path")
        if k:
            paths = down.select("grp", (F.col("place") * FANOUT + F.col("kid.slot")).alias("place"), "path")
            paths = paths.unionByName(levels[k - 1].filter("n = 1").select("grp").join(above, "grp").select("grp", start, "path"))
    return down.select("grp", "kid", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["l"], h, p["r"]), 256))


def proof_digest(path: Column) -> Column:
    return digest(F.transform(path, lambda p: F.concat(p["l"], p["r"])))


def build_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row of ``docs`` (FIELDS)."""
    fields = {c: F.col(c) for c in FIELDS}
    text = F.col("text").cast("string")
    leaves = docs.select(
        # A mark before the language keeps null (no mark) first and apart from ''.
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf_of(list(fields.values())).alias("h"), F.when(tampered(F.col("doc_id")), leaf_of([*list(fields.values())[:-1], lowered(text)])).alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )
    nodes = placed(settle(leaves, "leaves"))
    levels = levels_of(nodes, ["doc_id", "changed"])
    subroots = tops(nodes, levels)

    groups = subroots.count()
    langs = running_before(subroots.withColumn("one", F.lit(1)), [], "grp", "one", "place")
    langs = settle(langs.select(F.lit("").alias("grp"), "place", F.lit(groups).cast("long").alias("n"), "h", F.col("grp").alias("of")), "langs")
    root_levels = levels_of(langs, ["of"])
    root = tops(langs, root_levels).select(F.col("h").alias("root"))
    nothing = F.array().cast("array<struct<l:string,r:string>>").alias("path")
    if root_levels:
        over = paths_down(root_levels, root.select(F.lit("").alias("grp"), nothing)).select(F.col("kid.of").alias("grp"), "path")
    else:
        over = langs.select(F.col("of").alias("grp"), nothing)
    over = small(settle(over, "over"))

    found = nodes.filter("n = 1").join(over, "grp").select("grp", "doc_id", "h", "changed", "path")
    if levels:
        found = found.unionByName(paths_down(levels, over).select("grp", "kid.doc_id", "kid.h", "kid.changed", "path"))
    found = found.join(small(subroots.withColumnRenamed("h", "subroot")), "grp").join(F.broadcast(root))  # one row
    found = found.withColumn("folded_root", folded(F.coalesce("changed", "h"), F.col("path")))
    return found.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
