"""How far the sources of a language lie apart, by the shares of their terms.

Terms are counted in the tasks. A slice of texts is cut into terms by their lengths: up to 8 bytes
make one unsigned 64-bit word, up to 16 bytes two, and these are radix-sorted by 16-bit digits and
counted as runs; longer terms are sorted as bytes, one bucket for each length. As the sorts are stable
and documents come group by group, a run also shows in how many documents its term is. Spark sums
the runs of all tasks; shares and their differences are exact whole numbers.

A group is a (lang, source) that occurs. Results for odd rows: null text, lang or source count as '';
rows that repeat count each, as documents of their own; groups without terms take part with counts of
0; a language without kept terms has pairs of value 0 and no term rows; an empty table gives no rows;
texts of any length are read in pieces of a few MB; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, settle, slices, small, text_or_empty

#: A language keeps the terms that are in so many of its documents.
LEAST_DOCS = 3
#: Ranks of the term part.
TOP_TERMS = 200
#: Shares are whole parts of this.
SCALE = 1_000_000_000
#: Bytes of text cut at once; runs that a task holds before they are sent on.
PIECE_BYTES, HELD_RUNS = 4 << 20, 1_000_000
#: Numbers of a block of terms by sources; groups whose counts are sent to the tasks at once.
BLOCK, GROUPS_AT_ONCE = 2_000_000, 100_000

_WORD = np.ones(256, bool)
_WORD[:0x41] = _WORD[0x5B:0x61] = _WORD[0x7B:0x80] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# Terms of a slice, as sorted runs


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows by unsigned ``keys``, the last one leading; numpy sorts 16-bit digits by counting."""
    order = np.arange(len(keys[0]))
    for key in keys:
        for shift in range(0, 8 * key.dtype.itemsize, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _packed(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first 8 bytes from each start as one number, bytes behind the length as 0. ``raw`` has 8 bytes more than its terms."""
    words = np.ndarray(len(raw) - 7, ">u8", raw, strides=(1,))[starts].astype(np.uint64)
    spare = (8 * (8 - np.minimum(lengths, 8))).astype(np.uint64)
    return words >> spare << spare


class Runs:
    """Counted terms: group, up to two words, occurrences, documents; long terms as (group, bytes, occurrences, documents)."""

    def __init__(self, group: np.ndarray, words: np.ndarray, n: np.ndarray, docs: np.ndarray, long: list[tuple]) -> None:
        self.group, self.words, self.n, self.docs, self.long = group, words, n, docs, long

    def __len__(self) -> int:
        return len(self.n) + len(self.long)


def merge(parts: list[Runs], same_document: bool = False) -> Runs:
    """Sum runs of the same group and term. Parts of one document count as one document."""
    group, words = np.concatenate([p.group for p in parts]), np.concatenate([p.words for p in parts])
    n, docs = np.concatenate([p.n for p in parts]), np.concatenate([p.docs for p in parts])
    order = radix_order([group, words[:, 1], words[:, 0]])
    group, words, n, docs = group[order], words[order], n[order], docs[order]
    at = np.flatnonzero(_changes(group, words[:, 0], words[:, 1]))
    if len(at):
        n = np.add.reduceat(n, at)
        docs = (np.maximum if same_document else np.add).reduceat(docs, at)
    long: dict[tuple, list] = {}
    for p in parts:
        for g, term, count, held in p.long:
            was = long.setdefault((g, term), [0, 0])
            was[0] += count
            was[1] = max(was[1], held) if same_document else was[1] + held
    return Runs(group[at], words[at], n, docs, [(*k, *v) for k, v in long.items()])


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it in any key; the first does."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
    return new


def _count(order: np.ndarray, group: np.ndarray, doc: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row of each run, its occurrences, its documents) of rows in ``order``, which keeps groups and documents together."""
    keys = [k[order] for k in keys]
    group, doc = group[order], doc[order]
    new = _changes(group, *keys)
    at = np.flatnonzero(new)
    new[1:] |= doc[1:] != doc[:-1]
    return order[at], np.diff(np.append(at, len(order))), np.add.reduceat(new.astype(np.int64), at) if len(at) else at


def count_terms(raw: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> Runs:
    """Runs of all terms of some documents; ``group`` is sorted."""
    text = np.concatenate([_LOWER[raw], np.zeros(16, np.uint8)])
    inside = _WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(raw):
        edge[0], edge[-1] = inside[0], inside[-1]
    first, last = edge[:-1] & inside, edge[1:] & inside
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    doc = np.searchsorted(offsets, starts, side="right") - 1
    own = group[doc].astype(np.uint32) if len(doc) else np.zeros(0, np.uint32)
    found = []
    for fit in (lengths <= 8, (lengths > 8) & (lengths <= 16)):
        at, size = starts[fit], lengths[fit]
        words = np.zeros((len(at), 2), np.uint64)
        words[:, 0] = _packed(text, at, size)
        keys = [words[:, 0]]
        if len(at) and size[0] > 8:
            words[:, 1] = _packed(text, at + 8, size - 8)
            keys = [words[:, 1], words[:, 0]]
        rows, n, docs = _count(radix_order(keys), own[fit], doc[fit], keys)
        found.append((own[fit][rows], words[rows], n, docs))
    long = []
    wide = np.flatnonzero(lengths > 16)
    for size in np.unique(lengths[wide]):
        some = wide[lengths[wide] == size]
        terms = np.lib.stride_tricks.sliding_window_view(text, size)[starts[some]].copy().view(f"V{size}").ravel().view(f"S{size}")
        rows, n, docs = _count(np.argsort(terms, kind="stable"), own[some], doc[some], [terms])
        long += zip(own[some][rows].tolist(), (bytes(t) for t in terms[rows]), n.tolist(), docs.tolist(), strict=True)
    return Runs(*(np.concatenate(x) for x in zip(*found, strict=True)), long)


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces that end between terms."""
    at = 0
    while at < len(raw):
        to = min(len(raw), at + PIECE_BYTES)
        while to < len(raw) and _WORD[raw[to]]:
            gap = np.flatnonzero(~_WORD[raw[to : to + PIECE_BYTES]])
            to = to + int(gap[0]) if len(gap) else min(len(raw), to + PIECE_BYTES)
        yield raw[at:to]
        at = to


def _runs_of(raw: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> Runs:
    if len(group) == 1 and len(raw) > 2 * PIECE_BYTES:
        held = None
        for piece in _pieces(raw):
            part = count_terms(piece, np.array([0, len(piece)]), group)
            held = merge([held, part], same_document=True) if held else part
        return held
    return count_terms(raw, offsets, group)


def _record(runs: Runs, names: list[tuple[str, str]]) -> pa.RecordBatch:
    """Rows lang, source, term, n, docs; the words are turned back into bytes."""
    rows = runs.words.astype(">u8").view(np.uint8).reshape(len(runs.n), 16)
    kept = rows != 0
    ends = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(kept.sum(axis=1), out=ends[1:])
    terms = pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows[kept])]).cast(pa.string())
    groups, long = runs.group.astype(np.int64), runs.long
    if long:
        terms = pa.concat_arrays([terms, pa.array([t.decode("utf-8", "replace") for _, t, _, _ in long], pa.string())])
        groups = np.append(groups, [g for g, _, _, _ in long])
    n, docs = np.append(runs.n, [x[2] for x in long]), np.append(runs.docs, [x[3] for x in long])
    by = lambda k: pa.array([x[k] for x in names], pa.string()).take(pa.array(groups))
    return pa.RecordBatch.from_arrays([by(0), by(1), terms, pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))], ["lang", "source", "term", "n", "docs"])


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a task's documents, and for each group one row with the term '', which no text holds."""
    known: dict[tuple[str, str], int] = {}
    held: list[Runs] = []
    size = 0
    for batch in batches:
        ids = [known.setdefault(k, len(known)) for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        column, group = batch.column(2).take(pa.array(order)), np.array(ids, np.uint32)[order]
        raw, offsets = buffers(column)
        for a, b in slices(offsets, PIECE_BYTES):
            lo, hi = offsets[a], offsets[b]
            held.append(_runs_of(raw[lo:hi], offsets[a : b + 1] - lo, group[a:b]))
            size += len(held[-1])
            if size > HELD_RUNS:
                held = [merge(held)]
                size = len(held[0])
                if size > HELD_RUNS // 2:
                    yield _record(held[0], list(known))
                    held, size = [], 0
    if known:
        names = list(known)
        if held:
            yield _record(merge(held), names)
        zero = pa.array([0] * len(names), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in names]), pa.array([x[1] for x in names]), pa.array([""] * len(names)), zero, zero], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """One stored row for each kept term of a language: lang, term, docs, total, counts (source, n).

    Rows with the term '' name the groups instead. A list of counts has one element for each source of the
    language that holds the term; runs are summed by group and term before, so no list grows with the documents.
    """
    rows = docs.select(text_or_empty(docs, lang).alias("lang"), text_or_empty(docs, source).alias("source"), text_or_empty(docs, text).alias("text"))
    runs = rows.mapInArrow(_count_texts, "lang string, source string, term string, n long, docs long")
    sums = runs.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return settle(terms.filter((F.col("docs") >= least_docs) | (F.col("term") == "")), "terms")


def group_sums(terms: DataFrame) -> DataFrame:
    """One stored row for each group: lang, source, n_group, n_lang (occurrences of kept terms) and n_terms of the language."""
    groups = terms.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n_group"))
    langs = terms.groupBy("lang").agg(F.sum("total").alias("n_lang"), F.sum((F.col("term") != "").cast("long")).alias("n_terms"))
    return settle(groups.join(langs, "lang"), "groups")


# Shares and differences, in whole numbers


def share(count: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / whole), by three divisions of at most 1000 times a number below ``whole``."""
    left, out = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + _div(left, whole), left % whole
    return out + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def difference(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    left, out = count.astype(np.int64) + 1, np.zeros(len(count), np.int64)
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // whole, left % whole
    return out + 1


def pair_values(term: np.ndarray, source: np.ndarray, count: np.ndarray, n_terms: int, wholes: np.ndarray) -> np.ndarray:
    """Summed differences of all ordered pairs of sources over ``n_terms`` terms, given the counts above 0.

    ``wholes`` are the sources' N + V. Work is the number of given counts times the sources: where the first
    source lacks a term its share is always the same, so equal shares of the others are taken together.
    """
    sources = len(wholes)
    none = _shares(np.zeros(sources, np.int64), wholes)
    own = _shares(count, wholes[source])
    table, there = np.repeat(none[None], n_terms, axis=0), np.zeros((n_terms, sources), bool)
    table[term, source], there[term, source] = own, True
    held = there.sum(axis=0)
    equal, times = np.unique(source << 31 | own, return_counts=True)
    share_of, starts = equal & ((1 << 31) - 1), np.searchsorted(equal >> 31, np.arange(sources))
    out = np.zeros((sources, sources), np.int64)
    for g in range(sources):
        rows = np.flatnonzero(there[:, g])
        q, seen = table[rows], there[rows]
        p = q[:, g : g + 1]
        with_g = ((p - q) ** 2 // q).sum(axis=0)
        lone = (none[g] - q) ** 2 // q
        sums = np.append(times * ((none[g] - share_of) ** 2 // share_of), 0)
        others = np.where(held > 0, np.add.reduceat(sums, starts), 0) - np.where(seen, lone, 0).sum(axis=0)
        neither = n_terms - len(rows) - (held - seen.sum(axis=0))
        out[g] = with_g + others + neither * ((none[g] - none) ** 2 // none)
    return out


def _pairs(stats: dict[str, tuple[list[str], list[int]]]):
    """A step that sums the pair values of a task's terms, for the languages of ``stats`` (sources and their N + V)."""
    result = ["lang", "source", "item", "value"]

    def record(lang: str, values: np.ndarray) -> pa.RecordBatch:
        names = pa.array(stats[lang][0], pa.string())
        a, b = np.divmod(np.arange(values.size), len(names))
        return pa.RecordBatch.from_arrays([pa.array([lang] * values.size, pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(values.ravel())], result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0)
            for lang in pc.unique(langs).to_pylist():
                names, wholes = stats[lang][0], np.array(stats[lang][1], np.int64)
                some, step = batch.filter(pc.equal(langs, lang)), max(1, BLOCK // len(names))
                for at in range(0, some.num_rows, step):
                    counts = some.column(1).slice(at, step)
                    term = np.asarray(pc.list_parent_indices(counts)).astype(np.int64)
                    flat = counts.flatten()
                    source = np.asarray(pc.index_in(flat.field("source"), value_set=pa.array(names, pa.string()))).astype(np.int64)
                    values = pair_values(term, source, np.asarray(flat.field("n")), len(counts), wholes)
                    if values.size > BLOCK:
                        yield record(lang, values)
                    else:
                        held[lang] = held[lang] + values if lang in held else values
        for lang, values in held.items():
            yield record(lang, values)

    return run


def _blocks(groups: DataFrame) -> Iterator[dict[str, tuple[list[str], list[int]]]]:
    """Whole languages with their sources and N + V, some GROUPS_AT_ONCE groups together; a larger language comes alone."""
    block: dict[str, tuple[list[str], list[int]]] = {}
    size, last = 0, None
    rows = groups.filter("n_terms > 0").select("lang", "source", F.col("n_group") + F.col("n_terms")).orderBy("lang", "source")
    for lang, source, whole in rows.toLocalIterator():
        if lang != last and size > GROUPS_AT_ONCE:
            yield block
            block, size = {}, 0
        names, wholes = block.setdefault(lang, ([], []))
        names.append(source)
        wholes.append(whole)
        size, last = size + 1, lang
    if block:
        yield block


def source_pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language), value: the difference summed over all kept terms."""
    other = groups.select("lang", F.col("source").alias("item"))
    out = groups.select("lang", "source").join(other, "lang").filter("source <> item")
    sums = None
    for block in _blocks(groups):
        some = terms.filter((F.col("term") != "") & F.col("lang").isin(list(block))).select("lang", "counts")
        part = some.mapInArrow(_pairs(block), "lang string, source string, item string, value long")
        sums = part if sums is None else sums.unionByName(part)
    if sums is None:
        return out.withColumn("value", F.lit(0).cast("long"))
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return out.join(sums, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))


def source_terms(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of the terms that a source holds more often than its language does."""
    rows = terms.filter("term <> ''").select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    rows = rows.join(small(groups), ["lang", "source"])
    rows = rows.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("n_group") + F.col("n_terms")).alias("p"), share(F.col("total"), F.col("n_lang") + F.col("n_terms")).alias("q"))
    return rows.filter("p > q").select("lang", "source", "item", difference(F.col("p"), F.col("q")).alias("value"))


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank; see the module for odd rows.

    Pairs are as many as the sources of a language times themselves, which is the size of the result.
    """
    terms = term_counts(docs, least_docs)
    groups = group_sums(terms)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = source_pairs(terms, groups).withColumn("rank", rank).withColumn("part", F.lit("pair"))
    best = source_terms(terms, groups).withColumn("rank", rank).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(best).select("lang", "source", "part", "item", "value", "rank")
