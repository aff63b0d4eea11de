"""Secrets in texts: fixed patterns, and random-looking strings found by two character Markov models.

Both models count pairs of neighbouring characters: one in values that the patterns matched, one in
ordinary words and identifiers of the same documents. A string, or the stretches of one, are reported
when the random model explains them better by a wide enough log-likelihood ratio. Only built-in
column functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import constant, free_names, text_or_empty

# The patterns, the group that holds the secret and its least length.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")
MIN_ASSIGN = 6

#: Strings that the models judge, and the characters they know (U+002B to U+007A): of 20 and more
#: characters all; of 8 to 19 those where small letters meet capitals, or letters digits. In one case
#: alone short random strings look like words in capitals or of rare languages.
CANDIDATE = (
    "[A-Za-z0-9+/_=-]{20,}|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{8})(?=[A-Za-z0-9+/_=-]*?(?:[a-z][A-Z]|[A-Za-z][0-9]|[0-9][A-Za-z]))[A-Za-z0-9+/_=-]++"
)
ORDINARY = "[A-Za-z0-9+/_=-]{4,}"
FIRST_CHAR, CHARS = 43, 80
#: Share of a uniform model in the random one; weight of single characters in that of pairs; count of an unseen character.
UNIFORM, PRIOR, FLOOR = 0.5, 5.0, 0.1
#: A string or a stretch of one is random above this ratio (in nats) in all and for each character.
MIN_RATIO, MIN_RATIO_CHAR = 15.0, 0.6
#: A random stretch ends where the ratio, less its least value for each character, has fallen by this much from its peak.
DROP = 15.0
#: Matches of a text are placed and compared in blocks of so many.
BLOCK = 64


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(values: Column, size: int = BLOCK) -> Column:
    """An array in arrays of ``size`` elements; one empty array if there are none."""
    return _let(values, lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(size)), lambda i: F.slice(v, i + 1, F.lit(size))))


def _before(values: Column, more: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """What ``more`` (a sum or a maximum) makes of 0 and the elements before each one of array<bigint>.

    Blocks are folded on their own from what lies before them, so no fold copies a long array again and again.
    """
    none = F.from_json(F.lit("[]"), "array<bigint>")

    def fold(block: Column, at: Column) -> Column:
        add = lambda done, x: F.struct(more(done["at"], x).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out"))
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), add, lambda done: done["out"])

    zero = F.lit(0).cast("bigint")
    if levels == 0:
        return fold(values, zero)

    def by_blocks(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, zero, more))
        return F.flatten(F.zip_with(blocks, _before(whole, more, levels - 1), fold))

    return _let(_blocks(values), by_blocks)


def spans(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap, as array<struct<start, end, value>>; code points, end exclusive.

    The text between matches comes from a split by the same pattern; a match starts where the parts
    and matches before it end.
    """

    def placed(gaps: Column, matches: Column) -> Column:
        length = F.zip_with(gaps, matches, lambda gap, value: (F.length(gap) + F.length(value)).cast("bigint"))
        parts = F.arrays_zip(_before(length, lambda a, n: a + n).alias("at"), gaps.alias("gap"), matches.alias("value"))
        return F.transform(parts, lambda p: _span(p["at"] + F.length(p["gap"]), p["value"]))

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: _let(F.slice(F.split(text, pattern, -1), 1, F.size(m)), lambda gaps: placed(gaps, m)))
    none = F.from_json(F.lit("[]"), "array<struct<start:bigint,end:bigint,value:string>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def _span(start: Column, value: Column) -> Column:
    return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))


def base_spans(text: Column, kind: str) -> Column:
    if kind == "assign":
        # Too short values are dropped after the match, so that they use up their place in the text.
        return F.filter(spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= MIN_ASSIGN)
    return spans(text, {"access": ACCESS, "hex": HEX}[kind])


def _values(text: Column, kind: str) -> Column:
    found = base_spans(text, kind)
    return F.transform(found, lambda s: F.regexp_extract(s["value"], ASSIGN, 2) if kind == "assign" else s["value"])


def _named(column: str, kind: str, place: int) -> Column:
    return F.transform(
        F.col(column), lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"))
    )


def _pairs(word: Column) -> Column:
    """Indices of a word's neighbouring characters in the models' tables."""
    letters, n = F.split(word, ""), F.length(word) - 1
    zipped = F.arrays_zip(F.slice(letters, 1, n).alias("a"), F.slice(letters, 2, n).alias("b"))
    return F.transform(zipped, lambda p: (F.ascii(p["a"]) - FIRST_CHAR) * CHARS + F.ascii(p["b"]) - FIRST_CHAR)


def train(docs: DataFrame, text_col: str = "text") -> list[float]:
    """Log-likelihood ratio for each pair of characters, random over ordinary; CHARS * CHARS numbers.

    The labelled samples are strings of all documents, each counted once: values of the patterns are
    random ones, other strings of four and more characters ordinary ones if two different texts hold
    them. Only the pair counts, at most 2 * CHARS * CHARS, come to the driver. Without any sample no
    string is found to be random.
    """
    some = docs.select(text_or_empty(docs, text_col).alias("text"))
    values = F.concat(*[_values(F.col("text"), k) for k in KINDS])
    some = some.select("text", F.xxhash64("text").alias("hash"), values.alias("values"))
    words = F.array_distinct(F.array_except(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0)), F.col("values")))
    # A string that holds a value, such as one with a prefix, is no ordinary one.
    plain = F.filter(words, lambda w: ~F.exists("values", lambda v: F.contains(w, v)))
    labelled = some.select("hash", F.explode(F.array(F.struct(F.lit(1).alias("random"), F.array_distinct("values").alias("words")), F.struct(F.lit(0).alias("random"), plain.alias("words")))).alias("x"))
    word = labelled.select("hash", "x.random", F.explode("x.words").alias("word")).filter(F.length("word") >= 4)
    # An unknown secret is no ordinary string; such a one hardly stands in two texts, but in all copies of one.
    word = word.groupBy("random", "word").agg(F.min("hash").alias("least"), F.max("hash").alias("most")).filter("random = 1 OR least < most")
    pair = word.select("random", F.explode(_pairs(F.col("word"))).alias("pair")).filter(F.col("pair").between(0, CHARS * CHARS - 1))
    counts = {(r["random"], r["pair"]): r["n"] for r in pair.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    return _ratios(counts)


def _ratios(counts: dict[tuple[int, int], int]) -> list[float]:
    from math import log

    table = [[[counts.get((c, p * CHARS + q), 0) for q in range(CHARS)] for p in range(CHARS)] for c in (0, 1)]
    single = []
    for rows in table:
        whole = sum(map(sum, rows)) + FLOOR * CHARS
        single.append([(sum(r[q] for r in rows) + FLOOR) / whole for q in range(CHARS)])
    out = []
    for p in range(CHARS):
        seen = [sum(rows[p]) for rows in table]
        for q in range(CHARS):
            # Pairs lean on how frequent the second character is, the more the rarer the first one.
            chance = [(table[c][p][q] + PRIOR * single[c][q]) / (seen[c] + PRIOR) for c in (0, 1)]
            out.append(round(log(UNIFORM / 64 + (1 - UNIFORM) * chance[1]) - log(chance[0]), 4))
    return out


def log_ratio(word: Column, model: Column) -> Column:
    """Log-likelihood ratio of a word of known characters; positive when it looks random."""
    return F.aggregate(_pairs(word), F.lit(0.0), lambda total, p: total + F.element_at(model, p.cast("int") + 1))


def _possible(word: Column, gains: Column, min_ratio: float) -> Column:
    """Whether the positive ratios of a word's pairs suffice for a random stretch."""
    return F.aggregate(_pairs(word), F.lit(0.0), lambda total, p: total + F.element_at(gains, p.cast("int") + 1)) >= min_ratio


def _stretches(word: Column, model: Column, min_ratio: float, min_ratio_char: float) -> Column:
    """Random stretches of a word, array<struct<start, end>>, in one pass.

    The ratio less ``min_ratio_char`` for each pair is summed up; a stretch starts after the last sum
    that is not positive, and ends at the peak of the sum among the places where it is random.
    """
    kind = "struct<at:int,start:int,sum:double,ratio:double,best:double,end:int,found:array<struct<start:int,end:int>>>"
    first = F.from_json(F.lit('{"at":0,"start":0,"sum":0,"ratio":0,"best":0,"end":0,"found":[]}'), kind)

    def closed(done: Column) -> Column:
        one = F.array(F.struct(done["start"].alias("start"), done["end"].alias("end")))
        return F.when(done["end"] > 0, F.concat(done["found"], one)).otherwise(done["found"])

    def add(done: Column, p: Column) -> Column:
        fresh = (done["sum"] <= 0) | ((done["end"] > 0) & (done["sum"] < done["best"] - DROP))
        old = lambda name, none: F.when(fresh, none).otherwise(done[name])
        ratio = F.element_at(model, p.cast("int") + 1)
        all_, total = old("ratio", F.lit(0.0)) + ratio, old("sum", F.lit(0.0)) + ratio - min_ratio_char
        better = (all_ >= min_ratio) & (total >= min_ratio_char) & (total >= old("best", F.lit(0.0)))
        return F.struct(
            (done["at"] + 1).alias("at"), old("start", done["at"]).alias("start"), total.alias("sum"), all_.alias("ratio"), F.when(better, total).otherwise(old("best", F.lit(0.0))).alias("best"),
            F.when(better, done["at"] + 2).otherwise(old("end", F.lit(0))).alias("end"), F.when(fresh, closed(done)).otherwise(done["found"]).alias("found"),
        )

    return F.aggregate(_pairs(word), first, add, closed)


def _whole_parts(word: Column, stretch: Column) -> Column:
    """A stretch of a word, widened to the letters and digits that it begins and ends among.

    Where it holds only two or fewer of more such characters, these are left out.
    """
    start, end = stretch["start"], stretch["end"]
    text = F.substr(word, start + 1, end - start)
    count = lambda x, pattern: F.length(F.regexp_extract(x, pattern, 0))
    before = count(F.substr(word, F.lit(1), start), "(?<![A-Za-z0-9])[A-Za-z0-9]*+$")
    after = count(F.substr(word, end + 1, F.length(word)), "^[A-Za-z0-9]*+")
    head, tail = count(text, "^[A-Za-z0-9]{0,2}[^A-Za-z0-9]++"), count(text, "(?<![^A-Za-z0-9])[^A-Za-z0-9]++[A-Za-z0-9]{0,2}$")
    start = F.when((before > 2) & (head > 0), start + head).otherwise(start - before)
    end = F.when((after > 2) & (tail > 0), end - tail).otherwise(end + after)
    return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))


def _outside(span: Column, taken: Column) -> Column:
    """The parts of a span between those of ``taken``, sorted: array<struct<start, end>>."""
    first = F.struct(span["start"].alias("at"), F.from_json(F.lit("[]"), "array<struct<start:bigint,end:bigint>>").alias("out"))

    def with_part(done: Column, to: Column) -> Column:
        return F.when(done["at"] < to, F.concat(done["out"], F.array(F.struct(done["at"].alias("start"), to.alias("end"))))).otherwise(done["out"])

    def add(done: Column, b: Column) -> Column:
        return F.struct(F.greatest(done["at"], b["end"]).alias("at"), with_part(done, F.least(b["start"], span["end"])).alias("out"))

    return F.aggregate(taken, first, add, lambda done: with_part(done, span["end"]))


def find_secrets(
    docs: DataFrame, model: list[float] | None = None, text_col: str = "text", min_ratio: float = MIN_RATIO, min_ratio_char: float = MIN_RATIO_CHAR, prefix: str = "secret_",
) -> DataFrame:
    """Add ``<prefix>spans``: array<struct<kind, start, end, value>> of all secrets in each row's text.

    Kinds are those of KINDS and ``random`` for what only the models find: whole strings of known
    characters, or else their random stretches, however long; of one that overlaps a pattern's match
    the parts outside the match. Spans are sorted by start, then kind as listed. Null and empty
    texts have none; rows that repeat are judged alike; an empty table gives no rows; a column of the
    new name is replaced, all others stay whatever their names. Long texts are scanned whole.
    """
    if model is None:
        model = train(docs, text_col)
    text, table = text_or_empty(docs, text_col), constant(model, "array<double>")
    order = (*KINDS, "random")
    *columns, taken_col, words_col = free_names(docs, *order, "taken", "words")
    column = dict(zip(order, columns, strict=True))
    work = docs
    for k in KINDS:
        work = work.withColumn(column[k], base_spans(text, k))

    def judged(word: Column) -> Column:
        ratio = log_ratio(word, table)
        return (ratio >= min_ratio) & (ratio >= min_ratio_char * F.length(word))

    gains = constant([max(x, 0.0) for x in model], "array<double>")
    taken = F.array_sort(F.concat(*[F.transform(column[k], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS]))
    work = work.withColumn(taken_col, taken)

    overlap = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def found(s: Column, around: Column) -> Column:
        """Random parts of a string and its place."""
        near = F.filter(around, lambda b: overlap(b, s))
        part = lambda a, b: F.struct(a.alias("start"), b.alias("end"), F.substr(s["value"], (a - s["start"] + 1).cast("int"), (b - a).cast("int")).alias("value"))
        stretches = F.transform(_stretches(s["value"], table, min_ratio, min_ratio_char), lambda x: _whole_parts(s["value"], x))
        placed = F.transform(stretches, lambda x: F.struct((s["start"] + x["start"]).alias("start"), (s["start"] + x["end"]).alias("end")))
        free = F.flatten(F.transform(placed, lambda x: _outside(x, F.filter(near, lambda b: overlap(b, x)))))
        parts = F.filter(F.transform(free, lambda x: part(x["start"], x["end"])), lambda x: x["value"].rlike("[A-Za-z0-9]"))
        return F.when((F.size(near) == 0) & judged(s["value"]), F.array(part(s["start"], s["end"]))).otherwise(F.array_distinct(parts))

    def found_in(strings: Column, around: Column, sizes: tuple[int, ...]) -> Column:
        """Random parts of strings; blocks of them, then smaller ones, meet only the matches that reach into them."""
        if not sizes:
            return F.flatten(F.transform(strings, lambda s: found(s, around)))

        def block(b: Column) -> Column:
            reach = F.struct(F.get(b, F.lit(0))["start"].alias("start"), F.get(b, F.size(b) - 1)["end"].alias("end"))
            return _let(reach, lambda r: _let(F.filter(around, lambda t: overlap(t, r)), lambda near: found_in(b, near, sizes[1:])))

        return F.flatten(F.transform(_blocks(strings, sizes[0]), block))

    possible = lambda w: _possible(w, gains, min_ratio)
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    none = F.from_json(F.lit("[]"), "array<struct<start:bigint,end:bigint,value:string>>")
    work = work.withColumn(words_col, F.exists(words, possible))
    strings = F.filter(spans(text, CANDIDATE), lambda s: possible(s["value"]))
    work = work.withColumn(column["random"], F.when(F.col(words_col), found_in(strings, F.col(taken_col), (BLOCK * BLOCK, BLOCK))).otherwise(none))
    named = [_named(column[k], k, i) for i, k in enumerate(order)]
    sorted_ = F.transform(F.array_sort(F.concat(*named)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return work.withColumn(f"{prefix}spans", sorted_).drop(taken_col, words_col, *columns)


def joined(found: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", prefix: str = "secret_", mark: str = "[secret]") -> DataFrame:
    """Replace every span by ``mark``; spans that touch or overlap become one mark."""
    text, found = F.col(text_col), F.col(f"{prefix}spans")
    part = lambda x, start, end: F.substr(x, (start + 1).cast("int"), (end - start).cast("int"))

    def pieces(b: Column) -> Column:
        """What stands before each span of a block, and its mark; cut from the block's own part of the text."""
        at, end = F.get(b, F.lit(0))["at"], F.get(b, F.size(b) - 1)["start"]
        first = lambda s: (s["at"] == 0) & (s["start"] == 0)
        cut = lambda own, s: F.when(s["start"] > s["at"], F.concat(part(own, s["at"] - at, s["start"] - at), F.lit(mark)))
        return _let(part(text, at, end), lambda own: F.array_join(F.transform(b, lambda s: cut(own, s).when(first(s), F.lit(mark)).otherwise(F.lit(""))), ""))

    ends = _before(F.transform(found, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    placed = F.zip_with(found, ends, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start")))
    rest = F.substr(text, (F.array_max(F.transform(found, lambda s: s["end"])) + 1).cast("int"), F.length(text))
    clean = F.concat(F.array_join(F.transform(_blocks(placed), pieces), ""), rest)
    return docs.withColumn(text_col, F.when(F.size(found) > 0, clean).otherwise(text))
