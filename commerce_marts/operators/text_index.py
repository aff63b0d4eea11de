"""An inverted index over texts: postings of tokens, and the tokens that hold a search term.

A token is a run of letters, digits and underscores, or a run of other characters that are not all white
space. Postings have one row for each block of texts and distinct token, with the block's texts that hold it and
its count in each. Most tokens of a text are in others too, so there are far fewer such rows than pairs of text and
token, and the pairs are made for the asked tokens only. A search term
without a blank lies inside one token, so it is looked for in the vocabulary only: each term meets the tokens that
share its rarest trigram, and the tokens that hold it lead to the texts by an equality join. A term of several
tokens is looked up by its words; only texts that hold all of these are read to count it.

Work grows with the postings of the asked terms, not with terms times texts. Texts are compared in
lower case; terms are expected in lower case.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import as_col
from ..session import cut_lineage, dealt

WORD_CHARS = r"\p{L}\p{N}_"
#: Words, and runs of other characters with at least one that is no white space.
TOKEN = re.compile(r"\w+|\s*[^\w\s][^\w]*")
#: Characters of the keys under which the vocabulary is found; shorter terms use keys of their own length.
GRAM = 3
#: Pairs of text and token that end a block.
PAIRS = 300_000


def quoted(term: Column) -> Column:
    return F.regexp_replace(term, r"([^\w\s])", r"\\$1")


def word_pattern(term: Column) -> Column:
    """Whole-word pattern that treats every letter and digit of any script as part of a word."""
    return F.concat(F.lit(f"(?<![{WORD_CHARS}])"), quoted(term), F.lit(f"(?![{WORD_CHARS}])"))


def plain_count(text: Column, term: Column) -> Column:
    """How often a text holds a term, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text that has as many."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, texts) of each block of texts, ``texts`` being (id, n) of those that hold the token."""

    def block(ids: pa.Array, texts: list[int], sizes: list[int], tokens: list[str], counts: list[int]) -> pa.RecordBatch:
        words = pa.array(tokens, pa.string()).dictionary_encode()
        codes = words.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        held = pa.StructArray.from_arrays([ids.take(pa.array(np.repeat(texts, sizes)[order])), pa.array(counts, pa.int64()).take(pa.array(order))], ["id", "n"])
        ends = np.concatenate([[0], np.cumsum(np.bincount(codes))])
        return pa.RecordBatch.from_arrays([words.dictionary, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)], ["token", "texts"])

    for batch in batches:
        ids, texts, sizes, tokens, counts = batch.column(0), [], [], [], []
        for at, text in enumerate(batch.column(1)):
            found = Counter(TOKEN.findall(text.as_py()))
            texts.append(at)
            sizes.append(len(found))
            tokens += found.keys()
            counts += found.values()
            if len(tokens) > PAIRS:
                yield block(ids, texts, sizes, tokens, counts)
                texts, sizes, tokens, counts = [], [], [], []
        if tokens:
            yield block(ids, texts, sizes, tokens, counts)


def _word_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, term, kind, text) with the positions (from 1) of the term among the tokens in place of the text."""
    for batch in batches:
        rows = zip(batch.column(1).to_pylist(), batch.column(3), strict=True)
        places = [[m.start() + 1 for m in TOKEN.finditer(text.as_py()) if m.group() == term] for term, text in rows]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(places, pa.list_(pa.int32()))], ["id", "term", "kind", "positions"])


class TextIndex:
    """Postings and vocabulary of the texts of a frame, stored in the shared folder.

    ``docs`` has one row for each ``id_col``; rows with a null text have no postings.
    """

    def __init__(self, docs: DataFrame, id_col: str, text: str | Column) -> None:
        self.id_col = id_col
        self.docs = docs.select(F.col(id_col).alias("id"), as_col(text).alias("text")).filter("text IS NOT NULL")
        pair = T.StructType([T.StructField("id", self.docs.schema["id"].dataType), T.StructField("n", T.LongType())])
        schema = T.StructType([T.StructField("token", T.StringType()), T.StructField("texts", T.ArrayType(pair))])
        lowered = self.docs.withColumn("text", F.lower("text"))
        self.postings = cut_lineage(dealt(lowered).mapInArrow(_postings, schema), "postings")
        self.vocabulary = cut_lineage(self.postings.select("token").distinct(), "vocabulary")

    def _texts_of(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the texts of their ids; only these are lower-cased."""
        return rows.join(self.docs, "id").withColumn("text", F.lower("text"))

    def _keys(self, size: int) -> DataFrame:
        return self.vocabulary.filter(F.length("token") >= size).select("token", F.explode(grams(F.col("token"), size)).alias("key"))

    def tokens_holding(self, terms: DataFrame) -> DataFrame:
        """(term, token, hits) for the tokens that hold a term; ``terms`` has distinct, filled terms in ``term``.

        The keys of a term are counted in the vocabulary and it is joined by the rarest; a term with a key that
        no token has is found at once to be in none. Of the vocabulary's keys only those of terms are stored.
        """
        sizes = sorted(r[0] for r in terms.select(F.least(F.length("term"), F.lit(GRAM))).distinct().collect())
        found = None
        for size in sizes:
            some = terms.filter(F.length("term") == size) if size < GRAM else terms.filter(F.length("term") >= GRAM)
            keys = some.select("term", F.explode(grams(F.col("term"), size)).alias("key"))
            held = cut_lineage(self._keys(size).join(keys.select("key").distinct(), "key", "left_semi"), "keys")
            common = held.groupBy("key").agg(F.count(F.lit(1)).alias("tokens"))
            rarest = keys.join(common, "key", "left").groupBy("term").agg(F.min_by("key", F.struct(F.coalesce("tokens", F.lit(0)), "key")).alias("key"))
            part = held.join(rarest, "key").filter(F.contains("token", F.col("term"))).select("term", "token")
            found = part if found is None else found.unionByName(part)
        if found is None:
            found = self.vocabulary.limit(0).select(F.col("token").alias("term"), "token")
        return found.withColumn("hits", plain_count(F.col("token"), F.col("term")))

    def counts(self, terms: DataFrame) -> DataFrame:
        """(id, term, words, plain) for every text that holds a term of ``terms`` (column ``term``, better stored).

        ``words`` counts it between characters that belong to no word and is 0 for terms with a blank; ``plain``
        counts all places, not overlapping.
        """
        terms = terms.select("term").filter("term <> ''").distinct()
        word = F.regexp_extract_all("term", F.lit(f"[{WORD_CHARS}]+"), F.lit(0))
        pieces = F.array_distinct(F.when(F.size(word) > 0, word).otherwise(F.array("term")))
        # A term of one word is its own piece; others are met by all their words first and then read.
        parts = terms.select(F.col("term").alias("asked"), _single("term").alias("single"), F.size(pieces).alias("needed"), F.explode(pieces).alias("term"))
        tokens = cut_lineage(self.tokens_holding(parts.select("term").distinct()), "tokens")
        at = tokens.withColumn("whole", F.col("token") == F.col("term")).join(self.postings, "token").select("term", "whole", "hits", F.inline("texts"))
        held = at.groupBy("id", "term").agg(F.sum(F.when(F.col("whole"), F.col("n")).otherwise(0)).alias("words"), F.sum(F.col("n") * F.col("hits")).alias("plain"))
        held = cut_lineage(held, "held")
        single = held.join(parts.filter("single").select("term"), "term").select("id", "term", "words", "plain")
        met = held.select("id", "term").join(parts.filter("NOT single"), "term").groupBy("id", F.col("asked").alias("term"), "needed").agg(F.count(F.lit(1)).alias("met"))
        read = self._texts_of(met.filter("met = needed").select("id", "term"))
        words = F.when(F.contains("term", F.lit(" ")), 0).otherwise(F.regexp_count("text", word_pattern(F.col("term")))).cast("long")
        read = read.select("id", "term", words.alias("words"), plain_count(F.col("text"), F.col("term")).alias("plain")).filter("plain > 0")
        return single.unionByName(read).withColumnRenamed("id", self.id_col)

    def places(self, found: DataFrame) -> DataFrame:
        """All positions (from 1, sorted) of a term in a text: ``found`` (id, term, kind) with ``positions``.

        Kind 'word' means whole words only; other terms count everywhere. The texts of ``found`` are read once and
        stored; those of words are cut into tokens again.
        """
        found = cut_lineage(self._texts_of(found.select(F.col(self.id_col).alias("id"), "term", "kind")), "found")
        known = _single("term") & (F.col("kind") == "word")
        schema = T.StructType([*found.drop("text").schema.fields, T.StructField("positions", T.ArrayType(T.IntegerType()))])
        words = found.filter(known).select("id", "term", "kind", "text").mapInArrow(_word_places, schema).filter(F.size("positions") > 0)
        pattern = F.when(F.col("kind") == "word", word_pattern(F.col("term"))).otherwise(quoted(F.col("term")))
        read = occurrences(found.filter(~known), F.col("text"), F.col("term"), ["id", "term", "kind"], pattern)
        # One list is as long as one text has matches, which is what is asked for.
        read = read.groupBy("id", "term", "kind").agg(F.array_sort(F.collect_list(F.col("position").cast("int"))).alias("positions"))
        return words.unionByName(read).withColumnRenamed("id", self.id_col)


def _single(term: str) -> Column:
    return F.rlike(term, F.lit(f"^[{WORD_CHARS}]+$"))


def occurrences(rows: DataFrame, text: Column, term: Column, keys: list[str], pattern: Column) -> DataFrame:
    """``keys`` and ``position`` (from 1) of each place of a term, not overlapping; keys are unique.

    A place starts where the gaps and places before it end, a running sum over the gaps of one text.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    cut = rows.select(*keys, F.length(term).alias("m_size"), F.posexplode(F.slice(gaps, F.lit(1), F.size(gaps) - 1)).alias("m_no", "m_gap"))
    before = Window.partitionBy(*keys).orderBy("m_no")
    return cut.select(*keys, (F.sum("m_gap").over(before) + F.col("m_no") * F.col("m_size") + 1).alias("position"))
