"""Product and document search, keywords and reference extraction.

Queries come as a table. Their terms meet an inverted index of the texts (``text_index``), so the work grows
with what the terms hold, not with terms times texts.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.money import as_col
from ..session import cut_lineage, dealt
from .filters import any_like
from .onerow import beside
from .ordered import top_n
from .text_index import WORD_CHARS, TextIndex, quoted


def search_products(products: DataFrame, text: str, n: int | None = 10) -> DataFrame:
    """Products whose name or description contains the text, by id."""
    found = products.filter(any_like(["name", "description"], text)).orderBy("id")
    return found.limit(n) if n else found


def smart_filter(products: DataFrame, text: str, category: str | None = None, min_price: float | None = None, max_price: float | None = None, in_stock_only: bool = False, n: int = 20) -> DataFrame:
    """Text search with filters, all applied before the limit."""
    out = products.filter(any_like(["name", "description"], text))
    if category:
        out = out.filter(F.col("category") == category)
    if min_price:
        out = out.filter(F.col("price") >= min_price)
    if max_price:
        out = out.filter(F.col("price") <= max_price)
    if in_stock_only:
        out = out.filter(F.col("stock") != 0)
    return out.orderBy("id").limit(n)


def _hay() -> Column:
    return F.lower(F.concat_ws(" ", "name", "category", "description"))


def _scored(products: DataFrame, terms: DataFrame, carry: list[str], k: int) -> DataFrame:
    """(query, carry, id, name, price, score, met) of the products that can be among the first ``k`` of a query.

    ``terms`` has the points and needs of each query's terms. They depend on the set of asked terms that a product
    holds, so queries meet these sets, not the products. Of products with the same set the cheaper one
    comes first under any price cap, so each set keeps its ``k`` cheapest, and as many without a price.
    """
    named = products.filter("id IS NOT NULL")
    texts = named.groupBy("id").agg(F.array_sort(F.collect_list(_hay())).alias("_texts"))
    classes = cut_lineage(texts.select("_texts").distinct().withColumn("_class", F.monotonically_increasing_id()), "classes")
    index = TextIndex(classes.select("_class", F.explode("_texts").alias("text")), "_class", "text")
    held = index.counts(cut_lineage(terms.select("term").distinct(), "terms")).select("_class", "term")
    marks = cut_lineage(held.groupBy("_class").agg(F.array_sort(F.collect_list("term")).alias("_terms")), "marks")
    rows = named.groupBy("id", "name", "price").agg(F.count(F.lit(1)).alias("_copies"))
    rows = rows.join(texts, "id").join(classes, "_texts").join(marks, "_class").withColumn("_free", F.col("price").isNull())
    heads = top_n(rows.select("_terms", "_copies", "_free", "id", "name", "price"), ["_terms", "_copies", "_free"], [F.asc("price"), F.asc("id")], k)
    sets = marks.select("_terms").distinct().select("_terms", F.explode("_terms").alias("term")).join(terms, "term")
    sets = sets.groupBy("query", *carry, "_terms").agg(F.sum("points").alias("_points"), F.sum("need").alias("_need"))
    score, met = (F.col("_copies") * F.col("_points")).alias("score"), (F.col("_copies") * F.col("_need")).alias("met")
    return sets.join(heads, "_terms").select("query", *carry, "id", "name", "price", score, met)


def _asked(queries: DataFrame) -> DataFrame:
    """The distinct queries, stored: else filters of what is read from a query run on the rows that queries are made of."""
    return cut_lineage(queries.select("query").distinct(), "asked")


def _best(hits: DataFrame, k: int) -> DataFrame:
    ranked = top_n(hits, ["query"], [F.desc("score"), F.asc("price"), F.asc("id")], k, rank="rank")
    return ranked.select("query", "id", "name", "price", F.col("score").cast("int").alias("score"), "rank")


def token_match(products: DataFrame, queries: DataFrame, k: int = 6) -> DataFrame:
    """Two points per token of a query found in name, category or description; ``queries`` has one column ``query``."""
    words = F.split(F.trim(F.regexp_replace(F.lower("query"), r"[-_\s]+", " ")), " ")
    tokens = _asked(queries).select("query", F.explode(words).alias("term")).filter("term <> ''")
    return _best(_scored(products, tokens.withColumns({"points": F.lit(2), "need": F.lit(0)}), [], k), k)


def price_limit(query: str | Column = "query") -> Column:
    """Price cap named in a query: a number right after a word for "up to", else the digits of the first word that has some; NULL for none or 0."""
    plain = F.regexp_replace(F.lower(as_col(query)), "[₹,]", "")
    cue = F.regexp_extract(plain, r"(?:^|\s)(?:under|below|less)\s+(\d+(?:\.\d+)?)(?=\s|$)", 1)
    other = F.regexp_replace(F.regexp_extract(plain, r"(\S*\d\S*)", 1), r"\D", "")
    return F.nullif(F.coalesce(cue.try_cast("double"), other.try_cast("double")), F.lit(0.0))


def _first_named(values: list[str], text: Column) -> Column:
    return F.get(F.filter(F.array(*[F.lit(v) for v in values]), lambda v: F.contains(text, v)), F.lit(0))


def attribute_match(products: DataFrame, queries: DataFrame, k: int = 6) -> DataFrame:
    """Match by colour, garment and price cap with token, attribute and gender points.

    A product must have the garment (in the singular) and the colour that a query names, and cost no
    more than its cap. A query that names neither ranks all products within its cap: those without a
    point follow by price, and only the cheapest ``k`` of these can be among its first.
    """
    low = F.lower("query")
    parsed = _asked(queries).select(
        "query", price_limit().alias("cap"), F.regexp_replace(_first_named(fv.GARMENTS, low), "s+$", "").alias("garment"), _first_named(fv.COLOURS, low).alias("colour"), low.alias("low")
    )
    point = lambda term, points, need: F.struct(term.alias("term"), F.lit(points).alias("points"), F.lit(need).alias("need"))
    tokens = F.transform(F.filter(F.split(F.col("low"), r"\s+"), lambda w: w != ""), lambda w: point(w, 2, 0))
    attributes = F.filter(F.array(point(F.col("garment"), 4, 1), point(F.col("colour"), 4, 1)), lambda x: x["term"].isNotNull())
    genders = F.filter(F.array(*[point(F.lit(g), 3, 0) for g in ("men", "women")]), lambda x: F.contains(F.col("low"), x["term"]))
    parsed = parsed.withColumn("needs", F.size(attributes))
    terms = parsed.select("query", "cap", "needs", F.inline(F.concat(tokens, attributes, genders)))
    scored = _scored(products, terms, ["cap", "needs"], k)
    within = F.col("cap").isNull() | (F.col("price") <= F.col("cap"))
    hits = scored.filter((F.col("met") == F.col("needs")) & within).select("query", "id", "name", "price", "score")
    cheap = products.orderBy("price", "id").limit(k).agg(F.collect_list(F.struct("id", "name", "price")).alias("_cheap"))
    rest = beside(parsed.filter("needs = 0").select("query", "cap"), cheap).select("query", "cap", F.inline("_cheap")).filter(within)
    rest = rest.join(hits.select("query", "id"), ["query", "id"], "left_anti").select("query", "id", "name", "price", F.lit(0).cast("bigint").alias("score"))
    return _best(hits.unionByName(rest), k)


def _snippet(text: Column, position: Column, size: Column, context: int) -> Column:
    start = F.greatest(position - context, F.lit(1))
    return F.replace(F.substr(text, start, position + size + context - start), F.lit("\n"), F.lit(" "))


def search_documents(documents: DataFrame, queries: DataFrame, k: int = 10, context: int = 150, document_type: str | None = None) -> DataFrame:
    """The ``k`` documents with most matches for every row of a query table (one column ``query``).

    A query with a space is searched as a phrase. A single word is searched as a whole word and,
    where a document has none, as a substring. Documents are ranked by their counts alone; the texts
    of the winners are joined back. ``matches`` lists every match with its position (from 1) and
    surroundings; snippet and highlighted show the first one.
    """
    docs = documents.filter(F.col("text").isNotNull() & F.col("status").isin("processed", "indexed"))
    if document_type:
        docs = docs.filter(F.col("document_type") == document_type)
    asked = queries.select(F.trim("query").alias("query")).distinct().withColumn("term", F.lower("query")).filter("term <> ''")
    asked = cut_lineage(asked, "asked")
    index = TextIndex(docs, "document_id", "text")
    kind = F.when(F.contains("term", F.lit(" ")), "phrase").when(F.col("words") > 0, "word").otherwise("substring")
    counted = index.counts(asked).select("document_id", "term", F.when(F.col("words") > 0, F.col("words")).otherwise(F.col("plain")).cast("int").alias("match_count"), kind.alias("kind"))
    best = cut_lineage(top_n(counted.join(asked, "term"), ["query"], [F.desc("match_count"), F.asc("document_id")], k, rank="rank"), "best")
    places = index.places(best.select("document_id", "term", "kind").distinct())
    full = best.join(places, ["document_id", "term", "kind"]).join(docs.select("document_id", "filename", "document_type", "text"), "document_id")
    listed = F.transform("positions", lambda p: F.struct(p.alias("position"), _snippet(F.col("text"), p, F.length("term"), context).alias("snippet")))
    marked = F.regexp_replace(F.col("snippet"), F.concat(F.lit("(?i)("), quoted(F.col("query")), F.lit(")")), F.lit("<mark>$1</mark>"))
    full = full.withColumn("matches", listed).withColumn("snippet", F.get("matches", F.lit(0))["snippet"]).withColumn("highlighted", marked)
    position = F.get("positions", F.lit(0)).alias("position")
    return full.select("document_id", "filename", "document_type", "query", "match_count", F.col("kind").alias("match_type"), position, "rank", "snippet", "highlighted", "matches")


def match_positions(documents: DataFrame, term: str) -> DataFrame:
    """Every non-overlapping occurrence of a term with its position, one row each."""
    parts = F.split(F.lower("text"), re.sub(r"([^\w\s])", r"\\\1", term.lower()), -1)
    cut = documents.select("document_id", F.posexplode(F.transform(parts, F.length)).alias("match_no", "_len"), F.size(parts).alias("_n"))
    w = Window.partitionBy("document_id").orderBy("match_no")
    pos = F.sum("_len").over(w) + F.col("match_no") * len(term) + 1
    return cut.withColumn("position", pos).filter(F.col("match_no") < F.col("_n") - 1).select("document_id", "match_no", "position")


def search_summary(results: DataFrame, per_document: int = 3, overall: int = 10) -> DataFrame:
    """Documents, matches, types and first snippets per query over ranked results (a page per query)."""
    snippets = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "snippet"))), lambda x: F.substr(x["snippet"], F.lit(1), F.lit(200))), 1, overall)
    df = results.groupBy("query").agg(
        F.count(F.lit(1)).alias("document_count"), F.sum("match_count").alias("total_matches"), F.array_sort(F.collect_set("document_type")).alias("document_types"), snippets.alias("snippets")
    )
    text = F.format_string("Found '%s' in %d document(s) with %d total matches.", "query", "document_count", "total_matches")
    return df.withColumn("summary", text)


def line_context_search(documents: DataFrame, query: str, around: int = 2, first: int = 3) -> DataFrame:
    """The first matching lines of each document with the lines around them."""
    lines = F.col("_lines")
    at = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.contains(F.lower(F.get(lines, i)), F.lit(query.lower())))

    def block(i):
        start = F.greatest(i - around, F.lit(0))
        return F.array_join(F.slice(lines, start + 1, i + around + 1 - start), "\n")

    docs = documents.filter(F.contains(F.lower("text"), F.lit(query.lower()))).withColumn("_lines", F.split("text", "\n", -1))
    out = docs.withColumn("_at", at).filter(F.size("_at") > 0)
    return out.select("document_id", F.size("_at").alias("matching_lines"), F.transform(F.slice("_at", 1, first), block).alias("snippets"))


def keyword_words(text: str | Column) -> Column:
    """Runs of four or more ASCII letters that are whole words, lower-cased."""
    # Other words are matched too, so that each match starts at the start of a word.
    words = F.regexp_extract_all(F.lower(as_col(text)), F.lit(f"([a-z]{{4,}}+)(?![{WORD_CHARS}])|[{WORD_CHARS}]++"), F.lit(1))
    return F.array_remove(words, "")


def top_keywords(documents: DataFrame, k: int = 20, key: str | None = None) -> DataFrame:
    """Most frequent words per document (``key``) or of the whole collection."""
    keys = [key] if key else []
    words = dealt(documents.select(*keys, "text")).select(*keys, F.explode(keyword_words("text")).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("count"))
    return top_n(words, keys, [F.desc("count"), F.asc("word")], k, rank="rank")


def keyword_totals(documents: DataFrame, key: str) -> DataFrame:
    words = keyword_words("text")
    return documents.select(key, F.size(words).alias("total_words"), F.size(F.array_distinct(words)).alias("unique_words"))


def extract_refs(df: DataFrame, text: str) -> DataFrame:
    """First order or tracking number and first ticket number mentioned in a text."""
    tokens = F.transform(F.split(F.replace(text, F.lit("#"), F.lit(" ")), r"\s+"), lambda w: F.trim(F.upper(w), F.lit(".,")))

    def first(*prefixes):
        def hit(w):
            return reduce(lambda a, b: a | b, [w.startswith(p) for p in prefixes])

        return F.get(F.filter(tokens, hit), F.lit(0))

    return df.withColumns({"order_ref": first("ORD", "TRK"), "ticket_ref": first("TKT")})


def resolve_refs(refs: DataFrame, orders: DataFrame, tickets: DataFrame) -> DataFrame:
    """Look the extracted references up by order number, tracking id or ticket number."""
    keys = orders.select(F.col("id").alias("order_id"), F.explode(F.array("order_number", "tracking_id")).alias("order_ref"))
    known = tickets.select(F.col("id").alias("ticket_id"), F.col("ticket_number").alias("ticket_ref"))
    return refs.join(keys, "order_ref", "left").join(known, "ticket_ref", "left")


def review_problems() -> Column:
    """Reason a review is rejected, NULL when it is valid."""
    size = F.length(F.trim("review_text"))
    return (
        F.when(F.col("rating").isNull() | ~F.col("rating").between(1, 5), "Rating must be between 1 and 5")
        .when(F.col("review_text").isNull() | (size < 5), "Review text must be at least 5 characters")
        .when(F.length("review_text") > 1000, "Review text must not exceed 1000 characters")
    )


def valid_reviews(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid reviews with trimmed text, and the rejected ones with the reason."""
    marked = reviews.withColumn("reason", review_problems())
    good = marked.filter("reason IS NULL").drop("reason").withColumn("review_text", F.trim("review_text"))
    return good, marked.filter("reason IS NOT NULL")


def conversation_context(messages: DataFrame, n: int = 5, keep: int = 10) -> DataFrame:
    """The last ``n`` of the last ``keep`` messages of each conversation as role-tagged lines."""
    last = top_n(messages, ["conv_id"], [F.desc("turn")], min(n, keep))
    line = F.concat(F.upper("role"), F.lit(": "), "text")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return last.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("context"))


def chunk_inventory(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("total_chunks"))
