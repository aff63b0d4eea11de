"""Search, text and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import lexicon
from ..operators import chunking, joins, search, vectors
from ..plans import kpis
from .registry import add_cte, query, sentiment_sql

W = r"[^\p{L}\p{N}_]"


@query("X01_product_search", """SELECT id, sku, name, price FROM r_products WHERE name ILIKE '%gizmo%' OR description ILIKE '%gizmo%' ORDER BY id LIMIT 10""")
def _(t):
    return search.search_products(t.products, "gizmo").select("id", "sku", "name", "price")


@query("X02_smart_filter", """SELECT id, name, category, price, stock FROM r_products WHERE (name ILIKE '%red%' OR description ILIKE '%red%') AND category = 'ECONOMY'
    AND price >= 910 AND price <= 990 AND stock <> 0 ORDER BY id LIMIT 20""")
def _(t):
    return search.smart_filter(t.products, "red", "ECONOMY", 910, 990, True).select("id", "name", "category", "price", "stock")


TOKENS = ["red-widget economy", "small ring", "Brand#2 gear"]


add_cte("s_hay", "SELECT *, lower(name || ' ' || category || ' ' || description) AS hay FROM r_products")


def asked(t, sql_like: list[str], made):
    """A query table: fixed queries and those made from a column expression over the products."""
    fixed = t.spark.createDataFrame([(q,) for q in sql_like], "query string")
    return t.products.select(made.alias("query")).unionByName(fixed).distinct()


@query("X03_token_match", f"""WITH q AS (SELECT name AS query FROM r_products UNION SELECT unnest({TOKENS})),
    t AS (SELECT query, unnest(string_split(trim(regexp_replace(lower(query), '[-_\\s]+', ' ', 'g')), ' ')) AS term FROM q),
    h AS (SELECT query, id, name, price, (2 * count(*))::int AS score FROM t JOIN s_hay ON contains(hay, term) WHERE term <> '' GROUP BY 1, 2, 3, 4)
    SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, price, id)::int AS rank FROM h QUALIFY rank <= 6""")
def _(t):
    return search.token_match(t.products, asked(t, TOKENS, F.col("name")))


WISHES = ["red watch under 950", "blue widget below 920", "small gear", "women tops less 1,200", "₹930 ring", "gizmo under 0"]


@query("X04_attribute_match", f"""WITH q AS (SELECT name || ' under ' || (900 + 10 * (id % 10)) AS query FROM r_products UNION SELECT unnest({WISHES})),
    l AS (SELECT query, lower(query) AS low, regexp_replace(lower(query), '[₹,]', '', 'g') AS plain FROM q),
    p AS (SELECT query, low, list_filter({fv.COLOURS}, lambda c: contains(low, c))[1] AS colour, regexp_replace(list_filter({fv.GARMENTS}, lambda g: contains(low, g))[1], 's+$', '') AS garment,
        nullif(coalesce(try_cast(regexp_extract(plain, '(?:^|\\s)(?:under|below|less)\\s+(\\d+(?:\\.\\d+)?)(?:\\s|$)', 1) AS double),
        try_cast(regexp_replace(regexp_extract(plain, '(\\S*\\d\\S*)', 1), '[^0-9]', '', 'g') AS double)), 0) AS cap, list_filter(regexp_split_to_array(low, '\\s+'), lambda w: w <> '') AS words FROM l),
    h AS (SELECT query, id, name, price, (2 * len(list_filter(words, lambda w: contains(hay, w))) + CASE WHEN colour IS NULL THEN 0 ELSE 4 END + CASE WHEN garment IS NULL THEN 0 ELSE 4 END
        + 3 * (contains(low, 'men') AND contains(hay, 'men'))::int + 3 * (contains(low, 'women') AND contains(hay, 'women'))::int)::int AS score
        FROM p JOIN s_hay ON (colour IS NULL OR contains(hay, colour)) AND (garment IS NULL OR contains(hay, garment)) AND (cap IS NULL OR price <= cap))
    SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, price, id)::int AS rank FROM h QUALIFY rank <= 6""")
def _(t):
    made = F.concat("name", F.lit(" under "), (900 + 10 * (F.col("id") % 10)).cast("string"))
    return search.attribute_match(t.products, asked(t, WISHES, made))


TERMS = ["the one", "license", "ation"]
add_cte("s_docs", "SELECT *, lower(text) AS low FROM r_documents WHERE status IN ('processed', 'indexed')")
add_cte("s_asked", f"""SELECT unnest({TERMS}) AS query UNION SELECT word FROM (SELECT word, count(*) AS n FROM s_words WHERE regexp_full_match(word, '[a-z]{{4,}}') GROUP BY 1 ORDER BY n DESC, word LIMIT 100)""")
PLAIN_COUNT = "((length(low) - length(replace(low, term, ''))) // length(term))"
add_cte("s_found", f"""SELECT *, CASE match_type WHEN 'word' THEN length(regexp_extract(low, '(?s)^((?:.*?{W})??)' || term || '(?:{W}|$)', 1)) + 1 ELSE instr(low, term) END AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY query ORDER BY match_count DESC, document_id) AS rank FROM (
    SELECT document_id, filename, document_type, text, low, query, term, CASE WHEN contains(term, ' ') OR words = 0 THEN {PLAIN_COUNT} ELSE words END AS match_count,
        CASE WHEN contains(term, ' ') THEN 'phrase' WHEN words > 0 THEN 'word' ELSE 'substring' END AS match_type
    FROM (SELECT d.*, query, lower(query) AS term, len(list_filter(regexp_split_to_array(low, '{W}+'), lambda w: w = lower(query))) AS words FROM s_docs d JOIN s_asked ON contains(low, lower(query)))) QUALIFY rank <= 10)""")


def document_queries(t):
    fixed = t.spark.createDataFrame([(q,) for q in TERMS], "query string")
    return search.top_keywords(t.documents, 100).select(F.col("word").alias("query")).unionByName(fixed)


add_cte("s_matches", f"""SELECT *, CASE match_type WHEN 'word' THEN list_filter(range(1, length(low) - length(term) + 2), lambda i: substr(low, i, length(term)) = term
        AND NOT (i > 1 AND regexp_full_match(substr(low, i - 1, 1), '[\\p{{L}}\\p{{N}}_]')) AND NOT regexp_full_match(substr(low, i + length(term), 1), '[\\p{{L}}\\p{{N}}_]'))
    ELSE list_transform(range(1, len(parts)), lambda i: cast(list_sum(list_transform(parts[1:i], lambda p: length(p))) AS bigint) + (i - 1) * length(term) + 1) END AS places
    FROM (SELECT *, string_split(low, term) AS parts FROM s_found)""")
AROUND = "replace(substr(text, greatest(p - 150, 1), p + length(query) + 150 - greatest(p - 150, 1)), chr(10), ' ')"


@query("X05_search_documents", f"""SELECT document_id, filename, document_type, query, match_count::int AS match_count, match_type, position::int AS position, rank::int AS rank, s AS snippet,
    regexp_replace(s, '(' || query || ')', '<mark>\\1</mark>', 'gi') AS highlighted, md5(array_to_string(list_transform(places, lambda p: p || ':' || {AROUND}), '|')) AS matches FROM (SELECT *,
    {AROUND.replace("p +", "position +").replace("p -", "position -")} AS s FROM s_matches)""")
def _(t):
    found = search.search_documents(t.documents, document_queries(t))
    return found.withColumn("matches", F.md5(F.array_join(F.transform("matches", lambda m: F.concat(m["position"].cast("string"), F.lit(":"), m["snippet"])), "|")))


@query("X05_match_positions", """WITH p AS (SELECT document_id, string_split(lower(text), 'license') AS parts FROM r_documents), l AS (SELECT document_id, len(parts) AS n, unnest(range(len(parts))) AS match_no, unnest(parts) AS part FROM p)
    SELECT document_id, match_no::int AS match_no, (sum(length(part)) OVER (PARTITION BY document_id ORDER BY match_no) + match_no * 7 + 1)::bigint AS position FROM l QUALIFY match_no < n - 1""")
def _(t):
    return search.match_positions(t.documents, "license")


add_cte("s_lines", "SELECT document_id, unnest(range(len(l))) AS i, unnest(l) AS line, l FROM (SELECT document_id, string_split(text, chr(10)) AS l FROM r_documents)")


@query("X06_line_context_search", """SELECT document_id, count(*)::int AS matching_lines, string_agg(array_to_string(l[greatest(i - 2, 0) + 1 : i + 3], chr(10)), '|' ORDER BY i) FILTER (rn <= 3) AS snippets
    FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY i) AS rn FROM s_lines WHERE contains(lower(line), 'license')) GROUP BY 1""")
def _(t):
    return search.line_context_search(t.documents, "license").withColumn("snippets", F.array_join("snippets", "|"))


add_cte("s_words", f"SELECT document_id, unnest(regexp_split_to_array(lower(text), '{W}+')) AS word FROM r_documents")


@query("X07_top_keywords", """SELECT word, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, word)::int AS rank FROM s_words WHERE regexp_full_match(word, '[a-z]{4,}') GROUP BY 1 QUALIFY rank <= 20""")
def _(t):
    return search.top_keywords(t.documents, 20)


@query("X07_document_keywords", """SELECT document_id, word, count(*) AS count, row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, word)::int AS rank FROM s_words
    WHERE regexp_full_match(word, '[a-z]{4,}') GROUP BY 1, 2 QUALIFY rank <= 5""")
def _(t):
    return search.top_keywords(t.documents, 5, "document_id")


@query("X07_keyword_totals", """SELECT document_id, count(*) FILTER (regexp_full_match(word, '[a-z]{4,}'))::int AS total_words, count(DISTINCT word) FILTER (regexp_full_match(word, '[a-z]{4,}'))::int AS unique_words FROM s_words GROUP BY 1""")
def _(t):
    return search.keyword_totals(t.documents, "document_id")


@query("X08_review_sentiment", """SELECT id, sentiment, CASE sentiment WHEN 'positive' THEN 0.75::double WHEN 'negative' THEN 0.05::double ELSE 0.33::double END AS positive_score FROM r_reviews""")
def _(t):
    scores = lexicon.sentiment_scores("sentiment")
    return t.reviews.select("id", "sentiment", F.element_at(scores, "positive").alias("positive_score"))


@query("X09_chat_sentiment", f"""SELECT conv_id AS id, {sentiment_sql('issue', fv.CHAT_POSITIVE, fv.CHAT_NEGATIVE)} AS sentiment FROM r_said""")
def _(t):
    return t.tickets.select("id", lexicon.chat_sentiment("issue").alias("sentiment"))


@query("X10_intent", """SELECT id, CASE WHEN contains(lower(issue), 'order') OR contains(lower(issue), 'track') THEN 'order_support' WHEN contains(lower(issue), 'product') OR contains(lower(issue), 'size')
    OR contains(lower(issue), 'price') THEN 'product_support' ELSE 'general_support' END AS intent FROM r_tickets""")
def _(t):
    return t.tickets.select("id", lexicon.intent("issue").alias("intent"))


@query("X11_extract_refs", """WITH w AS (SELECT id, list_transform(regexp_split_to_array(replace(issue, '#', ' '), '\\s+'), lambda x: trim(upper(x), '.,')) AS l FROM r_tickets),
    r AS (SELECT id, list_filter(l, lambda x: starts_with(x, 'ORD') OR starts_with(x, 'TRK'))[1] AS order_ref, list_filter(l, lambda x: starts_with(x, 'TKT'))[1] AS ticket_ref FROM w)
    SELECT r.id, r.order_ref, r.ticket_ref, o.id AS order_id, t.id AS ticket_id FROM r LEFT JOIN r_orders o ON r.order_ref = o.order_number OR r.order_ref = o.tracking_id LEFT JOIN r_tickets t ON r.ticket_ref = t.ticket_number""")
def _(t):
    refs = search.extract_refs(t.tickets.select("id", "issue"), "issue").drop("issue")
    return search.resolve_refs(refs, t.orders, t.tickets)


CLEAN = r"trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s.!?-]', ' ', 'g'))"


@query("X12_clean_text", f"SELECT document_id, {CLEAN} AS cleaned FROM r_documents")
def _(t):
    return t.documents.select("document_id", chunking.clean_text("text").alias("cleaned"))


add_cte("s_sent0", f"SELECT document_id, string_split(regexp_replace({CLEAN}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM r_documents")
add_cte("s_sent", "SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i) AS i, len(list_filter(string_split(s, ' '), lambda x: x <> '')) AS w, s FROM (SELECT document_id, unnest(range(len(parts))) AS i, unnest(parts) AS s FROM s_sent0)")


@query("X13_chunk_sentences", """WITH RECURSIVE f AS (SELECT document_id, i, w AS len, 0 AS chunk FROM s_sent WHERE i = 1 UNION ALL
    SELECT s.document_id, s.i, CASE WHEN f.len + s.w > 40 THEN s.w ELSE f.len + s.w END, CASE WHEN f.len + s.w > 40 THEN f.chunk + 1 ELSE f.chunk END
    FROM f JOIN s_sent s ON f.document_id = s.document_id AND s.i = f.i + 1)
    SELECT f.document_id, f.chunk::int AS chunk_index, count(*)::int AS chunk_size, sum(s.w)::int AS word_count,
    substr(md5(f.document_id || '_' || f.chunk || '_' || substr(string_agg(s.s, ' ' ORDER BY f.i), 1, 100)), 1, 16) AS chunk_id FROM f JOIN s_sent s ON f.document_id = s.document_id AND f.i = s.i GROUP BY f.document_id, f.chunk""")
def _(t):
    return chunking.chunk_sentences(t.documents, "document_id", size=40, overlap=0).drop("chunk_text")


add_cte("s_sent_sums", """SELECT *, min(i) OVER (PARTITION BY document_id ORDER BY before RANGE BETWEEN 50 PRECEDING AND CURRENT ROW) AS low
    FROM (SELECT *, (sum(w) OVER (PARTITION BY document_id ORDER BY i) - w)::bigint AS before FROM s_sent)""")


def overlapping(first, size):
    """SQL of chunks of ``size`` words in which a chunk that ends before sentence i is followed by one from sentence ``first`` on."""
    return f"""WITH RECURSIVE f AS (SELECT document_id, i, i AS start, before, w AS len, 0 AS chunk FROM s_sent_sums WHERE i = 1 UNION ALL
    SELECT document_id, i, start, before, CASE WHEN closed THEN before - from_ + w ELSE len + w END, CASE WHEN closed THEN chunk + 1 ELSE chunk END FROM (
        SELECT n.*, b.before AS from_ FROM (SELECT s.document_id, s.i, s.before, s.w, f.len, f.chunk, f.len + s.w > {size} AS closed, CASE WHEN f.len + s.w > {size} THEN {first} ELSE f.start END AS start
            FROM f JOIN s_sent_sums s ON f.document_id = s.document_id AND s.i = f.i + 1) n JOIN s_sent_sums b ON b.document_id = n.document_id AND b.i = n.start)),
    c AS (SELECT document_id, chunk, min(start) AS start, max(i) AS last, max(len) AS len FROM f GROUP BY 1, 2)
    SELECT c.document_id, chunk::int AS chunk_index, string_agg(s, ' ' ORDER BY i) AS chunk_text, (last - start + 1)::int AS chunk_size, len::int AS word_count,
    substr(md5(c.document_id || '_' || chunk || '_' || substr(string_agg(s, ' ' ORDER BY i), 1, 100)), 1, 16) AS chunk_id
    FROM c JOIN s_sent ON s_sent.document_id = c.document_id AND i BETWEEN start AND last GROUP BY c.document_id, chunk, start, last, len"""


@query("X13_chunk_overlap_words", overlapping("greatest(f.start + 1, s.low)", 512))
def _(t):
    return chunking.chunk_sentences(t.documents, "document_id", size=512, overlap=50)


@query("X13_chunk_overlap_sentences", overlapping("greatest(f.start, s.i - 5)", 512))
def _(t):
    return chunking.chunk_sentences(t.documents, "document_id", size=512, overlap=5, overlap_sentences=True)


add_cte("s_word_lists", "SELECT document_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM r_documents")


@query("X14_chunk_words", """WITH RECURSIVE word AS (SELECT document_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM s_word_lists),
    e AS (SELECT document_id, i, sum(length(x) + 1) OVER (PARTITION BY document_id ORDER BY i)::bigint AS upto FROM word),
    l AS (SELECT document_id, list(upto ORDER BY i) AS ends, count(*) AS n FROM e GROUP BY 1),
    c AS (SELECT document_id, ends, n, 0::bigint AS start, 0::bigint AS closed, NULL::bigint AS reach, -1 AS k FROM l
        UNION ALL SELECT document_id, ends, n, CASE WHEN reach IS NULL THEN start ELSE greatest(start, reach - 50) END, coalesce(reach, 0),
        greatest(coalesce(reach, 0) + 1, len(list_filter(ends, lambda x: x < 500 + CASE WHEN (CASE WHEN reach IS NULL THEN start ELSE greatest(start, reach - 50) END) = 0 THEN 0
            ELSE ends[CASE WHEN reach IS NULL THEN start ELSE greatest(start, reach - 50) END] END)) + 1), k + 1
        FROM c WHERE closed < n AND (reach IS NULL OR reach <= n) AND k < n),
    spans AS (SELECT document_id, k, start, least(reach, n) AS stop FROM c WHERE k >= 0 AND start < n)
    SELECT s.document_id, k::int AS chunk_index, length(array_to_string(w[start + 1:stop], ' '))::int AS chars, md5(array_to_string(w[start + 1:stop], ' ')) AS digest
    FROM spans s JOIN s_word_lists USING (document_id)""")
def _(t):
    chunks = chunking.chunk_words(t.documents, "document_id")
    return chunks.select("document_id", "chunk_index", F.length("chunk_text").alias("chars"), F.md5("chunk_text").alias("digest"))


@query("X15_chunk_fixed", """SELECT document_id, i::int AS chunk_index, md5(substr(text, i * 800 + 1, 800)) AS digest, document_id || '-' || i AS chunk_id FROM (SELECT document_id, text,
    unnest(range((length(text) + 799) // 800)) AS i FROM r_documents)""")
def _(t):
    return chunking.chunk_fixed(t.documents, "document_id").select("document_id", "chunk_index", F.md5("chunk_text").alias("digest"), "chunk_id")


add_cte("s_centroid", """SELECT label::bigint AS query_id, list(m ORDER BY pos) AS q FROM (SELECT label, pos, avg(x::double) AS m FROM (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1""")
add_cte("s_sims", """SELECT query_id, vec_id AS vector_id, round(list_dot_product(q, embedding::double[]) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(embedding::double[], embedding::double[]))), 6) AS similarity, label FROM s_centroid, embeddings""")


@query("X16_vector_topk", "SELECT query_id, vector_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vector_id)::int AS rank FROM s_sims QUALIFY rank <= 5")
def _(t):
    return vectors.vector_topk(vectors.label_centroids(t.vectors), t.vectors, 5)


@query("X17_merged_search", """SELECT query_id, collection, vector_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, collection, vector_id)::int AS rank
    FROM (SELECT *, CASE WHEN label < 5 THEN 'documents' ELSE 'products' END AS collection FROM s_sims) QUALIFY rank <= 5""")
def _(t):
    queries = vectors.label_centroids(t.vectors)
    parts = []
    for name, cond in (("documents", "label < 5"), ("products", "label >= 5")):
        parts.append(vectors.vector_topk(queries, t.vectors.filter(cond), 5).withColumn("collection", F.lit(name)))
    return vectors.merged_search(parts, 5)


@query("X18_chunk_inventory", "SELECT document_id, (length(text) + 799) // 800 AS total_chunks FROM r_documents WHERE length(text) > 0")
def _(t):
    return search.chunk_inventory(chunking.chunk_fixed(t.documents, "document_id"), "document_id")


add_cte("s_chunks", "SELECT document_id, unnest(range((length(text) + 799) // 800)) AS i, status FROM r_documents")


@query("U04_new_chunks", "SELECT document_id, document_id || '-' || i AS chunk_id FROM s_chunks WHERE status <> 'indexed'")
def _(t):
    chunks = chunking.chunk_fixed(t.documents, "document_id").select("document_id", "chunk_id")
    indexed = chunking.chunk_fixed(t.documents.filter("status = 'indexed'"), "document_id").select("chunk_id")
    return joins.new_rows(chunks, indexed, ["chunk_id"])


@query("X20_valid_reviews", """SELECT id, CASE WHEN rating NOT BETWEEN 1 AND 5 THEN 'Rating must be between 1 and 5' WHEN length(trim(review_text)) < 5 THEN 'Review text must be at least 5 characters'
    WHEN length(review_text) > 1000 THEN 'Review text must not exceed 1000 characters' ELSE 'ok' END AS outcome FROM r_reviews""")
def _(t):
    good, bad = search.valid_reviews(t.reviews)
    return good.select("id", F.lit("ok").alias("outcome")).unionByName(bad.select("id", F.col("reason").alias("outcome")))


@query("X21_conversation_context", """SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) AS context FROM (SELECT * FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5) GROUP BY 1""")
def _(t):
    return search.conversation_context(t.raw("conversations"))


@query("X22_collection_stats", """SELECT document_type, count(*) AS documents, count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'indexed') AS indexed FROM r_documents GROUP BY 1""")
def _(t):
    return kpis.collection_stats(t.documents)


@query("X23_search_summary", f"""SELECT query, count(*) AS document_count, sum(match_count)::bigint AS total_matches, string_agg(DISTINCT document_type, ',' ORDER BY document_type) AS document_types, string_agg(CASE WHEN rank <= 10 THEN substr(s, 1, 200) END, '|' ORDER BY rank) AS snippets,
    printf('Found ''%s'' in %d document(s) with %d total matches.', query, count(*), sum(match_count)::bigint) AS summary FROM (SELECT *, {AROUND.replace("p +", "position +").replace("p -", "position -")} AS s FROM s_found) GROUP BY query""")
def _(t):
    pack = search.search_summary(search.search_documents(t.documents, document_queries(t)))
    return pack.withColumn("document_types", F.array_join("document_types", ",")).withColumn("snippets", F.array_join("snippets", "|"))


@query("E06_series_digest", "SELECT document_id, md5(text) AS digest FROM r_documents")
def _(t):
    return t.documents.select("document_id", F.md5("text").alias("digest"))
