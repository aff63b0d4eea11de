"""Queries of the operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from . import divergence, embedding_join, fingerprints, html_blocks, jaccard_join, language_id, manifest, mixing, packing, quality, secret_scan, sharding, token_counts
from .common import settle, text_or_empty

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: A document is kept when its score reaches this.
LEAST_SCORE = 0.3


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def quality_model(spark: SparkSession, root: str) -> quality.Model:
    """The production model: fitted on the labels of rows that are not held out."""
    docs, labels = _table(spark, root, "documents"), _table(spark, root, "labels")
    return quality.train(docs, labels.filter(~quality.held_out(F.col("doc_id"))))


def op1_quality(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents").select("doc_id", "text")
    scored = quality.score_documents(docs, quality_model(spark, root))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))


def op2_mixture(spark: SparkSession, root: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, root, "documents"))
    taken = (F.col("mix_copies") * F.col("mix_size")).alias("taken")
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken)


def op3_token_totals(spark: SparkSession, root: str) -> DataFrame:
    """Three batches: all documents by words; English ones revised to pieces of words; copies taken out. The second is sent twice."""
    docs = _table(spark, root, "documents")
    text = text_or_empty(docs)
    counts = docs.select(
        "doc_id", "source", "lang", mixing.word_count(text).alias("words"), F.regexp_count(text, F.lit("[A-Za-z]+|[0-9]+|[^A-Za-z0-9\\x20\\x09-\\x0D]")).cast("long").alias("pieces"),
        F.sha2(text, 256).alias("text"),
    )
    counts = settle(counts, "counts")
    # The first row of each text: the smallest id, null ids last. Rows of a text meet as one row of each task.
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "source", "lang", "words", "pieces"))
    firsts = counts.groupBy("text").agg(first.alias("f")).select("f.*")

    def by(rows: DataFrame, count: str, tokenizer: str) -> DataFrame:
        return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(count).alias("tokens"))

    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    totals = token_counts.TokenRollup(spark, shared_dir(spark, "token-totals"))
    totals.commit(1, added=by(counts, "words", "words"))
    for _ in range(2):
        totals.commit(2, added=by(counts.filter(english), "pieces", "pieces"), removed=by(counts.filter(english), "words", "words"))

    def both(rows: DataFrame) -> DataFrame:
        return by(rows.filter(english), "pieces", "pieces").unionByName(by(rows.filter(~english), "words", "words"))

    # All rows leave and the first ones come back, so copies are never joined with their texts.
    totals.commit(3, added=both(firsts), removed=both(counts))
    return totals.totals()


def op4_main_text(spark: SparkSession, root: str) -> DataFrame:
    pages = html_blocks.extract_pages(_table(spark, root, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_secrets(spark: SparkSession, root: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, root, "documents").select("doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["kind"] != "random")
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in secret_scan.KINDS], F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("secret_spans")).alias("spans"))


def op6_near_vectors(spark: SparkSession, root: str) -> DataFrame:
    return embedding_join.near_vectors(_table(spark, root, "embeddings"))


def op7_shingle_groups(spark: SparkSession, root: str) -> DataFrame:
    return jaccard_join.similar_groups(_table(spark, root, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_shards(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(text_or_empty(docs)))
    placed = sharding.shard_documents(docs)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    return fingerprints.compare_along(_table(spark, root, "documents"))


def op10_sequences(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack_documents(_table(spark, root, "documents"), TOKENIZER, with_ids=False)


def op11_divergence(spark: SparkSession, root: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, root, "documents"))


def op12_manifest(spark: SparkSession, root: str) -> DataFrame:
    return manifest.build_manifest(_table(spark, root, "documents"))


def language_model(spark: SparkSession, root: str) -> language_id.Model:
    """The production model: learned from rows that are not held out."""
    docs = _table(spark, root, "documents")
    return language_id.train(docs.filter(~quality.held_out(F.col("doc_id"))))


def op13_languages(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents").select("doc_id", "text")
    told = language_id.predict(docs, language_model(spark, root))
    return told.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_mixture, op3_token_totals, op4_main_text, op5_secrets, op6_near_vectors, op7_shingle_groups, op8_shards, op9_fingerprints, op10_sequences, op11_divergence, op12_manifest, op13_languages)
}

_COMPONENTS = """edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, e.y FROM reach r JOIN edges e ON e.x = r.b),
    named AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY 1)"""



def _leaf_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}) || ':' || {x} END"


_LEAF_START = " || ".join(_leaf_sql(f"cast({c} AS varchar)") for c in manifest.FIELDS[:-1])
_CRC32 = """xor(4294967295, list_reduce(list_transform(range(1, strlen(cast(doc_id AS varchar)) + 1), lambda i: cast(ascii(cast(doc_id AS varchar)[i]) AS bigint)),
            lambda c, x: list_reduce(range(8), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)), xor(c, x)), 4294967295))"""

SQL: dict[str, str] = {
    "op3_token_totals": r"""WITH t AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
        u AS (SELECT source, lang, CASE WHEN lang = 'en' THEN 'pieces' ELSE 'words' END AS tokenizer, CASE WHEN lang = 'en'
            THEN len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS n
            FROM t QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)
        SELECT source, lang, tokenizer, count(*) AS documents, cast(sum(n) AS bigint) AS tokens FROM u GROUP BY 1, 2, 3""",
    "op6_near_vectors": f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id, cast(embedding AS double[]) AS e FROM embeddings),
        links AS (SELECT a.id AS x, b.id AS y FROM nodes a JOIN nodes b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.9), {_COMPONENTS}
        SELECT n.id AS vec_id, (SELECT count(*) FROM edges WHERE x = n.id) AS n_links, component_id, n.id = component_id AS kept FROM nodes n JOIN named USING (id)""",
    "op7_shingle_groups": rf"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w FROM documents),
        nodes AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        s AS (SELECT id, len(s) AS n, unnest(s) AS s FROM nodes),
        links AS (SELECT a.id AS x, b.id AS y FROM s a JOIN s b ON a.s = b.s AND a.id < b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
            GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))), {_COMPONENTS}
        SELECT n.id AS doc_id, cast(len(s) AS bigint) AS n_shingles, component_id FROM nodes n JOIN named USING (id)""",
    "op11_divergence": r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
        c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
        v AS (SELECT lang, count(*) AS v, sum(total) AS nl FROM kept GROUP BY 1),
        s AS (SELECT lang, source, sum(n) AS ng FROM c GROUP BY 1, 2),
        g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(nl, 0) AS nl, coalesce(ng, 0) AS ng
            FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN s USING (lang, source)),
        p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 1)) // (ng + v) AS p,
            1 + (1000000000 * (total + 1)) // (nl + v) AS q FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
        rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, cast(value AS bigint) AS value, cast(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS int) AS rank
        FROM rows QUALIFY part = 'pair' OR rank <= 200""",
    "op12_manifest": f"""WITH RECURSIVE d AS (SELECT doc_id, lang, {_LEAF_START} || {_leaf_sql('text')} AS own,
            {_LEAF_START} || {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low, {_CRC32} AS crc FROM documents),
        leaves AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS lang, sha256(own) AS h, CASE WHEN crc % 3 = 0 THEN sha256(low) ELSE sha256(own) END AS t FROM d),
        up(k, lang, i, n, h) AS (SELECT 0, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h, r) - 1, count(*) OVER (PARTITION BY lang), h FROM leaves
            UNION ALL SELECT k + 1, lang, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY k, lang, i // 8, (n + 7) // 8),
        subroots AS (SELECT lang, h FROM up WHERE n = 1),
        top(k, lang, i, n, h) AS (SELECT 0, lang, row_number() OVER (ORDER BY lang) - 1, count(*) OVER (), h FROM subroots
            UNION ALL SELECT k + 1, '', i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY k, i // 8, (n + 7) // 8),
        sides AS (SELECT *, coalesce(string_agg(h, '') OVER (PARTITION BY part, k, lang, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
            coalesce(string_agg(h, '') OVER (PARTITION BY part, k, lang, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
            FROM (SELECT 0 AS part, * FROM up WHERE n > 1 UNION ALL SELECT 1, k, '', i, n, h FROM top WHERE n > 1)),
        walk(r, lang, k, i, n, f, sib) AS (SELECT r, lang, 0, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h, r) - 1, count(*) OVER (PARTITION BY lang), t, '' FROM leaves
            UNION ALL SELECT w.r, w.lang, w.k + 1, w.i // 8, (w.n + 7) // 8, sha256(a || f || b), sib || a || b FROM walk w JOIN sides s ON part = 0 AND s.k = w.k AND s.lang = w.lang AND s.i = w.i),
        climb(r, k, i, n, f, sib) AS (SELECT r, 0, top.i, top.n, f, sib FROM walk w JOIN top ON top.k = 0 AND top.lang = w.lang WHERE w.n = 1
            UNION ALL SELECT c.r, c.k + 1, c.i // 8, (c.n + 7) // 8, sha256(a || f || b), sib || a || b FROM climb c JOIN sides s ON part = 1 AND s.k = c.k AND s.i = c.i)
        SELECT doc_id, leaves.h AS leaf, subroots.h AS subroot, top.h AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = top.h AS verified
        FROM leaves JOIN climb USING (r) JOIN subroots USING (lang), top WHERE climb.n = 1 AND top.n = 1""",
}
