import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from commerce_marts.llm import manifest, queries

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """(what remains, for each node what lies beside it on the way up)."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf_no, at in enumerate(where):
            first = at // 8 * 8
            paths[leaf_no].append((nodes[first:at], nodes[at + 1 : first + 8]))
        nodes, where = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [x // 8 for x in where]
    return nodes[0], paths


def brute(rows):
    """Rows of the contract from (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        own = leaf(doc_id, source, lang, n, text)
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        groups[b"" if lang is None else b"=" + lang.encode()].append((doc_id is not None, doc_id or 0, own, leaf(doc_id, source, lang, n, low) if hit else own, doc_id))
    order = sorted(groups)
    trees = [climb([x[2] for x in sorted(groups[g])]) for g in order]
    root, over = climb([t[0] for t in trees]) if trees else (None, [])
    out = []
    for g, (subroot, paths), beyond in zip(order, trees, over, strict=True):
        for (_, _, own, changed, doc_id), path in zip(sorted(groups[g]), paths, strict=True):
            up = changed
            for left, right in path + beyond:
                up = h(*left, up, *right)
            out.append((doc_id, own, subroot, root, h(*[x for a, b in path + beyond for x in a + b]), up, up == root))
    return sorted(out, key=str)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def rows_of(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()]


def test_equals_sql_and_brute_force(spark, documents):
    sql = queries.SQL["op12_manifest"].replace("FROM documents)", f"FROM '{ROOT}/documents.parquet')")
    want = sorted(duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM ({sql})").fetchall(), key=str)
    mine = got(queries.op12_manifest(spark, ROOT))
    assert mine == want == brute(rows_of(documents))
    assert {r[-1] for r in mine} == {True, False}


def test_odd_rows(odd):
    mine = got(manifest.build_manifest(odd))
    assert mine == brute(rows_of(odd)) and len(mine) == 12
    assert manifest.build_manifest(odd.limit(0)).count() == 0
    one = odd.filter("doc_id = 4")
    assert got(manifest.build_manifest(one)) == brute(rows_of(one))


@pytest.mark.parametrize("n, ids", [(600, lambda i: i * 7919 % 1201 - 300), (300, lambda i: (1 << 62) // (i + 1)), (400, lambda i: None if i % 3 else i % 5), (200, lambda i: 7)])
def test_ids_of_all_kinds(spark, n, ids):
    rows = [(ids(i), f"Text {i % 37}", ("en", None, "", "de", "en")[i % 5], "s", i % 2) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    mine = got(manifest.build_manifest(docs.withColumn("place", F.lit(1)).withColumn("h", F.lit("x"))))
    assert mine == brute(rows) and len(mine) == n


def test_many_languages(spark):
    rows = [(i, "A", f"l{i % 77}", None, None) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert got(manifest.build_manifest(docs)) == brute(rows)


def test_places_are_gapless(spark):
    rows = spark.range(5000).select(F.lit("g").alias("grp"), (F.col("id") * 1009 % 4001).alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("h"), F.col("id").alias("row"))
    at = manifest.placed(rows).orderBy("place").collect()
    assert [r["place"] for r in at] == list(range(5000)) and {r["n"] for r in at} == {5000}
    assert [(r["doc_id"], r["h"]) for r in at] == sorted((r["doc_id"], r["h"]) for r in at)
