import duckdb
import pytest

from commerce_marts.llm import queries
from commerce_marts.llm.token_counts import TokenRollup

KIND = "source string, lang string, tokenizer string, tokens long"


def test_signed_batches(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), KIND)
    t = TokenRollup(spark, str(tmp_path / "t"))
    t.commit(1, added=rows(("a", "en", "v1", 5), ("a", "en", "v1", 7), (None, None, "v1", None)))
    for _ in range(3):  # sent again: counts once
        t.commit(2, added=rows(("a", "en", "v2", 9)), removed=rows(("a", "en", "v1", 7)))
    assert {tuple(r) for r in t.totals().collect()} == {("a", "en", "v1", 1, 5), ("a", "en", "v2", 1, 9), (None, None, "v1", 1, 0)}
    t.commit(3, removed=rows(("a", "en", "v1", 5)))
    before = {tuple(r) for r in t.totals().collect()}
    assert before == {("a", "en", "v2", 1, 9), (None, None, "v1", 1, 0)}
    t.fold(2)
    assert {tuple(r) for r in t.totals().collect()} == before
    t.commit(4, added=rows())
    assert {tuple(r) for r in t.totals().collect()} == before


def test_extra_columns(spark, tmp_path):
    t = TokenRollup(spark, str(tmp_path / "t"))
    t.commit(1, added=spark.createDataFrame([("a", "en", "v", 3, 99, 98)], KIND + ", documents long, batch int"))
    assert [tuple(r) for r in t.totals().collect()] == [("a", "en", "v", 1, 3)]


def test_a_batch_sent_again_after_a_fold_counts_once(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), KIND)
    t = TokenRollup(spark, str(tmp_path / "t"))
    assert t.commit(1, added=rows(("a", "en", "v", 5))) and t.commit(2, added=rows(("a", "en", "v", 7)))
    t.fold(2)
    assert not t.commit(1, added=rows(("a", "en", "v", 5))) and not t.commit(2, added=rows(("a", "en", "v", 7)))
    assert [tuple(r) for r in t.totals().collect()] == [("a", "en", "v", 2, 12)]


def test_a_crash_during_a_fold_or_commit_loses_nothing(spark, tmp_path, monkeypatch):
    rows = lambda *r: spark.createDataFrame(list(r), KIND)
    t = TokenRollup(spark, str(tmp_path / "t"))
    t.commit(1, added=rows(("a", "en", "v", 5)))
    t.commit(2, added=rows(("a", "en", "v", 7)))

    def killed(*_):
        raise OSError("killed")

    monkeypatch.setattr(t.sums, "_publish", killed)
    for step in (lambda: t.fold(), lambda: t.commit(3, added=rows(("a", "en", "v", 100)))):
        with pytest.raises(OSError, match="killed"):
            step()
    after = TokenRollup(spark, str(tmp_path / "t"))
    assert [tuple(r) for r in after.totals().collect()] == [("a", "en", "v", 2, 12)]
    assert after.commit(3, added=rows(("a", "en", "v", 1))) and after.totals().first()["tokens"] == 13


def test_null_and_repeated_ids_keep_one_row_of_each_text(spark, tmp_path):
    docs = [(None, "x y", "en", "a"), (None, "x y", "en", "a"), (4, "p q r", "de", "b"), (4, "p q r", "de", "b"), (9, "p q r", "de", "c"), (5, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in queries.op3_token_totals(spark, str(tmp_path)).collect()}
    sql = queries.SQL["op3_token_totals"].replace("FROM documents)", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet'))")
    want = set(duckdb.sql(f"SELECT source, lang, tokenizer, documents, tokens FROM ({sql})").fetchall())
    assert got == want == {("a", "en", "pieces", 1, 2), ("b", "de", "words", 1, 3), (None, None, "words", 1, 0)}
