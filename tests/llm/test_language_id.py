import zlib

import pytest

from catalith.llm import language_id as m
from catalith.llm.queries import op8_language_id

SCHEMA = "doc_id long, text string, lang string, score string, rejected int"


def test_held_out_accuracy_and_whole_table(spark, small):
    rows = op8_language_id(spark, small).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    assert sum(r.rejected for r in rows) <= 0.03 * len(rows)


def test_same_as_one_by_one(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    model = m.fit_on(docs)
    got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in m.identify(docs, model).collect()}
    assert got == {r.doc_id: model.judge(r.text) for r in docs.collect()}


@pytest.mark.parametrize("labelled", [True, False])
def test_edges(spark, labelled):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", "en"), (4, "the house and the garden of words " * 9000, None), (None, "le jardin et la maison", "fr"), (18, "the house and the garden", "en"), (18, "the house and the garden", "en"), (7, "x", None)]
    df = spark.createDataFrame([(i, t, g if labelled else None, "s", 1) for i, t, g in rows], SCHEMA)
    out = m.language_id(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3))
    if labelled:
        assert by[4].lang_pred == "en" and by[None].lang_pred == "fr"
    else:
        assert {r.lang_pred for r in out} == {"und"}


def test_rejects_what_is_no_language_and_keeps_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = m.fit_on(docs)
    assert model.judge("zq xj kk wv " * 200)[2]
    df = spark.createDataFrame([(1, "the", "en", "old", 5)], SCHEMA)
    assert m.identify(df, model).columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]


def test_empty_table(spark):
    assert m.language_id(spark.createDataFrame([], SCHEMA)).collect() == []
