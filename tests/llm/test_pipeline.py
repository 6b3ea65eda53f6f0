import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline as p
from catalith.llm import language_id, pii
from catalith.llm.common import DOC_COLUMNS
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import grams
from tests.llm.test_packing import check as check_packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, small):
    """The documents after each stage, collected; the stages run on what was written."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for _, stage in p.STAGES:
        docs = p.settle(stage(spark, docs, small), "stage")
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_against_brute_force(spark, small, stages):
    assert all(tuple(s.columns) == DOC_COLUMNS for s in stages[:-1])
    before, spoken, cleared, single, masked = (s.collect() for s in stages[:-1])
    # language: the same model, document by document
    model = language_id.fit_on(stages[0])
    assert {(r.doc_id, r.lang) for r in spoken} == {(r.doc_id, j[0]) for r in before for j in [model.judge(r.text)] if not j[2]}
    assert len(spoken) >= 0.97 * len(before)
    # lines: minimal and longer runs alike
    rows = sorted((r.doc_id, r.text) for r in spoken)
    short = [(i, t) for i, t in rows if t.count("\n") < 60]
    if len(short) == len(rows):
        expected = {i: t for i, t, n, gone in brute_lines(rows, 50) if gone == 0 or gone < n}
        assert texts(stages[2]) == expected
    assert all(r.n_chars == len(r.text) for r in cleared)
    # near copies: no two that stay are linked, and what went is linked to its group
    sets = {r.doc_id: grams(r.text) for r in single}
    ids = sorted(sets)
    alike = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b) or a == b == set()
    gone = [r for r in cleared if r.doc_id not in sets]
    everything = {r.doc_id: grams(r.text) for r in cleared}
    assert not any(alike(sets[a], sets[b]) and sets[a] for i, a in enumerate(ids) for b in ids[:i])
    assert all(any(alike(grams(r.text), s) for i, s in everything.items() if i != r.doc_id) for r in gone)
    # personal data: no pattern span is left
    assert not any(s for r in masked for s in pii.base_spans(r.text))
    assert {r.doc_id for r in masked} == set(ids)
    # packing: every id of every document, once
    check_packing([(r.doc_id, r.text) for r in masked], stages[-1].collect(), 2048)


def test_run_is_the_stages_in_turn(spark, small, stages):
    count = lambda df: Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    own, run = stages[-1], p.run(spark, small)
    assert sum(count(run).values()) and {r.doc_id: r.doc_tokens for r in own.collect()} == {r.doc_id: r.doc_tokens for r in run.collect()}


def test_odd_documents(spark):
    words = " ".join(f"word{zlib.crc32(str(i).encode()) % 997}" for i in range(80))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, words, "en", "s", 5), (4, words + " more", "en", "s", 5), (4, words + " more", "en", "s", 5), (7, words * 800, "en", None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in p.STAGES:
        docs = p.settle(stage(spark, docs, ""), "odd")
    assert docs.count() > 0
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in p.STAGES:
        docs = p.settle(stage(spark, docs, ""), "none")
    assert docs.count() == 0


def test_near_copies_tell_rows_apart(spark):
    """Repeated doc_ids: no text that is alone goes; of copies, and of exact repeats, one row stays."""
    text = lambda k: " ".join(f"w{zlib.crc32(f'{k}-{i}'.encode()) % 9973}" for i in range(60))
    rows = [(1, text(1), "en", "s", 1), (2, text(1), "en", "s", 1), (2, text(2), "en", "s", 1), (3, text(3), "en", "s", 1), (3, text(3), "en", "s", 1), (4, text(4), "en", "s", 1), (4, text(4) + " end", "en", "s", 2), (None, text(1), "en", "s", 1), (None, text(5), "en", "s", 1), (5, None, None, None, None), (6, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = sorted((r.doc_id or 0, r.text or "") for r in p.near_copies(spark, docs, "").collect())
    fours = [t for i, t in kept if i == 4]
    assert [k for k in kept if k[0] != 4] == sorted([(0, text(5)), (1, text(1)), (2, text(2)), (3, text(3)), (5, "")])
    assert len(fours) == 1 and fours[0].startswith(text(4))


def test_near_copies_are_the_same_under_any_parallelism(spark, tmp_path):
    """Several files, packed into partitions otherwise by each plan: the same rows stay, and the numbers hold."""
    text = lambda k: " ".join(f"w{zlib.crc32(f'{k}-{i}'.encode()) % 9973}" for i in range(60))
    rows = [(i, text(i % 90) + (" end" if i % 2 else ""), "en", f"s{i}", i) for i in range(240)]
    spark.createDataFrame(rows, SCHEMA).repartition(12).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    found, numbers = [], []
    try:
        for planned, read in ((4, 4), (4, 3), (1, 7)):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", planned)
            kept = p.near_copies(spark, docs, "")
            own = p._numbered(docs)
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", read)
            found.append(sorted(r.doc_id for r in kept.select("*").collect()))
            numbers.append({r.doc_id: r.rid for r in own.select("*").collect()})
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert found[0] == found[1] == found[2] == list(range(90))
    assert numbers[0] == numbers[1] == numbers[2] and len(set(numbers[0].values())) == 240


def test_near_copies_broadcast_nothing_by_an_estimate(spark, small, monkeypatch):
    settle, plans = p.settle, []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, name)

    monkeypatch.setattr(p, "settle", seen)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    few = sorted(map(tuple, p.near_copies(spark, docs, small).collect()))
    monkeypatch.setattr(p, "BROADCAST_IDS", 0)
    last = p.near_copies(spark, docs, small)
    assert sorted(map(tuple, last.collect())) == few and 0 < len(few) < docs.count()
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    # only the files' names, which number rows
    assert {k for plan in plans for k in re.findall(r"HashedRelationBroadcastMode\(List\(input\[\d+, (\w+)", plan)} <= {"string"}
    assert len(plans) == 5 and all("SortMergeJoin" in plan for plan in plans)
