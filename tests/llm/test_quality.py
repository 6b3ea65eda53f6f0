import re

import pytest

from catalith.llm import quality as m
from catalith.llm.queries import op3_quality_rules

DOCS, LABELS = "doc_id long, text string, quality string, kept int", "doc_id long, quality int, toxic int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup = text.split("\n"), 0
    for i, line in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {j for i, t in enumerate(triples) if triples.count(t) > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), failed


TEXTS = [None, "", " \t\n", "a\u00a0b c\x1cd", "a b c a b c a b", "x x x x", "l1\nl1\n \n \nl1", "é# *$ " * 60, "w" * 100_000, " ".join(map(str, range(60))), "one two three\v four\f five\r\n" * 20]


@pytest.mark.parametrize("text", TEXTS)
def test_base_counts(text):
    text = text or ""
    *counts, failed = brute(text)
    assert m.base_counts(text, text.encode().split()) == tuple(counts)


def test_edges(spark):
    docs = spark.createDataFrame([(i % 9, t, "q", 1) for i, t in enumerate(TEXTS)] + [(None, "a", "q", 1)], DOCS)
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (99, 1, 1), (3, 1, 0)], LABELS)
    out = m.quality_rules(docs, labels).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == sorted(map(brute, [*TEXTS, "a"]))
    assert all(r.kept != r.base_failed for r in out)  # labels of one kind: the base rules alone decide
    assert m.quality_rules(docs.limit(0), labels.limit(0)).collect() == []


def test_labels_and_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op3_quality_rules(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs[:150]:
        r = rows[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(d.text)
        assert r.kept == (not r.base_failed and r.probability >= m.KEEP_AT)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = [rows[i].kept for i, q in labels.items() if q and not rows[i].base_failed]
    bad = [rows[i].kept for i, q in labels.items() if not q]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = m.fit_on(docs, labels.where("doc_id % 4 <> 0"))
    held = labels.where("doc_id % 4 = 0").join(docs, "doc_id").collect()
    right = sum((model.probability(r.text.encode(), r.text.encode().split()) >= m.KEEP_AT) == (r.quality > 0) for r in held)
    assert right >= 0.9 * len(held)
