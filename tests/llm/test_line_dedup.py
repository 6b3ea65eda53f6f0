import random
import re

import pytest

from catalith.llm import common
from catalith.llm import line_dedup as m
from catalith.llm.queries import ORACLE_SQL, op10_line_dedup
from tests.llm.oracle import same


def brute(rows, min_words):
    """All runs of all lengths, first places first; rows are in order."""
    lines = [[] if t is None else t.split("\n") for _, t in rows]
    first, gone = {}, [set() for _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for d in order:
        words = [len(re.findall(r"[^ \t-\r]+", x)) for x in lines[d]]
        for a in range(len(lines[d])):
            for b in range(a, len(lines[d])):
                if sum(words[a : b + 1]) < min_words:
                    continue
                fd, fa = first.setdefault(tuple(lines[d][a : b + 1]), (d, a))
                if fd != d or fa + (b - a) < a:
                    gone[d].update(range(a, b + 1))
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(ls) if k not in g), len(ls), len(g)) for (i, t), ls, g in zip(rows, lines, gone, strict=True)]


def run(spark, rows, min_words):
    df = spark.createDataFrame([(i, t, 5, "r", -1) for i, t in rows], "doc_id long, text string, rid int, h string, n_lines int").coalesce(1)
    return [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in m.dedup_lines(df, min_words).select("doc_id", "text", "n_lines", "n_removed").collect()]


@pytest.mark.parametrize("seed", range(4))
def test_against_all_runs(spark, seed):
    rng = random.Random(seed)
    vocab = ["", " ", "a", "b c", "d e f", "g h i j k", "one two three four five six seven"]
    rows = []
    for i in range(60):
        lines = [rng.choice(vocab[: 4 + seed]) for _ in range(rng.randrange(14))]
        if rows and rng.random() < 0.5:
            lines += (rng.choice(rows)[1] or "").split("\n")
        rows.append((i, "\n".join(lines)))
    assert sorted(run(spark, rows, 6)) == sorted(brute(rows, 6))


def test_edges(spark, monkeypatch):
    passage = "\n".join(f"line {i} of a passage that many share" for i in range(20))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, passage), (5, "own start\n" + passage + "\nown end"), (5, passage), (None, passage), (None, "unique"), (6, "same line again\n" * 200), (7, "w " * 60 + "\nx"), (8, "y\n" + "w " * 60), (9, "\r\n".join(["a b"] * 300))]
    expected = sorted(brute(rows, 50), key=repr)
    assert sorted(run(spark, rows, 50), key=repr) == expected
    monkeypatch.setattr(m, "BROADCAST_DOCS", 0)
    assert sorted(run(spark, rows, 50), key=repr) == expected
    assert run(spark, [], 50) == []


def test_columns_stay(spark):
    df = spark.createDataFrame([(1, "a", 5, "r", 7)], "doc_id long, text string, rid int, seg string, removed int")
    assert m.dedup_lines(df).collect()[0].asDict() == {"doc_id": 1, "text": "a", "rid": 5, "seg": "r", "removed": 7, "n_lines": 1, "n_removed": 0}


def test_files_are_not_copied(spark, tmp_path, monkeypatch):
    """Texts that lie in files are not written again; rows of several files that repeat a doc_id are told apart."""
    passage = "\n".join(f"line {i} of a passage that many share" for i in range(20))
    rows = [(i // 2, f"own {i}\n{passage}" if i % 3 else passage) for i in range(40)] + [(None, passage), (99, None)]
    for i in range(3):
        spark.createDataFrame(rows[i::3], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs/part={i}")
    settled, settle = [], m.settle
    for module in (m, common):
        monkeypatch.setattr(module, "settle", lambda df, name: settled.append(df.schema.simpleString()) or settle(df, name))
    got = m.dedup_lines(spark.read.parquet(f"{tmp_path}/docs"), 50)
    kept = [r for r in got.collect() if r.text is not None]
    assert got.count() == len(rows) and settled and not [x for x in settled if "text" in x]
    assert sum(passage in r.text for r in kept) == 1 and sum(r.n_removed == 20 for r in kept) == len(rows) - 2
    assert min((r.doc_id for r in kept if passage in r.text)) == 0


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    same(op10_line_dedup(spark, folder), ORACLE_SQL["op10_line_dedup"], folder)
