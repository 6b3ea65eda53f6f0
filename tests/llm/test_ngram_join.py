import random

import pytest

from catalith.llm import components
from catalith.llm import ngram_join as m
from catalith.llm.queries import ORACLE_SQL, op9_ngram_join
from tests.llm.oracle import same

SCHEMA = "doc_id long, text string, key string, node int"


def grams(text):
    w = [x.decode() for x in (text or "").encode().split()]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    texts = sorted({t or "" for _, t in rows})
    sets = [grams(t) for t in texts]
    label, links = list(range(len(texts))), [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                label = [label[j] if x == label[i] else x for x in label] if label[i] != label[j] else label
    low = lambda xs: min((x for x in xs if x is not None), default=None)
    ids = {t: [i for i, u in rows if (u or "") == t] for t in texts}
    out = []
    for i, t in rows:
        k = texts.index(t or "")
        group = [d for n, u in enumerate(texts) if label[n] == label[k] for d in ids[u]]
        out.append((i, low(ids[t or ""]), low(group), links[k], len(ids[t or ""])))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, m.jaccard_classes(df, **kw).collect()), key=repr)


def near(rng, n, base_words=80, edits=3):
    base = [f"w{rng.randrange(10**6)}" for _ in range(base_words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        yield " ".join(w)


def test_rows_and_bands_reach_the_recall():
    bands, rows = m.bands_and_rows(0.8, 0.9995, 64)
    assert bands * rows <= 64 and 1 - (1 - 0.8**rows) ** bands >= 0.9995


@pytest.mark.parametrize("block", [256, 7])
def test_hot_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK", block)
    rng = random.Random(block)
    texts = [*near(rng, 60), *near(rng, 3), *near(rng, 40, edits=9), *(" ".join(f"q{rng.randrange(999)}" for _ in range(60)) for _ in range(30))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[5]) for i in range(50)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "a  b"), (6, "a b c"), (None, "a b"), (None, "z"), (8, "long words here " * 20_000), (9, "long words here " * 19_999), (7, "q"), (7, "r"), (7, "q")]
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(m, "BROADCAST_TEXTS", 0)
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_no_side_that_grows_is_broadcast_by_an_estimate(spark, monkeypatch):
    rng, plans = random.Random(4), []

    def seen(df, *_):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, "seen")

    settle = m.settle
    monkeypatch.setattr(m, "settle", seen)
    monkeypatch.setattr(components, "settle", seen)
    monkeypatch.setattr(m, "BROADCAST_TEXTS", 0)
    rows = list(enumerate([*near(rng, 20), *near(rng, 20)]))
    out = m.jaccard_classes(spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA))
    assert sorted(map(tuple, seen(out).collect()), key=repr) == brute(rows)
    assert len(plans) > 7 and sum("SortMergeJoin" in p for p in plans) >= 5 and not any("Broadcast" in p for p in plans)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    same(op9_ngram_join(spark, folder), ORACLE_SQL["op9_ngram_join"], folder)


def test_overlaps_in_parts(monkeypatch):
    import numpy as np

    from catalith.llm import ngram_join as m

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 900, n).astype(np.uint64)) for n in (5, 400, 0, 80, 300, 1, 700, 60, 200, 9)]
    for left, right in ((np.arange(10), np.arange(10)), (np.array([1, 3, 6]), np.array([0, 2, 4, 5, 7]))):
        want = np.array([[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left])
        other = np.not_equal.outer(left, right)  # a set is never compared with itself
        for grams in (10**6, 300, 1):
            monkeypatch.setattr(m, "GRAMS", grams)
            assert (m._overlaps(sets, left, right) == want)[other].all()
