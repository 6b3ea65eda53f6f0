import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from catalith.llm import impact_index as m

DOCS = "doc_id long, text string, term string, block string, score int, item long"
ITEMS = "item_id long, text string, doc_id string, rank int"


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def brute(docs, items, k=10):
    held = [(i, Counter(t)) for i, x in docs if (t := terms(x))]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            size = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * size)) for t in terms(text) if t in c)
            if score:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return Counter(out)


def run(spark, docs, items, parts=3, **kw):
    d = spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in docs], DOCS).repartition(parts)
    return Counter(map(tuple, m.ranked_search(d, spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS), **kw).collect()))


RNG = np.random.default_rng(5)


def made(n, vocabulary=60, longest=40):
    words = [f"w{int(i * i / 9)}" for i in range(vocabulary)]
    return [(i, " ".join(RNG.choice(words, RNG.integers(0, longest)))) for i in range(n)]


def test_carry_arithmetic():
    a, b = RNG.integers(0, 1 << 20, 90).tolist(), RNG.integers(0, 1 << 22, 90).tolist()
    cut = lambda xs: [sum(((x >> i) & 1) << d for d, x in enumerate(xs)) for i in range(22)]
    total = cut(a)
    m.add_into(total, cut(b), 3)
    total = m.times(total, 1234)
    want = [(x + 8 * y) * 1234 for x, y in zip(a, b)]
    assert dict(m.values_at(total, (1 << 90) - 1)) == dict(enumerate(want))
    for k in (1, 5, 89, 90, 200):
        best = sorted(range(90), key=lambda d: (-want[d], d))[:k]
        assert m.top_documents(total, k) == sum(1 << d for d in best if want[d])


def test_ties_go_to_those_in_front():
    assert m.top_documents([0b111011], 3) == 0b1011 and m.top_documents([0, 0], 3) == 0 and m.top_documents([], 3) == 0


@pytest.mark.parametrize(("block", "items"), [(2048, 256), (16, 2)])
def test_against_brute_force(spark, monkeypatch, block, items):
    monkeypatch.setattr(m, "BLOCK_DOCS", block)
    monkeypatch.setattr(m, "ITEMS", items)
    docs = made(400) + [(1000 + i, "same same text w9 W9") for i in range(30)] + [(None, "w9"), (None, "w9 only"), (7, "w9 w1")]
    asked = [(i, t) for i, t in made(9)] + [(50, "same"), (51, "W9! w9, w9"), (52, "nowhere"), (53, None), (54, "")]
    assert run(spark, docs, asked) == brute(docs, asked)


def test_long_texts_close_a_block(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_TERMS", 500)
    docs = [(i, "long w1 " * 400 + f"x{i}") for i in range(5)] + made(60)
    assert run(spark, docs, [(1, "long x3 w1"), (2, "w4 w0")]) == brute(docs, [(1, "long x3 w1"), (2, "w4 w0")])


@pytest.mark.parametrize(
    ("docs", "items"),
    [
        ([], [(1, "a")]),
        ([(1, "a b")], []),
        ([(1, None), (2, ""), (3, " é, É;Ünï_x")], [(None, "é"), (4, "É"), (5, "x ünï"), (6, "Ünï  é")]),
        ([(i, "hot") for i in range(50)] + [(90, "hot cold")], [(1, "hot"), (1, "cold"), (2, "hot hot cold")]),
        ([(1, "z" * 300_000), (2, "z " * 200_000), (3, "other")], [(1, "z"), (2, "z" * 300_000)]),
    ],
)
def test_edges(spark, docs, items):
    assert run(spark, docs, items) == brute(docs, items)


def test_fewer_and_more(spark):
    docs = made(80)
    assert run(spark, docs, [(1, "w0 w1 w2")], k=3) == brute(docs, [(1, "w0 w1 w2")], 3)
    assert run(spark, docs, [(1, "w0 w1 w2")], k=500) == brute(docs, [(1, "w0 w1 w2")], 500)


def test_index_holds_every_document(spark):
    docs = made(300)
    index, count, total = m.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    ids = [i for r in index.where("term IS NULL").collect() for i in r.doc_ids]
    assert sorted(ids) == [i for i, t in docs if t] and count == len(ids) and total == sum(len(terms(t)) for _, t in docs)
    df = defaultdict(int)
    for r in index.where("term IS NOT NULL").collect():
        df[r.term] += r.df
        assert len(r.places) == 2 * r.df and len(r.slices) == m.IMPACT_BITS * -(-r.df // 8)
    assert df == Counter(t for _, x in docs for t in set(terms(x)))


def test_whole_table(spark):
    from catalith.llm.queries import ORACLE_SQL, op12_impact_search
    from tests.llm.oracle import same

    same(op12_impact_search(spark, "/root/testdata/sf0.01"), ORACLE_SQL["op12_impact_search"], "/root/testdata/sf0.01")
