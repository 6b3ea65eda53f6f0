import hashlib
from collections import defaultdict

import numpy as np
import pytest

from catalith.llm import exact_dedup as m

SCHEMA = "doc_id long, text string, norm string, fp int"


def brute(rows):
    groups = defaultdict(list)
    norm = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, m.exact_dedup(df).collect()), key=repr)


def test_rice_round_trip():
    rng = np.random.default_rng(1)
    for values in (np.array([0], np.uint64), np.array([2**63 + 5], np.uint64), np.unique(rng.integers(0, 2**61, 5000).astype(np.uint64)), np.arange(100, dtype=np.uint64)):
        k, blob = m.rice_encode(values)
        assert (m.rice_decode(len(values), k, blob) == values).all()


CASES = [(1, "A b"), (2, "a B"), (3, "a b "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 300_000), (9, "X" * 300_000), (None, "a b"), (10, "only"), (10, "only"), (None, "lone")]


@pytest.mark.parametrize("rows", [[], CASES, CASES + [(i, "hot") for i in range(100, 400)]])
def test_against_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_suspects_by_join(spark, monkeypatch):
    monkeypatch.setattr(m, "BROADCAST_SUSPECTS", 0)
    assert run(spark, CASES) == brute(CASES)


def test_whole_table(spark):
    from catalith.llm.queries import ORACLE_SQL, op5_exact_dedup
    from tests.llm.oracle import same

    same(op5_exact_dedup(spark, "/root/testdata/sf0.01"), ORACLE_SQL["op5_exact_dedup"], "/root/testdata/sf0.01")
