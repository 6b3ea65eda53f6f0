import math
from fractions import Fraction

import numpy as np
import pytest

from catalith.llm import whitening as m

SCHEMA = "vec_id long, embedding array<double>, n long, component string"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], SCHEMA).repartition(3)
    return m.whiten(df, **kw).collect()


def check(rows, out, components=32):
    good = [(i, e) for i, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    x = [[math.floor(64 * c) + 1_000_000 for c in e] for _, e in good]
    n, d = len(x), len(x[0])
    k = min(components, d)
    assert len(out) == n * k and {r.n for r in out} == {n}
    s = [sum(col) for col in zip(*x)]
    dev = sorted((i is None, i or 0, sum((n * a - b) ** 2 for a, b in zip(row, s))) for (i, _), row in zip(good, x))
    assert sorted((r.vec_id is None, r.vec_id or 0, int(r.deviation_exact)) for r in out if r.component == 1) == dev
    assert all(r.deviation == (int(r.deviation_exact) if int(r.deviation_exact) < 2**63 else None) for r in out)
    v = np.array([[float(Fraction(sum(n * r[a] * r[b] for r in x) - s[a] * s[b], n * n)) for b in range(d)] for a in range(d)])
    e = np.linalg.eigvalsh(v)[::-1]
    top = {r.component: r.explained for r in out}
    assert [top[i + 1] for i in range(k)] == pytest.approx([max(t, 0) / (np.trace(v) or 1) for t in e[:k]], rel=1e-6, abs=1e-12)
    white = np.array([[r.whitened for r in sorted(out, key=lambda r: r.component) if r.vec_id == i] for i, _ in good]) if len({i for i, _ in good}) == n else None
    if white is not None:
        some = [j for j in range(k) if top[j + 1] > 0]
        centred = white - white.mean(axis=0)
        err = np.abs(centred.T @ centred / n - np.eye(k))[np.ix_(some, some)].max(initial=0)
        assert err == pytest.approx(out[0].identity_error, abs=1e-9) and out[0].identity_error < 1e-4
        flat = np.array([[float(Fraction(a) - Fraction(b, n)) for a, b in zip(row, s)] for row in x])
        for j in some:
            pulled = flat.T @ white[:, j] / n  # V u / sqrt(e)
            u = pulled / np.linalg.norm(pulled)
            assert np.abs(flat @ u / math.sqrt(u @ v @ u) - white[:, j]).max() < 1e-5 * max(1, np.abs(white[:, j]).max())


RNG = np.random.default_rng(3)


def test_against_fractions(spark):
    e = RNG.normal(size=(300, 6)) @ RNG.normal(size=(6, 6))
    check(list(enumerate(e.tolist())), run(spark, list(enumerate(e.tolist()))))


def test_only_some_components(spark):
    rows = list(enumerate(RNG.normal(size=(80, 5)).tolist()))
    check(rows, run(spark, rows, components=2), 2)


def test_bad_rows_are_left_out(spark):
    rows = list(enumerate(RNG.normal(size=(40, 3)).tolist())) + [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("nan"), 2.0]), (93, [float("inf"), 0.0, 0.0]), (94, []), (None, [0.5, 0.25, -1.0]), (3, [0.1, 0.2, 0.3])]
    out = run(spark, rows)
    check(rows, out)
    short = run(spark, rows + [(95, [1.0, 2.0])])
    assert len(short) == len(out) and all(r.vec_id != 95 for r in short)


def test_very_different_scales(spark):
    rows = list(enumerate((RNG.normal(size=(200, 4)) * np.array([1e5, 1e3, 5.0, 0.5])).tolist()))
    check(rows, run(spark, rows))
    rows = list(enumerate((RNG.normal(size=(200, 4)) * np.array([1e9, 1e4, 5.0, 0.5])).tolist()))
    assert run(spark, rows)[0].identity_error < 1e-6  # doubles can't say more of these


def test_entries_beyond_longs(spark):
    rows = [(i, [1e30 * (i % 2), float(i), 0.5]) for i in range(12)]
    out = run(spark, rows)
    assert all(r.deviation is None for r in out) and out[0].identity_error < 1e-4
    n, y = 12, [[math.floor(64 * c) for c in e] for _, e in rows]
    s = [sum(c) for c in zip(*y)]
    assert {r.vec_id: int(r.deviation_exact) for r in out} == {i: sum((n * a - b) ** 2 for a, b in zip(row, s)) for (i, _), row in zip(rows, y)}


@pytest.mark.parametrize("rows", [[(1, [1.0, 2.0])], [(i, [0.5, 0.5]) for i in range(9)], [(i, [float(i), 2.0 * i, 3.0]) for i in range(30)]])
def test_without_variance(spark, rows):
    out = run(spark, rows)
    check(rows, out)
    assert all(r.whitened == 0 for r in out if r.explained == 0)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, [])]) == []
    assert m.whitened_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_digits_and_blocks_are_exact():
    big = _Scatter_total(np.array([[2.0**70, -3.0], [5.0, 2.0**21 + 1]]))
    assert big[0, 0] == 2 and big[1, 1] == 2**140 + 25 and big[1, 2] == -3 * 2**70 + 5 * (2**21 + 1) and big[2, 2] == 9 + (2**21 + 1) ** 2


def _Scatter_total(y):
    s = m._Scatter(3)
    s.add(y)
    return s.close()


def test_whole_table(spark):
    from catalith.llm.queries import op11_whitening

    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    rows = [(r.vec_id, r.embedding) for r in table]
    check(rows, op11_whitening(spark, "/root/testdata/sf0.01").collect())
    vectors = m.whitened_vectors(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    assert vectors.count() == len(rows) and len(vectors.first().whitened) == 32
