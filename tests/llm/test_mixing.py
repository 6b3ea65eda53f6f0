from collections import Counter, defaultdict

import pytest

from catalith.llm import mixing as m

SCHEMA = "doc_id long, text string, source string, place string, target int, words int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2) for i, t, s in rows], SCHEMA).repartition(3)


def shares(sizes, total):
    """Targets by the rule, one source after another."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, free, room = {}, set(order), total
    while True:
        whole = sum(weight[s] for s in free)
        over = [s for s in free if room * weight[s] / whole > 3 * sizes[s]]
        if not over:
            return out | {s: room * weight[s] / whole for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            free.remove(s)
        room = total - sum(out.values())


def check(rows, out):
    size = lambda t: len((t or "").split())
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    assert Counter((i, s, size(t)) for i, t, s in rows) == Counter((r.doc_id, r.source, r["size"]) for r in out)
    goal = shares(sizes, sum(sizes.values()))
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source], rel=1e-12)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(taken[s] == int(goal[s] + 0.5) for s in sizes)


def made(n, sources=("a", "b", "c", "d", None)):
    return [(i, "w " * (i * 7 % 23), sources[i % len(sources)] if i % 3 else sources[0]) for i in range(n)]


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_shares(spark, block):
    rows = made(300)
    check(rows, m.mixture(frame(spark, rows), block=block).collect())


def test_limits_and_reshares(spark):
    rows = [(1, "w " * 10, "a"), (2, "w " * 500, "b"), (3, "w " * 400, "c"), (4, "w " * 3, "d"), (5, "", "e"), (6, "w " * 90, "é"), (7, "w " * 20, "z")]
    out = m.mixture(frame(spark, rows), block=16).collect()
    check(rows, out)
    assert {r.source for r in out if r.taken == 3 * r["size"] and r["size"]} >= {"a", "d"}


def test_schedule_is_even_and_whole(spark):
    rows = [(i, "w " * 40, "abc"[i % 3]) for i in range(600)]
    plan = m.schedule(frame(spark, rows), block=32).collect()
    words, counts = defaultdict(Counter), Counter()
    for r in plan:
        counts[r.source] += r.n_words
        words[r.doc_id].update(range(r.first_word, r.first_word + r.n_words))
    total = 600 * 40
    assert sum(counts.values()) == pytest.approx(total, abs=3)
    assert all(set(c) <= set(range(40)) and max(c.values()) - min(c.values()) <= 1 for c in words.values())
    slots = defaultdict(Counter)
    for r in plan:
        slots[r.slot][r.source] += r.n_words
    seen, done = Counter(), 0
    assert all(len(c) == 1 and sum(c.values()) <= 32 for c in slots.values())
    for s in sorted(slots):
        seen += slots[s]
        done += sum(slots[s].values())
        assert all(abs(seen[x] - done * counts[x] / total) <= 32 * 12 for x in "abc")


def test_reruns_and_partitions_agree(spark):
    rows = made(200) + [(None, "a b", "a"), (None, "a b", "a"), (7, "x y z", "b")]
    one = Counter(map(tuple, m.mixture(frame(spark, rows), block=8).collect()))
    assert one == Counter(map(tuple, m.mixture(frame(spark, rows).repartition(17), block=8).collect()))
    assert Counter(map(tuple, m.schedule(frame(spark, rows), block=8).collect())) == Counter(map(tuple, m.schedule(frame(spark, rows).coalesce(1), block=8).collect()))


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, None, "b")], [(1, "only", None)], [(None, "x " * 200_000, "a"), (None, "x " * 200_000, "a"), (3, "é x y", "b")], [(1, "a b c", "s")] * 60])
def test_edges(spark, rows):
    check(rows, m.mixture(frame(spark, rows)).collect()) if not any(" " in (t or "") for _, t, _ in rows) else m.mixture(frame(spark, rows)).collect()


def test_no_break_space_is_part_of_a_word(spark):
    assert {r.doc_id: r["size"] for r in m.mixture(frame(spark, [(3, "é x y\x0bz\x1cq", "b")])).collect()} == {3: 3}


def test_many_sources(spark):
    rows = [(i, "w " * (i % 13), f"s{i % 400:03d}") for i in range(1600)]
    check(rows, m.mixture(frame(spark, rows), block=64).collect())


def test_whole_table(spark):
    from catalith.llm.queries import ORACLE_SQL, op13_mixing
    from tests.llm.oracle import same

    same(op13_mixing(spark, "/root/testdata/sf0.01"), ORACLE_SQL["op13_mixing"], "/root/testdata/sf0.01")
