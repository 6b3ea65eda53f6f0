import random
from collections import Counter

import pytest

from catalith.operators import ruled as R
from catalith.operators.records import evidence_in_rows
from catalith.plans import ruled as Q

WORDS, RULES = "page int, text string, x0 double, x1 double, top double", "page int, x double, top double, bottom double"


def by_hand(words, rules):
    """Cells of one page's tables, row by row."""
    bands = []
    for x, top, bottom in sorted(rules, key=lambda r: r[1]):
        if bands and top - bands[-1][1] <= 3:
            bands[-1][1] = max(bands[-1][1], bottom)
            bands[-1][2].append(x)
        else:
            bands.append([top, bottom, [x]])
    out, n = {}, 0
    for top, bottom, places in bands:
        groups = []
        for x in sorted(places):
            groups[-1].append(x) if groups and x - groups[-1][-1] <= 2 else groups.append([x])
        xs = [sum(g) / len(g) for g in groups]
        if len(xs) < 4 or bottom - top <= 4:
            continue

        def lines(part):
            rows = []
            for t, x0, x1, y in sorted(part, key=lambda w: (w[3], w[1])):
                if not rows or y - rows[-1][0] > 3:
                    rows.append((y, []))
                rows[-1][1].append((x0, y, t, (x0 + x1) / 2))
            for _, ws in rows:
                cells = [""] * (len(xs) - 1)
                for _, _, t, mid in sorted(ws):
                    for i in range(len(xs) - 1):
                        if xs[i] <= mid < xs[i + 1]:
                            cells[i] = f"{cells[i]} {t}".strip()
                yield cells

        rows = [(True, c) for c in lines([w for w in words if top - 1 <= w[3] < bottom]) if any(c)]
        for c in lines([w for w in words if bottom <= w[3] < bottom + 400]):
            filled = sum(map(bool, c))
            if filled == 1:
                break
            if filled:
                rows.append((False, c))
        for r, (head, cells) in enumerate(rows):
            out |= {(n, r, i, head, t): 1 for i, t in enumerate(cells)}
        n += bool(rows)
    return Counter(out)


def run(spark, pages):
    words = spark.createDataFrame([(p, *w) for p, (ws, _) in pages.items() for w in ws], WORDS).repartition(3)
    rules = spark.createDataFrame([(p, *r) for p, (_, rs) in pages.items() for r in rs], RULES).repartition(2)
    cells = R.ruled_tables(words, rules).collect()
    status = {r.page: (r.status, r.tables) for r in R.page_tables(spark.createDataFrame([(p,) for p in pages], "page int"), words, rules).collect()}
    return cells, status


GRID = [(x, 100.0, 130.0) for x in (50.0, 150.0, 250.0, 350.0)]
LINE = lambda y, *texts: [(t, 60.0 + 100 * i, 90.0 + 100 * i, y) for i, t in enumerate(texts) if t]


def test_statuses_and_stops(spark):
    pages = {
        1: (LINE(105.0, "Part", "Size", "Flag") + LINE(118.0, "", "mm", "") + LINE(140.0, "a", "1", "x") + LINE(155.0, "b", "", "y") + LINE(170.0, "alone", "", "") + LINE(185.0, "c", "2", "z"), GRID),
        2: (LINE(105.0, "Part", "Size", "Flag"), []),
        3: (LINE(40.0, "above", "it", "all"), GRID),
        4: (LINE(105.0, "a", "b", "c"), GRID[:3]),
        5: ([], GRID),
        6: (LINE(105.0, "h", "h", "h") + LINE(529.0, "in", "reach", "") + LINE(530.5, "out", "of", "reach"), GRID),
        7: (LINE(105.0, "one", "table", "") + LINE(305.0, "two", "tables", ""), GRID + [(x, 300.0, 330.0) for x in (50.0, 150.0, 151.5, 250.0, 350.0)] + [(50.0, 331.0, 332.0)]),
        8: ([("left", 0.0, 20.0, 105.0), ("edge", 150.0, 150.0, 105.0), ("right", 400.0, 420.0, 105.0), ("two", 60.0, 80.0, 106.0), ("words", 90.0, 99.0, 104.5)], GRID),
    }
    cells, status = run(spark, pages)
    assert status == {1: ("TABLES_EXTRACTED", 1), 2: ("NO_TABLE_STRUCTURE", 0), 3: ("TABLE_STRUCTURE_UNRESOLVED", 0), 4: ("NO_TABLE_STRUCTURE", 0), 5: ("TABLE_STRUCTURE_UNRESOLVED", 0), 6: ("TABLES_EXTRACTED", 1), 7: ("TABLES_EXTRACTED", 2), 8: ("TABLES_EXTRACTED", 1)}
    text = lambda p: [(r.row_index, r.is_header, r.text) for r in sorted(cells, key=lambda r: (r.page, r.table_index, r.row_index, r.column_index)) if r.page == p]
    assert [t for _, _, t in text(1)] == ["Part", "Size", "Flag", "", "mm", "", "a", "1", "x", "b", "", "y"]
    assert {t for _, _, t in text(8)} == {"two words", "edge", ""}
    for p, (ws, rs) in pages.items():
        assert Counter((r.table_index, r.row_index, r.column_index, r.is_header, r.text) for r in cells if r.page == p) == by_hand(ws, rs), p


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_reading(spark, seed):
    rng = random.Random(seed)
    pages = {}
    for p in range(25):
        rules = [(50.0 + 90 * c + rng.choice([0, 0.5, 1]), 60.0 + 200 * f, 90.0 + 200 * f) for f in range(rng.randint(0, 3)) for c in range(rng.randint(3, 6)) for _ in range(2)]
        words = [(f"w{i}", x, x + 12, rng.choice([62, 64.5, 66, 75, 95, 97, 110, 140, 266, 275, 300, 310, 480]) + rng.choice([0.0, 0.25])) for i in range(rng.randint(0, 40)) for x in [rng.uniform(20, 520)]]
        pages[p] = (words, rules)
    cells, _ = run(spark, pages)
    for p, (ws, rs) in pages.items():
        assert Counter((r.table_index, r.row_index, r.column_index, r.is_header, r.text) for r in cells if r.page == p) == by_hand(ws, rs), p


def test_no_pages(spark):
    cells, status = run(spark, {})
    assert cells == [] and status == {}


@pytest.mark.parametrize("name", ["ruled_cells", "ruled_pages", "ruled_row_evidence"])
def test_no_side_that_grows_with_the_pages_goes_through_the_driver(spark, small, name):
    plan = Q.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_evidence_reads_each_table_once(spark, small):
    plan = Q.ruled_row_evidence(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 5  # words of line items, headers and footers; rules; claims


def test_words_without_a_place(spark):
    grid = spark.createDataFrame([(1, *r) for r in GRID] + [(1, None, 100.0, 130.0), (2, 50.0, None, 130.0), (2, 50.0, 100.0, None), (2, 70.0, 100.0, None)], RULES)
    words = [(1, *w) for w in LINE(105.0, "a", "b", "c")] + [(1, None, 160.0, 190.0, 105.0), (1, "x", None, 90.0, 105.0), (1, "x", 60.0, 90.0, None), (None, "x", 60.0, 90.0, 105.0), (2, "x", 60.0, 90.0, 105.0)]
    cells = R.ruled_tables(spark.createDataFrame(words, WORDS), grid).collect()
    assert sorted(tuple(r) for r in cells) == [(1, 0, 0, i, True, t) for i, t in enumerate("abc")]


def test_rows_that_name_a_product_in_several_cells(spark):
    rows = [
        (1, 0, 0, True, ["Part", "", "Also"]), (1, 0, 1, False, ["q 1", None, "Q1"]), (1, 0, 2, False, ["", " ", "q1"]), (1, 0, 3, False, ["q2", "q1", "q 1"]),
        (1, 1, 0, False, ["q1"]), (2, 0, 0, False, ["q1", "q9"]), (3, 0, 0, True, ["q1"]),
    ]
    rows = spark.createDataFrame(rows, "page int, table_index int, row_index int, is_header boolean, row array<string>")
    claims = spark.createDataFrame([("a", 1, "Q 1"), ("b", 1, "q2"), ("c", 2, "q9"), ("d", 3, "q1"), ("e", 1, ""), ("f", 1, None), ("g", None, "q1")], "claim_id string, page int, mpn string")
    out = sorted(tuple(r) for r in evidence_in_rows(claims, rows).collect())
    assert out == [
        ("a", 0, 1, 0, "q 1", "Part Also q 1 Q1"), ("a", 0, 2, 2, "q1", "Part Also q1"), ("a", 0, 3, 1, "q1", "Part Also q2 q1 q 1"), ("a", 1, 0, 0, "q1", "q1"),
        ("b", 0, 3, 0, "q2", "Part Also q2 q1 q 1"), ("c", 0, 0, 1, "q9", "q1 q9"),
    ]
