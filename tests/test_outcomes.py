"""Outcomes, exports and rule tables on rows made by hand: nulls, empty tables, ties, odd names."""

import datetime

import pytest
from pyspark.sql import functions as F

from catalith.operators import outcomes as O


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_cell_texts(spark):
    df = spark.createDataFrame([(None, " a ", datetime.date(2024, 2, 3)), (1, "", None)], "`n.b` int, `x y` string, d date")
    out = O.cell_texts(df)
    assert out.columns == ["n.b", "x y", "d"]
    assert rows(out) == [("", "a", "2024-02-03"), ("1", "", "")]


def test_known_case_takes_no_row_twice(spark):
    cases = spark.createDataFrame([("a-1", "Y"), (" A-1", "X"), (None, "Z")], "mpn string, case string")
    df = spark.createDataFrame([("a-1 ", 1), (None, 2), ("b", 3)], "number string, other int")
    assert rows(O.known_case(df, cases, "number")) == [("a-1 ", 1, "X"), ("b", 3, None), (None, 2, None)]


def test_outcomes(spark):
    df = spark.createDataFrame(
        [(0, None, None, None, None, None, None), (1, True, False, None, None, None, None), (2, True, True, [None, "BLOCKED"], 0, 1, "NOT_RUN"), (3, True, True, None, 2, 0, "NOT_RUN"), (4, True, True, ["NOT_RUN"], None, None, None)],
        "id int, analyzed boolean, detailed boolean, statuses array<string>, verified int, withheld int, discovery_status string",
    )
    of = {x: [r.id for r in df.where(O.outcome_matches(x)).orderBy("id").collect()] for x in O.OUTCOMES}
    assert of == {"ALL": [0, 1, 2, 3, 4], "ANALYZED": [1, 2, 3, 4], "VERIFIED": [3], "PARTIAL": [1, 4], "BLOCKED": [2], "REVIEW": [2], "NO_EVIDENCE": [2]}


def test_upload_problem_of_nulls(spark):
    df = spark.createDataFrame([(None, 1), ("a.csv", None)], "name string, size long")
    assert [r[0] for r in df.select(O.upload_problem("name", "size")).collect()] == ["WRONG_FILE_TYPE", "EMPTY_FILE"]


def test_csv_line(spark):
    df = spark.createDataFrame([('a"b', None, "x,y"), ("l\r", "", "plain")], "a string, b string, c string")
    assert rows(df.select(O.csv_line(["a", "b", "c"]))) == [('"a""b",,"x,y"',), ('"l\r",,plain',)]


def test_verified_facts_of_nothing(spark):
    kind = "mpn string, verified array<struct<label:string,value:string,uom:string,authority:string,status:string,delivery_eligible:boolean,mapping_status:string>>"
    df = spark.createDataFrame([("m", None), ("n", []), (None, [(None, "1", None, None, None, None, None)])], kind)
    assert rows(O.verified_facts(df)) == [("", "", "1", "", "", "", "")]


def test_more_patterns_than_a_corpus_takes(spark):
    kind = "key string, domains array<string>, authority string, reviewed boolean"
    full = [("k", [f"d{i}.example" for i in range(O.MAX_PATTERNS)], "OFFICIAL", None), ("n", None, "OFFICIAL", None), ("u", ["u.example"], "REVIEWED", None)]
    assert O.corpus_patterns(spark.createDataFrame(full, kind)).count() == O.MAX_PATTERNS
    with pytest.raises(ValueError):
        O.corpus_patterns(spark.createDataFrame([*full, ("m", ["m.example"], "REVIEWED", True)], kind))


def test_authoritative_without_rules(spark):
    rules = spark.createDataFrame([("a", "OFFICIAL"), ("b", "OFFICIAL"), ("b", None)], "registry string, authority string")
    registries = spark.createDataFrame([("a",), ("b",), ("c",)], "registry string")
    assert rows(O.authoritative(rules, registries)) == [("a", True), ("b", False), ("c", False)]


def test_totals_of_an_empty_run(spark):
    kind = "requested array<string>, executed array<string>, results int, candidates array<struct<authority:string,relevance:string,licensing:boolean>>, attempts int, successes int, artifacts int"
    assert rows(O.run_totals(spark.createDataFrame([], kind))) == [(0,) * 11]
    one = spark.createDataFrame([(None, ["q"], None, [(None, None, None), ("APPROVED_MANUFACTURER", "EXACT", True)], 1, None, 2), (["a", "b"], None, 3, None, None, None, None)], kind)
    assert rows(O.run_totals(one)) == [(2, 2, 1, 3, 2, 1, 1, 1, 1, 0, 2)]


def test_gates_of_nulls(spark):
    df = spark.createDataFrame([(None, None, None), ("EXACT", "m", " 12 ")], "a string, b string, c string").withColumn("d", F.lit(None).cast("boolean"))
    out = df.select(O.identity_refusal("a", "b"), O.establishes_scope("a", "d"), O.is_structured("a"), O.integer_or("c", -1))
    assert rows(out) == [("IDENTITY_NOT_EXACT", False, False, -1), (None, False, False, 12)]
