import itertools
import random

from pyspark.sql import functions as F

from catalith.functions import hashing as H
from catalith.functions import text as T
from catalith.functions import values as V
from catalith.operators import discovery as D
from catalith.operators import evidence as E
from catalith.operators import grid as G
from catalith.operators import verification as X


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("r")).collect()[0].r


def many(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.r for r in df.orderBy("i").select(column.alias("r")).collect()]


def test_text_columns(spark):
    assert many(spark, T.collapse("x"), [" a   b\t", "", None]) == ["a b", "", None]
    assert many(spark, T.punctuation_key("x"), ["Foo-Bar,  Inc.", "É a"]) == ["foo bar inc", "a"]
    assert many(spark, T.company_key("x"), ["Foo Co., Inc.", "Inc", "US Foo"]) == ["foo", "inc", "us foo"]
    assert many(spark, T.company_key("x", T.HINT_SUFFIXES), ["US Foo"]) == ["foo"]
    assert many(spark, T.canonical_mpn("x"), [" a b c ", " ", None]) == ["ABC", None, None]
    assert many(spark, T.url_host("x"), ["HTTPS://u:p@www.A.com.:80/x", "nope", "http://", None]) == ["a.com", "", "", ""]
    assert many(spark, T.host_suffixes(F.col("x")), ["a.b.c"]) == [["a.b.c", "b.c", "c"]]
    assert many(spark, T.contains_reference("x", F.lit("ab1")), ["x AB1-", "xab1", "ab12", "(Ab1)"]) == [True, False, False, True]
    assert many(spark, T.contains_phrase("x", F.lit("AC-3")), ["AC-3 ok", "AC-3e", "xAC-3", "AC-3"]) == [True, False, False, True]
    assert many(spark, T.format_g(F.col("x").cast("double")), ["18", "0.5", "1234.5678", "0.0001", "100000", "-2.50", "0", "999999.5"]) == ["18", "0.5", "1234.57", "0.0001", "100000", "-2.5", "0", "1e+06"]
    assert many(spark, T.search_text("x"), ["ﬁ​ne  Ⅳ", None]) == ["fine iv", None]
    assert many(spark, T.host_covered_by(F.col("x"), F.lit("a.com")), ["a.com", "b.a.com", "xa.com", ""]) == [True, True, False, False]
    assert many(spark, T.line_endings("x"), ["a\r\nb\rc"]) == ["a\nb\nc"]
    assert many(spark, T.excerpt("x", F.lit(70), 60, F.lit(3)), ["a" * 69 + "QQQ" + "b" * 99]) == ["a" * 60 + "QQQ" + "b" * 60]


def test_values(spark):
    assert many(spark, V.parse_integer("x").cast("string"), ["+12", " 7 ", "1.0", "x"]) == ["12", "7", None, None]
    assert many(spark, V.parse_boolean("x"), ["YES", "0", "maybe"]) == [True, False, None]
    assert many(spark, V.parse_range("x"), ["1 to 5 mm", "5 to 1", "2-3"]) == [(1.0, 5.0, "mm"), None, (2.0, 3.0, None)]
    assert many(spark, F.size(X.stated("x")), ["rated <= 5 mA at 50/60 Hz, model AC-3", "none"]) == [3, 0]


def test_hashing(spark):
    assert one(spark, H.canonical_json({"b": F.lit(1), "a": F.lit(None).cast("string")})) == '{"a":null,"b":1}'
    assert many(spark, H.redact_text("x"), ["u?api_key=1&q=2", "token = 5", "PASSWORD=x y"]) == ["u?api_key=[REDACTED]&q=2", "token = 5", "PASSWORD=[REDACTED] y"]
    assert many(spark, H.fill_template(F.col("x"), F.lit("B"), F.lit("C")), ["{base}-{code}", "{base}", "{base}{code}{x}"]) == ["B-C", None, None]
    assert one(spark, H.redact_map(F.create_map(F.lit("Api-Key"), F.lit("s"), F.lit("u"), F.lit("a?key=1")), ("token",), ("apikey",))) == {"Api-Key": "[REDACTED]", "u": "a?key=[REDACTED]"}


def test_relevance_and_kind(spark):
    rel = lambda url, mpn: one(spark, D.relevance(D.relevance_texts(F.lit(url), F.lit("")), F.lit(mpn)))
    assert rel("http://x/p/LC1D18.pdf", "LC1D18") == "EXACT"
    assert rel("http://LC1D18.com/p", "LC1D18") == "ABSENT"
    assert rel("http://x/LC1D09", "LC1D18") == "ABSENT" and rel("http://x/LC1D12B7", "LC1D18B7") == "SIBLING"
    assert rel("http://x/LC1D1", "LC1D18") == "FAMILY_ONLY"
    assert rel("http://x/LC1D12/LC1D15", "LC1D18") == "AMBIGUOUS"
    assert rel("http://x/a%2Bb?q=LC1%44" + "18", "LC1D18") == "EXACT"
    kinds = ["http://x/catalog/a.pdf", "http://x/user-manual", "http://x/a.PDF?y", "http://x/products/1", "http://x/"]
    assert [one(spark, D.kind(F.lit(u), F.lit(""))) for u in kinds] == ["CATALOG", "MANUAL", "DATASHEET", "PRODUCT_PAGE", "UNKNOWN"]


def test_rows_and_intervals(spark):
    words = [("p", "a", 0.0, 1.0, 10.0), ("p", "b", 5.0, 6.0, 11.5), ("p", "c", 0.0, 1.0, 12.5), ("p", "out", 50.0, 51.0, 12.6), ("q", "z", 0.0, 1.0, 1.0)]
    expected = None
    for order in itertools.islice(itertools.permutations(words), 0, 120, 40):
        df = spark.createDataFrame(list(order), "page string, text string, x0 double, x1 double, top double")
        got = sorted((r.page, r.row, -1 if r.column is None else r.column, r.text) for r in E.bin_rows(df, ["page"], 2.0, [0.0, 4.0, 10.0]).collect())
        assert expected is None or got == expected
        expected = got
    assert expected == [("p", 0, 0, "a"), ("p", 0, 1, "b"), ("p", 1, -1, "out"), ("p", 1, 0, "c"), ("q", 0, 0, "z")]
    spans = spark.createDataFrame([(1, 0, 5), (1, 3, 4), (1, 7, 9), (1, 20, 21)], "k int, lo int, hi int")
    assert sorted((r.lo, r.hi, r.n) for r in E.merged_intervals(spans, ["k"], "lo", "hi", 2).collect()) == [(0, 9, 3), (20, 21, 1)]


def test_intervals_of_any_kind(spark):
    """Nulls, repeats, and intervals that end before they begin, against one walk in order; one sort and no table of runs."""
    rng = random.Random(5)
    some = lambda n: None if rng.random() < 0.1 else rng.randrange(n)
    rows = [(k, a, None if a is None or rng.random() < 0.1 else a + rng.randrange(-6, 9)) for k in range(30) for a in [some(90) for _ in range(rng.randrange(1, 25))]]
    rows += [(99, None, 3), (99, None, None), (99, 50, None), (98, 10, 3), (98, 10, 3), (97, None, None), (96, None, 9), (96, 5, 6), (96, 40, 2), (96, 40, 60)]
    expected = []
    for k in {r[0] for r in rows}:
        reach, runs = None, []
        for _, a, b in sorted((r for r in rows if r[0] == k), key=lambda r: [(x is not None, x or 0) for x in r]):
            if not runs or (a is not None and reach is not None and a > reach + 2):
                runs.append([])
            runs[-1].append((a, b))
            reach = max((x for x in (reach, b) if x is not None), default=None)
        expected += [(k, min((a for a, _ in r if a is not None), default=None), max((b for _, b in r if b is not None), default=None), len(r)) for r in runs]
    out = E.merged_intervals(spark.createDataFrame(rows, "k int, a int, b int"), ["k"], "a", "b", 2)
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in out.select("k", "lo", "hi", "n").collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Aggregate" not in plan


def test_verification(spark):
    text = "Width 80 mm\nrated up to <= 5 A\nAC-3 duty\nvoltage 24 V\nvoltage 48 V\nlength 2.5 cm, 50/60 Hz"
    import hashlib

    sha, good = "a" * 64, hashlib.sha256(text.encode()).hexdigest()
    pages = spark.createDataFrame([(sha, 1, text, good, "M1"), ("b" * 64, 1, text, good, None), ("c" * 64, 1, text, "0" * 64, "M1")], "sha string, page int, text string, text_sha string, covers_mpn string")
    base = dict(sha=sha, page=1, mpn="m1", resolved_mpn="M1", fragment="Width", kind="numeric", number=80.0, unit="mm", value=None)
    cases = [
        ({}, None), ({"number": 8.0, "unit": "cm"}, None), ({"number": 81.0}, "VALUE_NOT_SUPPORTED"), ({"unit": "V"}, "UNIT_NOT_SUPPORTED"), ({"fragment": "rated", "number": 5.0, "unit": "A"}, "OPERATOR_MISMATCH"),
        ({"kind": "alphanumeric", "value": "AC-3", "fragment": "duty"}, None), ({"kind": "alphanumeric", "value": "AC", "fragment": "duty"}, "VALUE_NOT_SUPPORTED"), ({"kind": "range"}, "UNSUPPORTED_VALUE_KIND"),
        ({"fragment": "voltage", "number": 24.0, "unit": "V"}, "AMBIGUOUS_MATCH"), ({"fragment": "nowhere"}, "FRAGMENT_NOT_FOUND"), ({"page": 2}, "PAGE_NOT_FOUND"), ({"sha": "d" * 64}, "ARTIFACT_UNREADABLE"), ({"sha": "x"}, "ARTIFACT_MISMATCH"),
        ({"sha": "b" * 64}, "PRODUCT_SCOPE_NOT_SUPPORTED"), ({"sha": "c" * 64}, "ARTIFACT_UNREADABLE"), ({"resolved_mpn": None}, "PRODUCT_SCOPE_NOT_SUPPORTED"), ({"resolved_mpn": "M2"}, "PRODUCT_REFERENCE_MISMATCH"), ({"mpn": "M9", "resolved_mpn": "M9"}, "PRODUCT_REFERENCE_MISMATCH"),
        ({"fragment": "length", "number": 60.0, "unit": "Hz"}, None), ({"fragment": "length", "number": 25.0}, None),
    ]
    rows = [(i, *(base | c).values()) for i, (c, _) in enumerate(cases)]
    claims = spark.createDataFrame(rows, "claim_id int, sha string, page int, mpn string, resolved_mpn string, fragment string, kind string, number double, unit string, value string")
    got = {r.claim_id: r.failure for r in X.verify(claims, pages).collect()}
    assert got == {i: f for i, (_, f) in enumerate(cases)}



def test_verification_moves_texts_once(spark):
    """Lines are judged where claim and page meet: nothing is grouped by claim, and only pages are dealt with their texts."""
    claims = spark.createDataFrame([("a", None, 1, "M", "M", "f", "numeric", 5.0, "mm", None), ("b", "x", 1, "M", "M", "f", "numeric", 5.0, "mm", None), ("c", "0" * 64, 1, "M", "m ", "f", "numeric", 5.0, "mm", None)], "claim_id string, sha string, page int, mpn string, resolved_mpn string, fragment string, kind string, number double, unit string, value string")
    pages = spark.createDataFrame([("0" * 64, 1, "f 5 mm", None, "M"), ("x", 1, "f 5 mm", None, "M")], "sha string, page int, text string, text_sha string, covers_mpn string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = X.verify(claims, pages)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.claim_id: r.failure for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {"a": "ARTIFACT_UNREADABLE", "b": "ARTIFACT_MISMATCH", "c": None}
    assert "hashpartitioning(claim_id" not in plan and plan.count("Exchange hashpartitioning") == 4


def test_slots(spark):
    profile = spark.createDataFrame([("r", k, "L", "numeric", "mm") for k in "abcdefg"], "record string, slot_key string, label string, kind string, uom string")
    ok = ("L", "numeric", "mm", "v1", True, "COMMIT")
    cands = [("b", 1, "X", *ok[1:]), ("c", 1, "L", "text", *ok[2:]), ("d", 1, "L", "numeric", "cm", *ok[3:]), ("e", 1, *ok), ("e", 2, "L", "numeric", "mm", "v2", True, "COMMIT"), ("f", 2, *ok), ("f", 1, *ok), ("g", 1, *ok[:4], False, "WITHHOLD")]
    df = spark.createDataFrame([("r", k, i, *rest, i) for k, i, *rest in cands], "record string, slot_key string, candidate_id int, label string, value_kind string, value_uom string, value_key string, eligible boolean, decision string, rank int")
    got = {r.slot_key: (r.decision, r.reason, r.winner) for r in X.resolve_slots(profile, df).collect()}
    assert got == {"a": ("WITHHOLD", "NO_CANDIDATE", None), "b": ("REVIEW", "LABEL_MISMATCH", None), "c": ("REVIEW", "VALUE_KIND_MISMATCH", None), "d": ("REVIEW", "UOM_MISMATCH", None), "e": ("REVIEW", "CONFLICTING_VALUES", None), "f": ("COMMIT", "DUPLICATE_AGREEMENT", 1), "g": ("WITHHOLD", "NOT_ELIGIBLE", None)}


def test_grid(spark):
    assert G.unique_headers(["a", "", "a"]) == ["a", "Column 2", "a (2)"]
    assert G.detect_mapping(["Part_No", "Desc", "part no"], {"mpn": ("part no",), "other": ("part no",), "desc": ("desc",)}) == {"mpn": "Part_No", "other": "part no", "desc": "Desc"}
    df = spark.createDataFrame([("a1", "x"), ("A1 ", "n/a"), ("--", "y"), ("b10", "z"), ("b2", "z")], "mpn string, name string")
    out = [(r.mpn, r.status, r.issues) for r in G.validated(df, "mpn", ["name"]).orderBy("mpn").collect()]
    assert ("--", "INVALID", ["MISSING_MPN"]) in out and ("A1 ", "REVIEW", ["DUPLICATE_MPN", "MISSING_NAME"]) in out and ("b2", "READY", []) in out
    assert [r.mpn for r in G.page(df.where("name = 'z'"), [G.natural_key("mpn")], 1).collect()] == ["b2", "b10"]
    assert G.search(df, " A1", ["mpn"]).count() == 2
    stages = spark.createDataFrame([(1, "VERIFIED"), (1, "VERIFIED"), (2, "VERIFIED"), (2, "NOT_RUN"), (3, "REVIEW"), (3, "WITHHELD")], "run int, state string")
    assert {r.run: r.overall for r in G.overall_state(stages, ["run"], "state").collect()} == {1: "VERIFIED", 2: "PARTIAL", 3: "WITHHELD"}


def test_url_structure(spark):
    expected = {
        "http://[::1]/": "ADDRESS_NOT_PARSED", "http://[fe80::1]/": "ADDRESS_NOT_PARSED", "http://2130706433/": "ADDRESS_NOT_PARSED", "http://127.1/": "ADDRESS_NOT_PARSED", "http://0x7f000001/": "ADDRESS_NOT_PARSED",
        "http://0x7f.0.0.0x1/": "ADDRESS_NOT_PARSED", "http://8.8.8.999/": "ADDRESS_NOT_PARSED", "http://8.8.8.8/": "OK", "http://127.0.0.1/": "PRIVATE_ADDRESS", "http://u:p@10.0.0.1:80/": "PRIVATE_ADDRESS", "https://a.example/x": "OK",
        "https://xn--bcher-kva.example": "OK", "https://b\u00fccher.d\u00e9": "OK", "https://0xdeal.com/": "OK", "https://1.a/": "OK", "ftp://a.b/": "SCHEME_NOT_ALLOWED", "http:///x": "HOST_MISSING", "http://x.localhost/": "LOCALHOST",
    }
    assert dict(zip(expected, many(spark, D.url_structure(F.col("x")), list(expected)), strict=True)) == expected
