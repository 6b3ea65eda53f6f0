import pytest
from pyspark.sql import functions as F

from catalith.functions import text as T
from catalith.functions import values as V
from catalith.operators import catalogue as C
from catalith.operators import evaluation as Q
from catalith.operators import evidence as E
from tests.test_operators import many, one


def test_more_text(spark):
    assert many(spark, T.class_tokens("x"), ["Power-contactor, AC (a) AC"]) == [["power", "contactor", "ac"]]
    assert many(spark, T.fold_case("x"), ["Straße"]) == ["strasse"]
    assert many(spark, T.prepared("x"), ["A  ﬀ"]) == ["a ff"]
    assert one(spark, F.rlike(F.lit("ref L C1 D18."), T.spaced_pattern(F.lit("lc1d18")))) is True
    assert one(spark, T.same_without_spaces(F.lit("a b"), F.lit("ab "))) is True


def test_more_values(spark):
    assert many(spark, V.normalize_uom("x"), ["volts", "V", "bar", None]) == [("V", "ALIAS"), ("V", "EXACT"), (None, "UNRESOLVED"), (None, "NONE")]
    assert many(spark, V.resolve_source_unit("x"), ["HZ", "mw", "MM", "mW", "zz"]) == ["Hz", None, "mm", "mW", None]
    assert {r.dimension: r.symbols for r in V.compatible_units(spark).collect()}["mass"] == ["g", "mg", "kg"]
    df = spark.createDataFrame([("numeric", 0.30000000049, None, None, None, None, "V"), ("numeric", 0.3, None, None, None, None, "V"), ("alphanumeric", None, None, None, "AbC", None, None)], "k string, v double, lo double, hi double, t string, f boolean, u string")
    a, b, c = [r.r for r in df.select(V.semantic_key("k", "v", "lo", "hi", "t", "f", "u").alias("r")).collect()]
    assert a == b and c == "alphanumeric|abc"


def test_manufacturer_decisions_and_examples(spark):
    rows = spark.createDataFrame([(1, "ACME (A1)"), (2, "-"), (3, "Nobody (N)"), (4, "Twin"), (5, "A )B(")], "id int, Part_Manuf string")
    rules = spark.createDataFrame([("Acme Corp", "acme", True), ("T1", "twin", True), ("T2", "Twin Ltd", True), ("T3", "TWIN", True)], "canonical string, alias string, is_alias boolean")
    out = {r.id: (r.manuf_decision, r.manuf_reason, r.manuf_canonical) for r in C.manufacturer_decisions(rows, rules, "id").collect()}
    assert out == {1: ("COMMIT", "CASE_NORMALIZED", "Acme Corp"), 2: ("WITHHOLD", "PLACEHOLDER", None), 3: ("REVIEW", "UNKNOWN_MANUFACTURER", None), 4: ("REVIEW", "AMBIGUOUS_ALIAS", None), 5: ("WITHHOLD", "AMBIGUOUS_MANUFACTURER", None)}
    six = ", ".join(f"{f} string" for f in C.FIELDS)
    df = spark.createDataFrame([("a",) * 6, ("b",) * 6], six)
    examples = spark.createDataFrame([(*("a",) * 6, "P/Q")], six + ", classpath string")
    assert {r.Part_Desc: r.delivery for r in C.exact_examples(df, examples).collect()} == {"a": "COMMIT", "b": "WITHHOLD"}
    ex = spark.createDataFrame([(1, 1, "W", "mm"), (1, 2, "H", ""), (2, 1, "W", "mm"), (2, 2, "H", "in")], "r int, slot int, label string, uom string")
    assert {(r.slot, r.label, r.uom) for r in C.slot_profile(ex, "r").collect()} == {(1, "W", "mm"), (2, "H", None)}
    with pytest.raises(Exception, match="label sequence"):
        C.slot_profile(ex.union(spark.createDataFrame([(3, 1, "X", "")], ex.schema)), "r").collect()


def test_evidence_sums(spark):
    m = spark.createDataFrame([("g", "a", 1, 0, 0, True, 1), ("g", "b", 0, 1, 0, False, 2), ("g", "c", 0, 1, 0, True, 3)], "g string, member_id string, verification_order int, scope_order int, modality_order int, manufacturer boolean, ordinal int")
    assert E.best_member(m, ["g"]).collect()[0].member_id == "c"
    f = spark.createDataFrame([("v", True, True, True, False, True, "o1"), ("v", False, True, True, True, False, "o2"), ("w", False, True, True, True, True, "o")], "k string, verified boolean, manufacturer boolean, establishes_scope boolean, complete boolean, in_scope boolean, origin string")
    assert {r.k: (r.grade, r.independent_roots) for r in E.support_factors(f, ["k"]).collect()} == {"v": ("B", 1), "w": (None, 0)}
    g = spark.createDataFrame([("g", "k1", {"duty": "AC-1"}), ("g", "k1", {"duty": "ac-3"}), ("h", "k1", {}), ("h", "k2", {})], "g string, key string, conditions map<string,string>")
    assert {tuple(r) for r in Q.group_violations(g, ["g"]).collect()} == {("g", "CONFLICTING_DUTY"), ("h", "UNEQUAL_KEYS")}
    q = one(spark, E.qualifier_status(F.array(F.lit("a"), F.lit("b")), F.create_map(F.lit("a"), F.lit("1")), F.lit(True)))
    assert tuple(q) == ("PARTIAL", ["b"])
    cases = spark.createDataFrame([("1", "f", "dev", "EXACT", None), ("2", "f", "test", "UNKNOWN", None), ("2", "g", "test", "UNKNOWN", "x")], "case_id string, family string, split string, disposition string, exact_mpn string")
    assert sorted(map(tuple, Q.case_problems(cases).collect())) == [("1", "EXACT_WITHOUT_NUMBER"), ("1", "FAMILY_IN_TWO_SPLITS"), ("2", "DUPLICATE_ID"), ("2", "FAMILY_IN_TWO_SPLITS"), ("2", "NUMBER_WITHOUT_EXACT")]
    cost = spark.createDataFrame([(1.0, "EUR"), (0.0, None), (None, "USD")], "c double, cur string")
    assert {r.currency: r.cost for r in Q.by_currency(cost, "c", "cur").collect()} == {"EUR": 1.0, "UNSPECIFIED": 0.0}


def test_eligibility(spark):
    df = spark.createDataFrame([(1, "COMMIT", "v", "NONE", "MANUFACTURER_EVIDENCE", [("a", "l", True)]), (2, "COMMIT", "v", "NONE", "MANUFACTURER_EVIDENCE", [("a", None, True)]), (3, "COMMIT", "v", "UNRESOLVED", "HUMAN_APPROVED", None), (4, "COMMIT", "v", "EXACT", "HUMAN_APPROVED", None), (5, "REVIEW", "v", "EXACT", "HUMAN_APPROVED", None), (6, "COMMIT", "v", "EXACT", "MODEL", None)], "i int, d string, v string, u string, a string, e array<struct<artifact:string,locator:string,verified:boolean>>")
    c = F.col
    assert {r.i for r in df.where(E.delivery_eligible(c("d"), c("v"), c("u"), c("a"), c("e"))).collect()} == {1, 4}
    lit = F.lit
    none = lit(None).cast("string")
    assert one(spark, E.value_present(lit("80  mm wide"), lit("80"), lit("mm"), lit(False))) is True
    assert one(spark, E.value_present(lit("80 cm"), lit("80"), lit("mm"), lit(False))) is False
    assert one(spark, E.value_present(lit("80 "), lit("80"), none, lit(True))) is False
    assert one(spark, E.eligible_evidence(lit("EXACT_SKU"), none, lit("M"))) is False
    rows = spark.createDataFrame([("z",), ("b",), ("a",), ("q",)], "k string")
    order = spark.createDataFrame([("b", 1), ("a", 2)], "k string, position int")
    assert [r.k for r in E.schema_ordered(rows, order, "k").orderBy("place").collect()] == ["b", "a", "q", "z"]
    cand = spark.createDataFrame([("p", 1, "REJECTED", 1), ("p", 2, "ELIGIBLE", 3), ("p", 3, "ELIGIBLE", 2)], "p string, candidate_id int, status string, position int")
    assert E.preferred(cand, ["p"]).collect()[0].candidate_id == 3
