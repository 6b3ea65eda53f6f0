from catalith.operators import delivery as D
from catalith.operators import evidence as E
from catalith.operators import records as R

FACT = "part string, target string, source_key string, priority int, decision string, reason string, verified boolean, value string, uom string"
HEADERS = ["Mfg_Part_Num", "Part_Desc", "BRAND_NAME", "ATTRIBUTE_LABEL 1", "ATTRIBUTE_VALUE 1", "ATTRIBUTE_UOM 1", "ATTRIBUTE_LABEL 2", "ATTRIBUTE_VALUE 2", "ATTRIBUTE_UOM 2"]


def fact(part, target, key, priority=1, decision="COMMIT", value="1", uom=None, reason="OTHER"):
    return (part, target, key, priority, decision, reason, True, value, uom)


def test_whole_records(spark):
    rows = spark.createDataFrame([(i, f"p{i}", f"desc {i}") for i in range(1, 9)], "row_number int, Mfg_Part_Num string, Part_Desc string")
    normal = spark.createDataFrame([(1, "p1", "M", "B"), (2, "p9", "M", "B"), (3, "p3", None, None), (3, "p3", None, None), (7, None, "M", "B7")], "row_number int, part string, manufacturer string, brand string")
    classes = spark.createDataFrame([(1, "p1", {"Part_Desc": "better", "nowhere": "x"}), (4, "p1", {}), (6, "p6", None), (6, "p6", None)], "row_number int, part string, fields map<string,string>")
    facts = spark.createDataFrame([fact("p1", "Width", "w", 2, value="5", uom="mm"), fact("p1", "Colour", "c", 1, value="red"), fact("p1", "Other", "o", decision="REVIEW"), fact("p5", "A", "a"), fact("p5", "A", "b"), fact("p8", "A", "a"), fact("p8", "B", "b"), fact("p8", "C", "c")], FACT)
    out = {r.row_number: r for r in D.delivery_records(rows, HEADERS, normal, classes, facts).collect()}
    assert {k: r.problem for k, r in out.items()} == {1: None, 2: "NORMALIZATION_OF_ANOTHER_ROW", 3: "NORMALIZATION_GIVEN_TWICE", 4: "CLASSIFICATION_OF_ANOTHER_ROW", 5: "CONTESTED_TARGET", 6: "CLASSIFICATION_GIVEN_TWICE", 7: None, 8: "SLOT_CAPACITY"}
    assert tuple(out[1])[3:] == ("p1", "better", "B", "Colour", "red", "", "Width", "5", "mm")
    assert tuple(out[7])[3:] == ("p7", "desc 7", "B7", "", "", "", "", "", "")
    assert all(x is None for k in (2, 3, 4, 5, 6, 8) for x in tuple(out[k])[3:]) and [out[k].attributes for k in (1, 5, 7, 8)] == [2, 0, 0, 0]
    assert [(r.part, r.slot, r.label, r.source_key) for r in D.provenance(facts, "part", 2).orderBy("part", "slot").collect()] == [("p1", 1, "Colour", "c"), ("p1", 2, "Width", "w")]


def test_assembly_refuses_rather_than_cuts(spark):
    facts = spark.createDataFrame([fact("full", f"T{i}", f"k{i}") for i in range(3)] + [fact("two", "T", "a"), fact("two", "T", "b")] + [fact("same", "T", "a"), fact("same", "T", "a")] + [fact("none", "T", "a", decision="REVIEW", reason="CONFLICT")], FACT)
    out = {r.part: (r.problem, r.committed, r.attributes_written, r.contested_targets) for r in R.assembly_summary(facts, ["part"], 2).collect()}
    assert out == {"full": ("SLOT_CAPACITY", 3, 0, []), "two": ("CONTESTED_TARGET", 2, 0, []), "same": (None, 2, 2, []), "none": (None, 0, 0, ["T"])}


def test_a_missing_value_is_no_agreement(spark):
    rows = [("a", "p", "1", 1), ("a", "p", None, 2), ("b", "p", "1", 1), ("b", None, "1", 2), ("c", None, None, 1), ("c", None, None, 2), ("d", "p", "1", 1), ("d", "p", "1", 2), ("e", "p", "1", 1)]
    df = spark.createDataFrame(rows, "target string, point string, value string, n int")
    out = {(r.target, r.n): r.outcome for r in E.resolve_conflicts(df, ["target"], "point", "value", ["n"]).collect()}
    assert out == {("a", 1): "CONFLICT", ("a", 2): "CONFLICT", ("b", 1): "MULTIPLE_OPERATING_POINTS", ("b", 2): "MULTIPLE_OPERATING_POINTS", ("c", 1): "COMMIT", ("c", 2): "DUPLICATE_MERGED", ("d", 1): "COMMIT", ("d", 2): "DUPLICATE_MERGED", ("e", 1): "COMMIT"}


def test_a_cell_given_twice_identifies_by_the_text_that_its_row_shows(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, True, "Part"), (1, 0, 1, 0, False, "q-1"), (1, 0, 1, 0, False, "q-2"), (1, 0, 1, 1, False, "5 mm")], "page int, table_index int, row_index int, column_index int, is_header boolean, text string")
    claims = spark.createDataFrame([("a", 1, "q-1"), ("b", 1, "q-2")], "claim_id string, page int, mpn string")
    assert [(r.claim_id, r.identity_cell, r.text) for r in R.row_evidence(claims, cells).collect()] == [("a", "q-1", "Part q-1 5 mm")]


def test_a_target_given_twice_is_contested_in_its_slots_whatever_the_source_key(spark):
    facts = spark.createDataFrame([fact("same", "T", "a"), fact("same", "T", "a"), fact("same", "U", "a")], FACT)
    assert sorted((r.target, r.slot, r.contested) for r in R.in_slots(facts, ["part"], 2).collect()) == [("T", 1, True), ("T", 2, True), ("U", 3, False)]
