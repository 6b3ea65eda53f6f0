import hashlib
import json

import pytest
from pyspark.sql import functions as F

from catalith.functions.values import UNITS
from catalith.operators import classschema as S
from catalith.sources import classrules as C

FEATURES = [("EC000001", "EF000002", 'Rated "Ie" é', "N", "A", 2), ("EC000001", "EF000001", "Range", "R", "furlong", 1), ("EC000001", "EF000003", "Colour", "A", None, 3), ("EC000001", "EF000004", "Flag", "L", None, 4), ("EC000001", "EF000005", "Free", "A", None, 4), ("EC000002", "EF000001", "Range", "R", "°C", 1)]
ALLOWED = [("EC000001", "EF000003", "EV2", "red/blue", 2), ("EC000001", "EF000003", "EV1", "black", 1)]
RULES = """
etim_class_id = "EC000001"
etim_class_name = "One"
[buyer_critical]
feature_ids = ["EF000002", "EF000003"]
[qualifiers.EF000002]
required_kinds = ["VOLTAGE", "UTILIZATION_CATEGORY"]
expected = { VOLTAGE = "400 V", UTILIZATION_CATEGORY = "AC-3" }
rationale = "why"
[qualifiers.EF000001]
required_kinds = ["TEMPERATURE"]
[qualifiers.EF000004]
required_kinds = []
"""


@pytest.fixture
def made(spark, tmp_path):
    (tmp_path / "EC000001.toml").write_text(RULES)
    rules = C.load_class_rules(spark, str(tmp_path))
    features = spark.createDataFrame(FEATURES, "class_id string, feature_id string, name string, type string, unit string, position int")
    allowed = spark.createDataFrame(ALLOWED, "class_id string, feature_id string, value_id string, text string, position int")
    classes = spark.createDataFrame([("EC000001", "One"), ("EC000002", None), ("EC000003", "Empty")], "class_id string, class_name string")
    return rules, features, allowed, classes


def dumped(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def by_hand(class_id, name):
    """The two documents, built in plain Python."""
    dims = {s: d for s, d, _ in UNITS}
    kinds = {"N": "numeric", "R": "range", "A": "alphanumeric", "L": "logical"}
    rule = {"EF000002": (["VOLTAGE", "UTILIZATION_CATEGORY"], {"UTILIZATION_CATEGORY": "AC-3", "VOLTAGE": "400 V"}), "EF000001": (["TEMPERATURE"], {}), "EF000004": ([], {})} if class_id == "EC000001" else {}
    metas, shapes, order = [], {}, []
    for _, fid, label, kind, unit, _ in sorted((f for f in FEATURES if f[0] == class_id), key=lambda f: (f[5], f[1])):
        accepted = [] if unit is None else [s for s, d, _ in UNITS if d == dims[unit]] if unit in dims else [unit]
        picks = [{"value_id": v, "text": t} for c, f, v, t, _ in sorted(ALLOWED, key=lambda a: a[4]) if (c, f) == (class_id, fid)]
        need, fixed = rule.get(fid, ([], {}))
        metas.append({"etim_feature_id": fid, "name": label, "etim_feature_type": kind, "value_kind": kinds[kind], "unit": unit, "accepted_units": accepted, "allowed_values": picks, "required_condition_kinds": need, "expected_conditions": [{"kind": k, "value": v} for k, v in sorted(fixed.items())], "buyer_critical": class_id == "EC000001" and fid in ("EF000002", "EF000003")})
        own = {"N": ["number"], "R": ["minimum", "maximum"], "A": ["text"], "L": ["boolean"]}[kind]
        props = {p: {"type": {"text": "string", "boolean": "boolean"}.get(p, "number")} for p in own}
        if kind == "A" and picks:
            props["text"]["enum"] = [p["text"] for p in picks]
        if accepted:
            props["unit"] = {"type": "string", "enum": accepted}
        props |= {"raw_text": {"type": "string"}, "page": {"type": "integer"}, "conditions": {"type": "array", "items": json.loads(S.CONDITION_ITEM)}}
        required = [*own, *(["unit"] if accepted else []), "raw_text", "page"]
        line = "; ".join([label, *([f"reported in {unit}"] if unit else []), *([f"defined at {', '.join(f'{k}={v}' for k, v in sorted(fixed.items()))}"] if fixed else [f"record the qualifiers {', '.join(need)}"] if need else [])]) + "."
        shapes[fid] = {"type": "object", "nullable": True, "description": line, "properties": props, "required": required, "propertyOrdering": [*required, "conditions"]}
        order.append(fid)
    meta = {"etim_class_id": class_id, "etim_class_name": name, "etim_release": "10.0", "etim_language": "EN", "schema_version": S.SCHEMA_VERSION, "features": metas}
    schema = {"type": "object", "required": ["etim_class_id", "features"], "propertyOrdering": ["etim_class_id", "features"], "properties": {"etim_class_id": {"type": "string", "enum": [class_id]}, "features": {"type": "object", "properties": shapes, "propertyOrdering": order}}}
    return meta, schema


def test_documents_are_canonical(made):
    rules, features, allowed, classes = made
    out = {r.class_id: r for r in S.class_schemas(S.schema_features(features, allowed, rules), classes).collect()}
    assert set(out) == {"EC000001", "EC000002"}
    for class_id, name in (("EC000001", "One"), ("EC000002", None)):
        meta, schema = by_hand(class_id, name)
        assert (out[class_id].metadata, out[class_id].json_schema) == (dumped(meta), dumped(schema))
        assert out[class_id].fingerprint == hashlib.sha256(dumped({"metadata": meta, "json_schema": schema}).encode()).hexdigest()


def test_fingerprint_is_the_same_at_1_and_200_partitions(spark, made):
    rules, features, allowed, classes = made
    wide = spark.range(4000).select(F.lit("EC000009").alias("class_id"), F.concat(F.lit("EF"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("feature_id"), F.lit("n").alias("name"), F.lit("N").alias("type"), F.lit("V").alias("unit"), (F.col("id") % 7).cast("int").alias("position"))
    print_of = lambda n: {r.class_id: r.fingerprint for r in S.class_schemas(S.schema_features(features.unionByName(wide).repartition(n), allowed.repartition(n), rules.repartition(n)), classes).collect()}
    assert print_of(1) == print_of(200) and len(print_of(1)) == 3


def test_some_features_only(spark, made):
    rules, features, allowed, _ = made
    only = spark.createDataFrame([("EC000001", "EF000003"), ("EC000001", "EF999999"), ("EC000001", "EF000003")], "class_id string, feature_id string")
    out = S.schema_features(features, allowed, rules, only).collect()
    assert [(r.feature_id, r.buyer_critical, [v.text for v in r.allowed_values]) for r in out] == [("EF000003", True, ["black", "red/blue"])]
    assert {r.rationale for r in S.schema_features(features, allowed).collect()} == {None}


def test_rules_against_the_class(spark, made, tmp_path):
    rules, features, _, _ = made
    assert C.rule_problems(rules, features).count() == 0
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "EC000002.toml").write_text('etim_class_id = "EC000002"\n[buyer_critical]\nfeature_ids = ["EF000009"]\n[qualifiers.EF000009]\nrequired_kinds = []\n')
    (tmp_path / "b" / "EC000077.toml").write_text('etim_class_id = "EC000077"\n[qualifiers.EF000001]\nrequired_kinds = []\n')
    found = C.rule_problems(C.load_class_rules(spark, str(tmp_path / "b")), features).collect()
    assert sorted((r.class_id, r.feature_id or "", r.problem) for r in found) == [("EC000002", "EF000009", "BUYER_CRITICAL_NOT_ON_CLASS"), ("EC000002", "EF000009", "RULE_NOT_ON_CLASS"), ("EC000077", "", "UNKNOWN_CLASS")]
    points = S.expected_conditions(S.schema_features(features, spark.createDataFrame([], "class_id string, feature_id string, value_id string, text string, position int"), rules)).collect()
    assert sorted((r.feature_id, r.kind, r.value) for r in points) == [("EF000002", "UTILIZATION_CATEGORY", "AC-3"), ("EF000002", "VOLTAGE", "400 V")]


@pytest.mark.parametrize(
    ("text", "problem"),
    [("a = ", "NOT_TOML"), ("a = 1", "NO_CLASS_ID"), ('etim_class_id = "EC1"', "NO_CLASS_ID"), ('etim_class_id = "EC000001"\n[qualifiers.EF1]\nrequired_kinds = ["SPEED"]', "UNKNOWN_KIND EF1 SPEED"), ('etim_class_id = "EC000001"\n[qualifiers.EF1]\nexpected = { PHASE = "3" }', "EXPECTED_NOT_REQUIRED EF1 PHASE")],
)
def test_malformed_rules(spark, tmp_path, text, problem):
    (tmp_path / "x.toml").write_text(text)
    rows = C.load_class_rules(spark, str(tmp_path), strict=False).collect()
    assert [r.problem for r in rows] == [f"x.toml: {problem}"]
    with pytest.raises(Exception, match="x.toml"):
        C.load_class_rules(spark, str(tmp_path)).collect()


def test_class_without_rules_is_a_row(spark, tmp_path):
    (tmp_path / "x.toml").write_text('etim_class_id = "EC000005"')
    assert [(r.class_id, r.feature_id) for r in C.load_class_rules(spark, str(tmp_path)).collect()] == [("EC000005", None)]


def test_rules_given_twice_leave_each_feature_once_in_its_class(spark):
    features = spark.createDataFrame([("C", "F", "n", "N", None, 1)], "class_id string, feature_id string, name string, type string, unit string, position int")
    allowed = spark.createDataFrame([], "class_id string, feature_id string, value_id string, text string, position int")
    rules = spark.createDataFrame([("C", "F", True, ["b"], {"VOLTAGE": "2 V"}, "r"), ("C", "F", False, ["a"], {"VOLTAGE": "1 V"}, "r")], "class_id string, feature_id string, buyer_critical boolean, required array<string>, expected map<string,string>, rationale string")
    once = S.first_rules(rules)
    assert [(r.buyer_critical, r.required, r.expected) for r in once.collect()] == [(False, ["a"], {"VOLTAGE": "1 V"})]
    classes = spark.createDataFrame([("C", "c")], "class_id string, class_name string")
    assert [r.n_features for r in S.class_schemas(S.schema_features(features, allowed, once), classes).collect()] == [1]
