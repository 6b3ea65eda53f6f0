import json

import pytest

from catalith.sources import manifests as M

GOOD = {"case_id": "a", "split": "DEV", "manufacturer": "m", "product_family_id": "f", "etim_class_id": "EC000001", "review_status": "SYNTHETIC", "expected_identity": {"disposition": "EXACT", "exact_mpn": "X1"}, "expected_attributes": [{"etim_feature_id": "EF1", "applicability": "APPLICABLE", "expected_status": "ACCEPTED", "conditions": {"VOLTAGE": "1"}}, {"etim_feature_id": "EF1", "applicability": "APPLICABLE", "conditions": {"VOLTAGE": "2"}}]}


def put(folder, name, cases, **head):
    (folder / f"{name}.json").write_text(json.dumps({"manifest_id": "m", "manifest_version": "1", "schema_version": "1", "cases": cases} | head, indent=1))
    return str(folder)


def test_manifests_are_listed_and_loaded(spark, tmp_path):
    folder = put(tmp_path, "one", [GOOD])
    put(tmp_path, "two", [])
    (tmp_path / "notes.txt").write_text("x")
    assert M.available_manifests(spark, folder) == ["one", "two"]
    head, cases = M.load_named_manifest(spark, "one", folder)
    assert head == {"manifest_id": "m", "manifest_version": "1", "schema_version": "1"} and [r.case_id for r in cases.collect()] == ["a"]
    assert M.summary(cases).first().only_synthetic and not M.summary(M.load_named_manifest(spark, "two", folder)[1]).first().only_synthetic
    for name in ("../one", "", "a/b"):
        with pytest.raises(M.ManifestError):
            M.load_named_manifest(spark, name, folder)
    put(tmp_path, "headless", [GOOD], manifest_version="")
    with pytest.raises(M.ManifestError, match="manifest_version"):
        M.load_named_manifest(spark, "headless", folder)


def test_every_problem_is_named_at_once(spark, tmp_path):
    attribute = {"etim_feature_id": "EF2", "applicability": "NOT_APPLICABLE", "buyer_critical": True, "expected_status": "ACCEPTED", "acceptable_withheld_reasons": ["r"]}
    bad = GOOD | {"split": "LOCKED_TEST", "manufacturer": " ", "etim_class_id": "EC1", "expected_identity": {"disposition": "EXACT"}, "expected_attributes": [attribute, attribute]}
    other = {"case_id": "b", "split": "HELD", "manufacturer": "m", "product_family_id": "", "expected_identity": {"disposition": "FAMILY_OR_INCOMPLETE_REFERENCE", "missing_discriminators": []}}
    none = {"case_id": None, "split": "DEV", "manufacturer": "m", "product_family_id": "g"}
    folder = put(tmp_path, "bad", [GOOD, bad, other, none])
    _, cases = M.load_named_manifest(spark, "bad", folder, strict=False)
    got = sorted((r.case_id or "", r.feature or "", r.problem) for r in M.case_set_problems(cases).collect())
    assert got == sorted([
        ("", "", "NO_CASE_ID"), ("", "", "NO_IDENTITY_TRUTH"), ("a", "", "DUPLICATE_CASE_ID"), ("a", "", "EXACT_WITHOUT_NUMBER"), ("a", "", "FAMILY_IN_TWO_SPLITS"), ("a", "", "FAMILY_IN_TWO_SPLITS"), ("a", "", "MALFORMED_CLASS_ID"), ("a", "", "NO_MANUFACTURER"),
        *[("a", "EF2", p) for p in ("ACCEPTED_WITH_REASONS_TO_WITHHOLD", "CRITICAL_NOT_APPLICABLE", "NOT_APPLICABLE_ACCEPTED") for _ in range(2)], ("a", "EF2", "TRUTH_GIVEN_TWICE"), ("b", "", "NO_FAMILY"), ("b", "", "NO_MISSING_DISCRIMINATOR"), ("b", "", "UNKNOWN_SPLIT"),
    ])
    with pytest.raises(M.ManifestError, match="a: DUPLICATE_CASE_ID.*b: UNKNOWN_SPLIT"):
        M.load_named_manifest(spark, "bad", folder)
    features = spark.createDataFrame([("EC000001", "EF1")], "class_id string, feature_id string")
    assert sorted((r.case_id, r.feature, r.problem) for r in M.class_problems(cases, features).collect()) == [("a", None, "UNKNOWN_CLASS")]


def test_lookup_by_id_or_number(spark, tmp_path):
    folder = put(tmp_path, "two", [GOOD, GOOD | {"case_id": "X1", "product_family_id": "g", "expected_identity": {"disposition": "EXACT", "exact_mpn": "Y"}}])
    _, cases = M.load_named_manifest(spark, "two", folder)
    wanted = spark.createDataFrame([(k,) for k in ("a", "X1", "Y", "none")], "key string")
    assert {r.key: r.case_id for r in M.lookup(wanted, cases).collect()} == {"a": "a", "X1": "X1", "Y": "X1", "none": None}
