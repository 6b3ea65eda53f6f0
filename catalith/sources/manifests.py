"""Sets of evaluation cases in JSON files, and what is wrong with them: every problem at once, each typed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Splits, and the states of an attribute's truth.
SPLITS = ("DEV", "LOCKED_TEST")
CASE = (
    "case_id string, split string, manufacturer string, product_family_id string, etim_class_id string, review_status string, "
    "expected_identity struct<disposition:string,exact_mpn:string,missing_discriminators:array<string>>, "
    "expected_attributes array<struct<etim_feature_id:string,applicability:string,buyer_critical:boolean,expected_status:string,conditions:map<string,string>,acceptable_withheld_reasons:array<string>>>"
)


class ManifestError(ValueError):
    """A manifest that may not be used, with its problems."""


def available_manifests(spark: SparkSession, folder: str) -> list[str]:
    """Names of the JSON files of a folder, sorted; their contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path")
    return sorted(r.path.rsplit("/", 1)[-1].removesuffix(".json") for r in files.collect())


def load_manifest(spark: SparkSession, path: str, strict: bool = True) -> tuple[dict, DataFrame]:
    """(manifest_id, manifest_version and schema_version; cases) of one file. With strict, a manifest with a problem is refused, and all are named."""
    rows = spark.read.schema(f"manifest_id string, manifest_version string, schema_version string, cases array<struct<{CASE.replace(' string', ':string').replace(' struct<', ':struct<').replace(' array<', ':array<')}>>").json(path, multiLine=True)
    head = rows.select("manifest_id", "manifest_version", "schema_version").first()
    if head is None or not head.manifest_id or not head.manifest_version:
        raise ManifestError(f"{path}: no manifest_id or manifest_version")
    cases = rows.select(F.inline("cases"))
    if strict and (bad := case_set_problems(cases).orderBy("case_id", "problem").take(100)):
        raise ManifestError(f"{path}: " + "; ".join(f"{r.case_id}: {r.problem}" + (f" {r.feature}" if r.feature else "") for r in bad))
    return head.asDict(), cases


def load_named_manifest(spark: SparkSession, name: str, folder: str, strict: bool = True) -> tuple[dict, DataFrame]:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name):
        raise ManifestError(f"{name!r} is no manifest's name")
    return load_manifest(spark, f"{folder.rstrip('/')}/{name}.json", strict)


def case_set_problems(cases: DataFrame) -> DataFrame:
    """(case_id, feature, problem) for rows of CASE: every problem of a case, of its attributes, and of the set.

    A family in two splits lets a system learn it in one and be scored on it in the other; two truths for one attribute
    at one operating point can't both hold.
    """
    none = F.lit(None).cast("string")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    kind, given = F.col("expected_identity.disposition"), F.coalesce(F.col("expected_identity.exact_mpn"), F.lit("")) != ""
    own = F.filter(F.array(
        F.when(blank("case_id"), "NO_CASE_ID"), F.when(blank("manufacturer"), "NO_MANUFACTURER"), F.when(blank("product_family_id"), "NO_FAMILY"), F.when(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), "UNKNOWN_SPLIT"),
        F.when(F.col("etim_class_id").isNotNull() & ~F.rlike("etim_class_id", F.lit(r"^EC\d{6}$")), "MALFORMED_CLASS_ID"), F.when(kind.isNull(), "NO_IDENTITY_TRUTH"), F.when((kind == "EXACT") & ~given, "EXACT_WITHOUT_NUMBER"),
        F.when((kind == "FAMILY_OR_INCOMPLETE_REFERENCE") & (F.coalesce(F.size("expected_identity.missing_discriminators"), F.lit(0)) < 1), "NO_MISSING_DISCRIMINATOR"),
    ), lambda p: p.isNotNull())
    out = cases.select("case_id", none.alias("feature"), F.explode(own).alias("problem"))
    a = cases.select("case_id", F.inline("expected_attributes"))
    off, accepted = F.col("applicability") == "NOT_APPLICABLE", F.col("expected_status") == "ACCEPTED"
    of_attribute = F.filter(F.array(
        F.when(off & F.col("buyer_critical"), "CRITICAL_NOT_APPLICABLE"), F.when(off & accepted, "NOT_APPLICABLE_ACCEPTED"), F.when(accepted & (F.coalesce(F.size("acceptable_withheld_reasons"), F.lit(0)) > 0), "ACCEPTED_WITH_REASONS_TO_WITHHOLD"),
    ), lambda p: p.isNotNull())
    out = out.unionByName(a.select("case_id", F.col("etim_feature_id").alias("feature"), F.explode(of_attribute).alias("problem")))
    point = F.to_json(F.array_sort(F.map_entries(F.coalesce("conditions", F.create_map().cast("map<string,string>")))))
    twice = a.groupBy("case_id", F.col("etim_feature_id").alias("feature"), point.alias("point")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = out.unionByName(twice.select("case_id", "feature", F.lit("TRUTH_GIVEN_TWICE").alias("problem")))
    repeated = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = out.unionByName(repeated.select("case_id", none.alias("feature"), F.lit("DUPLICATE_CASE_ID").alias("problem")))
    straddling = cases.groupBy("product_family_id").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi").select("product_family_id")
    return out.unionByName(cases.join(straddling, "product_family_id", "left_semi").select("case_id", none.alias("feature"), F.lit("FAMILY_IN_TWO_SPLITS").alias("problem")))


def class_problems(cases: DataFrame, class_features: DataFrame) -> DataFrame:
    """(case_id, feature, problem): classes and features that the taxonomy (class_id, feature_id) doesn't have."""
    stated = cases.where("etim_class_id IS NOT NULL").select("case_id", F.col("etim_class_id").alias("class_id"), "expected_attributes")
    known = class_features.select("class_id").distinct()
    lost = stated.join(known, "class_id", "left_anti").select("case_id", F.lit(None).cast("string").alias("feature"), F.lit("UNKNOWN_CLASS").alias("problem"))
    features = stated.join(known, "class_id", "left_semi").select("case_id", "class_id", F.inline("expected_attributes")).withColumn("feature_id", F.col("etim_feature_id"))
    wrong = features.join(class_features.select("class_id", "feature_id"), ["class_id", "feature_id"], "left_anti")
    return lost.unionByName(wrong.select("case_id", F.col("feature_id").alias("feature"), F.lit("UNKNOWN_FEATURE").alias("problem")).distinct())


def summary(cases: DataFrame) -> DataFrame:
    """One row: cases, manufacturers, families, classes, cases by split and review, and whether all are synthetic, which no benchmark may quote."""
    count = lambda c: F.count_if(c)
    sums = cases.agg(
        F.count(F.lit(1)).alias("cases"), F.count_distinct("manufacturer").alias("manufacturers"), F.count_distinct("product_family_id").alias("families"), F.count_distinct("etim_class_id").alias("classes"),
        count(F.col("split") == "DEV").alias("dev"), count(F.col("split") == "LOCKED_TEST").alias("locked"), count(F.col("review_status") == "SYNTHETIC").alias("synthetic"), count(F.col("review_status") == "REVIEWED").alias("reviewed"),
    )
    return sums.withColumn("only_synthetic", (F.col("cases") > 0) & (F.col("cases") == F.col("synthetic")))


def lookup(wanted: DataFrame, cases: DataFrame) -> DataFrame:
    """wanted (key) with the case that has the key as case_id, else as its exact number; null where there is none.

    Of several cases with a number the smallest case_id counts.
    """
    by_id = cases.select(F.col("case_id").alias("key"), F.col("case_id").alias("_a")).distinct()
    by_number = cases.where("expected_identity.exact_mpn IS NOT NULL").groupBy(F.col("expected_identity.exact_mpn").alias("key")).agg(F.min("case_id").alias("_b"))
    return wanted.join(by_id, "key", "left").join(by_number, "key", "left").select("key", F.coalesce("_a", "_b").alias("case_id"))
