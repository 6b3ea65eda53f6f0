"""Reviewed rules for classes, a TOML file each: which features a buyer needs, and which qualifiers a value is meaningless without."""

from __future__ import annotations

import re
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The kinds of qualifiers that a rule may name.
CONDITION_KINDS = (
    "UTILIZATION_CATEGORY", "VOLTAGE", "FREQUENCY", "TEMPERATURE", "PHASE", "MEASUREMENT_BASIS", "REGION", "STANDARD", "DUTY", "OTHER",
)
_RULES = "class_id string, class_name string, feature_id string, buyer_critical boolean, has_rule boolean, required array<string>, expected map<string,string>, rationale string, problem string"


def parse_class(text: str, name: str) -> list[tuple]:
    """Rows of one document: a feature each, or one row with a problem."""

    def bad(problem: str) -> list[tuple]:
        return [(None, None, None, None, None, None, None, None, f"{name}: {problem}")]

    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return bad("NOT_TOML")
    class_id = data.get("etim_class_id")
    if not isinstance(class_id, str) or not re.fullmatch(r"EC\d{6}", class_id):
        return bad("NO_CLASS_ID")
    rules, critical = data.get("qualifiers") or {}, (data.get("buyer_critical") or {}).get("feature_ids", [])
    for feature, body in rules.items():
        required, expected = body.get("required_kinds", []), body.get("expected") or {}
        if unknown := [k for k in (*required, *expected) if k not in CONDITION_KINDS]:
            return bad(f"UNKNOWN_KIND {feature} {unknown[0]}")
        if loose := [k for k in expected if k not in required]:
            return bad(f"EXPECTED_NOT_REQUIRED {feature} {loose[0]}")
    label = data.get("etim_class_name", "")
    rows = [(class_id, label, f, f in critical, f in rules, list(rules[f].get("required_kinds", [])) if f in rules else None, dict(rules[f].get("expected") or {}) if f in rules else None, rules[f].get("rationale", "") if f in rules else None, None) for f in sorted({*rules, *critical})]
    return rows or [(class_id, label, None, None, None, None, None, None, None)]


def load_class_rules(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(class_id, class_name, feature_id, buyer_critical, has_rule, required, expected, rationale) of all files of a folder, parsed where they are read.

    A rule without kinds is a finding (none is needed); a feature without a rule hasn't been
    reviewed. With strict, a malformed file stops the job that reads it; else it is a row that has only a
    problem.
    """

    def parsed(frames):
        for pdf in frames:
            rows = [r for name, content in zip(pdf["path"], pdf["content"], strict=True) for r in parse_class(bytes(content).decode("utf-8", "replace"), name.rsplit("/", 1)[-1])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _RULES.split(", ")])

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.toml").load(path).select("path", "content").mapInPandas(parsed, _RULES)
    if not strict:
        return rows
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem"))).otherwise(F.col("class_id"))
    return rows.withColumn("class_id", checked.cast("string")).drop("problem")


def rule_problems(rules: DataFrame, class_features: DataFrame) -> DataFrame:
    """(class_id, feature_id, problem): rules and buyer-critical ids for features that their class doesn't have, and classes that aren't known."""
    named = rules.where("feature_id IS NOT NULL")
    lost = named.join(class_features.select("class_id", "feature_id"), ["class_id", "feature_id"], "left_anti")
    known = class_features.select("class_id").distinct().withColumn("_known", F.lit(True))
    lost = lost.join(known, "class_id", "left")
    kinds = F.filter(F.array(F.when(F.col("buyer_critical"), "BUYER_CRITICAL_NOT_ON_CLASS"), F.when(F.col("has_rule"), "RULE_NOT_ON_CLASS")), lambda x: x.isNotNull())
    found = lost.where("_known").select("class_id", "feature_id", F.explode(kinds).alias("problem"))
    unknown = lost.where("_known IS NULL").select("class_id").distinct().select("class_id", F.lit(None).cast("string").alias("feature_id"), F.lit("UNKNOWN_CLASS").alias("problem"))
    return found.unionByName(unknown)
