"""Queries over class schemas, with their SQL twins: nations are classes, and parts their features."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.functions.values import UNITS
from catalith.operators import classschema as S
from catalith.plans.catalog import read
from catalith.sources.classrules import rule_problems

ASKED = ("A", "mm", "kW", "furlong")


def _class(n):
    return F.concat(F.lit("EC"), F.lpad(n.cast("string"), 6, "0"))


def _feature(n):
    return F.concat(F.lit("EF"), F.lpad(n.cast("string"), 6, "0"))


def _tables(spark, sf_dir):
    p, s = F.col("p_partkey"), F.col("p_size")
    parts = read(spark, sf_dir, "part")
    unit = F.when(s % 5 == 4, F.lit(None)).otherwise(F.get(F.array(*map(F.lit, ASKED)), (s % 5).cast("int")))
    features = parts.select(_class(p % 25).alias("class_id"), _feature(p).alias("feature_id"), F.col("p_name").alias("name"), F.get(F.array(*map(F.lit, "NRAL")), (p % 4).cast("int")).alias("type"), unit.alias("unit"), s.cast("int").alias("position"))
    k = F.col("l_partkey")
    picks = read(spark, sf_dir, "lineitem").where("l_partkey % 4 = 2").select(_class(k % 25).alias("class_id"), _feature(k).alias("feature_id"), F.concat("l_returnflag", "l_linestatus").alias("value_id")).distinct()
    allowed = picks.select("class_id", "feature_id", "value_id", F.lower("value_id").alias("text"), F.ascii("value_id").alias("position"))
    required = F.when(s % 3 == 0, F.array(F.lit("VOLTAGE"), F.lit("UTILIZATION_CATEGORY"))).otherwise(F.array().cast("array<string>"))
    expected = F.when(s % 6 == 0, F.create_map(F.lit("VOLTAGE"), F.concat((p % 400).cast("string"), F.lit(" V")))).otherwise(F.create_map().cast("map<string,string>"))
    rules = parts.where("p_size % 2 = 0 OR p_size % 3 = 0").select(
        _class(F.when(p % 37 == 0, 99).otherwise((p + F.when(p % 31 == 0, 1).otherwise(0)) % 25)).alias("class_id"), _feature(p).alias("feature_id"), (s % 2 == 0).alias("buyer_critical"), (s % 3 == 0).alias("has_rule"), required.alias("required"), expected.alias("expected"), F.lit("r").alias("rationale"))
    classes = read(spark, sf_dir, "nation").select(_class(F.col("n_nationkey")).alias("class_id"), F.col("n_name").alias("class_name"))
    return features, allowed, rules, classes


def schema_features(spark, sf_dir):
    """Every feature with its units, picks, qualifiers and instruction."""
    features, allowed, rules, _ = _tables(spark, sf_dir)
    out = S.schema_features(features, allowed, rules)
    fixed = F.array_join(F.transform("expected", lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    picks = F.array_join(F.transform("allowed_values", lambda v: F.concat_ws(":", v["value_id"], v["text"])), ",")
    return out.select("class_id", "feature_id", "value_kind", F.array_join("accepted_units", ",").alias("accepted_units"), picks.alias("allowed_values"), F.array_join("required", ",").alias("required"), fixed.alias("expected"), "buyer_critical", S.instruction().alias("instruction"))


def class_schema_order(spark, sf_dir):
    """The order of each class's features, as its schema has it."""
    features, allowed, rules, classes = _tables(spark, sf_dir)
    out = S.class_schemas(S.schema_features(features, allowed, S.first_rules(rules)), classes)
    order = F.from_json(F.get_json_object("json_schema", "$.properties.features.propertyOrdering"), "array<string>")
    return out.select("class_id", F.col("n_features").cast("long").alias("n_features"), F.get_json_object("metadata", "$.etim_class_name").alias("class_name"), F.array_join(order, ",").alias("features"))


def class_schema_documents(spark, sf_dir):
    """Metadata, response schema and fingerprint of each class; tests hold them against documents built by hand."""
    features, allowed, rules, classes = _tables(spark, sf_dir)
    return S.class_schemas(S.schema_features(features, allowed, S.first_rules(rules)), classes)


def class_rule_problems(spark, sf_dir):
    features, _, rules, _ = _tables(spark, sf_dir)
    return rule_problems(rules, features)


def fixed_conditions(spark, sf_dir):
    features, allowed, rules, _ = _tables(spark, sf_dir)
    return S.expected_conditions(S.schema_features(features, allowed, rules))


QUERIES = {f.__name__: f for f in (schema_features, class_schema_order, class_schema_documents, class_rule_problems, fixed_conditions)}

_SAME = {unit: ",".join(s for s, d, _ in UNITS if d == next((d for s, d, _ in UNITS if s == unit), None)) or unit for unit in ASKED}
_MADE = f"""
    features AS (
        SELECT p_partkey AS p, p_size AS s, 'EC' || lpad((p_partkey % 25)::VARCHAR, 6, '0') AS class_id, 'EF' || lpad(p_partkey::VARCHAR, 6, '0') AS feature_id, p_name AS name, ['numeric', 'range', 'alphanumeric', 'logical'][p_partkey % 4 + 1] AS value_kind,
               CASE p_size % 5 {' '.join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(ASKED))} END AS unit, CASE p_size % 5 {' '.join(f"WHEN {i} THEN '{_SAME[u]}'" for i, u in enumerate(ASKED))} ELSE '' END AS accepted_units
        FROM part
    ), rules AS (
        SELECT 'EC' || lpad((CASE WHEN p % 37 = 0 THEN 99 ELSE (p + CASE WHEN p % 31 = 0 THEN 1 ELSE 0 END) % 25 END)::VARCHAR, 6, '0') AS class_id, feature_id, s % 2 = 0 AS critical, s % 3 = 0 AS has_rule, s % 6 = 0 AS fixes, p
        FROM features WHERE s % 2 = 0 OR s % 3 = 0
    )
"""
ORACLE_SQL = {
    "schema_features": f"""
        WITH {_MADE}, picks AS (
            SELECT p, string_agg(v || ':' || lower(v), ',' ORDER BY ascii(v), v) AS allowed_values FROM (SELECT DISTINCT l_partkey AS p, l_returnflag || l_linestatus AS v FROM lineitem WHERE l_partkey % 4 = 2) GROUP BY 1
        ), met AS (
            SELECT f.*, coalesce(allowed_values, '') AS allowed_values, coalesce(critical, false) AS buyer_critical, CASE WHEN has_rule THEN 'VOLTAGE,UTILIZATION_CATEGORY' ELSE '' END AS required, CASE WHEN fixes THEN 'VOLTAGE=' || f.p % 400 || ' V' ELSE '' END AS expected
            FROM features f LEFT JOIN picks USING (p) LEFT JOIN rules r ON r.class_id = f.class_id AND r.feature_id = f.feature_id
        )
        SELECT class_id, feature_id, value_kind, accepted_units, allowed_values, required, expected, buyer_critical,
               name || coalesce('; reported in ' || unit, '') || CASE WHEN expected <> '' THEN '; defined at ' || expected WHEN required <> '' THEN '; record the qualifiers ' || replace(required, ',', ', ') ELSE '' END || '.' AS instruction
        FROM met
    """,
    "class_schema_order": f"WITH {_MADE} SELECT class_id, count(*) AS n_features, any_value(n_name) AS class_name, string_agg(feature_id, ',' ORDER BY s, feature_id) AS features FROM features LEFT JOIN nation ON n_nationkey = p % 25 GROUP BY class_id",
    "class_rule_problems": f"""
        WITH {_MADE}, lost AS (SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM features f WHERE f.class_id = r.class_id AND f.feature_id = r.feature_id))
        SELECT class_id, feature_id, 'BUYER_CRITICAL_NOT_ON_CLASS' AS problem FROM lost WHERE critical AND class_id <> 'EC000099'
        UNION ALL SELECT class_id, feature_id, 'RULE_NOT_ON_CLASS' FROM lost WHERE has_rule AND class_id <> 'EC000099'
        UNION ALL SELECT DISTINCT class_id, NULL, 'UNKNOWN_CLASS' FROM lost WHERE class_id = 'EC000099'
    """,
    "fixed_conditions": f"WITH {_MADE} SELECT class_id, feature_id, 'VOLTAGE' AS kind, p % 400 || ' V' AS value FROM rules WHERE fixes AND (class_id, feature_id) IN (SELECT (class_id, feature_id) FROM features)",
}
