"""Queries over sets of evaluation cases, with their SQL twins: orders are cases, line items what is expected of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.plans.catalog import read
from catalith.sources import manifests as M


def _cases(spark, sf_dir):
    k, p = F.col("o_orderkey"), F.col("l_partkey")
    attribute = F.struct(
        F.concat(F.lit("EF"), F.lpad((p % 50).cast("string"), 6, "0")).alias("etim_feature_id"), F.when(p % 5 == 0, "NOT_APPLICABLE").otherwise("APPLICABLE").alias("applicability"), (p % 3 == 0).alias("buyer_critical"), F.when(p % 4 == 0, "ACCEPTED").otherwise("WITHHELD").alias("expected_status"),
        F.create_map(F.lit("VOLTAGE"), (F.col("l_suppkey") % 2).cast("string")).alias("conditions"), F.when(p % 6 == 0, F.array(F.lit("r"))).otherwise(F.array().cast("array<string>")).alias("acceptable_withheld_reasons"),
    )
    attributes = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(attribute).alias("expected_attributes"))
    disposition = F.when(k % 3 == 0, "EXACT").when(k % 3 == 1, "FAMILY_OR_INCOMPLETE_REFERENCE").otherwise("UNKNOWN")
    identity = F.struct(disposition.alias("disposition"), F.when((k % 3 == 0) & (k % 7 != 0), F.concat(F.lit("M-"), (k % 1000).cast("string"))).alias("exact_mpn"), F.when(k % 11 != 0, F.array(F.lit("d"))).otherwise(F.array().cast("array<string>")).alias("missing_discriminators"))
    return read(spark, sf_dir, "orders").join(attributes, "o_orderkey").select(
        F.concat(F.lit("c"), F.when(k % 97 == 0, F.lit(0)).otherwise(k).cast("string")).alias("case_id"), F.when(k % 41 == 0, "HELD").when(F.col("o_custkey") % 4 == 0, "LOCKED_TEST").otherwise("DEV").alias("split"), F.when(k % 53 == 0, " ").otherwise("m").alias("manufacturer"),
        F.concat(F.lit("f"), (F.col("o_custkey") + F.when(k % 59 == 0, 1).otherwise(0)).cast("string")).alias("product_family_id"), F.when(k % 8 == 0, "EC1").when(k % 8 < 5, F.concat(F.lit("EC"), F.lpad((k % 30).cast("string"), 6, "0"))).alias("etim_class_id"), F.when(k % 2 == 0, "SYNTHETIC").otherwise("REVIEWED").alias("review_status"),
        identity.alias("expected_identity"), "expected_attributes",
    )


def case_set_problems(spark, sf_dir):
    out = M.case_set_problems(_cases(spark, sf_dir))
    return out.groupBy("case_id", "feature", "problem").agg(F.count(F.lit(1)).alias("n"))


def case_class_problems(spark, sf_dir):
    pairs = read(spark, sf_dir, "part").select(F.concat(F.lit("EC"), F.lpad((F.col("p_partkey") % 25).cast("string"), 6, "0")).alias("class_id"), F.concat(F.lit("EF"), F.lpad((F.col("p_partkey") % 40).cast("string"), 6, "0")).alias("feature_id")).distinct()
    return M.class_problems(_cases(spark, sf_dir), pairs).groupBy("feature", "problem").agg(F.count(F.lit(1)).alias("n"))


def case_set_summary(spark, sf_dir):
    return M.summary(_cases(spark, sf_dir))


def case_lookup(spark, sf_dir):
    """Numbers and ids asked for, and the case that each finds."""
    k = F.col("l_orderkey")
    wanted = read(spark, sf_dir, "lineitem").select(F.when(k % 2 == 0, F.concat(F.lit("c"), (k * 2).cast("string"))).otherwise(F.concat(F.lit("M-"), (k % 1500).cast("string"))).alias("key")).distinct()
    return M.lookup(wanted, _cases(spark, sf_dir))


QUERIES = {f.__name__: f for f in (case_set_problems, case_class_problems, case_set_summary, case_lookup)}

_SQL = """
    cases AS (
        SELECT o_orderkey AS k, 'c' || CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE o_orderkey END AS case_id, CASE WHEN o_orderkey % 41 = 0 THEN 'HELD' WHEN o_custkey % 4 = 0 THEN 'LOCKED_TEST' ELSE 'DEV' END AS split, 'f' || (o_custkey + CASE WHEN o_orderkey % 59 = 0 THEN 1 ELSE 0 END) AS family,
               CASE WHEN o_orderkey % 8 = 0 THEN 'EC1' WHEN o_orderkey % 8 < 5 THEN 'EC' || lpad((o_orderkey % 30)::VARCHAR, 6, '0') END AS class_id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 THEN 'M-' || o_orderkey % 1000 END AS mpn
        FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
    ), attributes AS (
        SELECT k, case_id, class_id, 'EF' || lpad((l_partkey % 50)::VARCHAR, 6, '0') AS feature, l_partkey AS p, l_suppkey % 2 AS volts FROM lineitem JOIN cases ON l_orderkey = k
    )
"""
ORACLE_SQL = {
    "case_set_problems": f"""
        WITH {_SQL}, found AS (
            SELECT case_id, NULL AS feature, unnest([CASE WHEN k % 53 = 0 THEN 'NO_MANUFACTURER' END, CASE WHEN split = 'HELD' THEN 'UNKNOWN_SPLIT' END, CASE WHEN class_id = 'EC1' THEN 'MALFORMED_CLASS_ID' END, CASE WHEN k % 3 = 0 AND k % 7 = 0 THEN 'EXACT_WITHOUT_NUMBER' END, CASE WHEN k % 3 = 1 AND k % 11 = 0 THEN 'NO_MISSING_DISCRIMINATOR' END]) AS problem FROM cases
            UNION ALL SELECT case_id, feature, unnest([CASE WHEN p % 5 = 0 AND p % 3 = 0 THEN 'CRITICAL_NOT_APPLICABLE' END, CASE WHEN p % 5 = 0 AND p % 4 = 0 THEN 'NOT_APPLICABLE_ACCEPTED' END, CASE WHEN p % 4 = 0 AND p % 6 = 0 THEN 'ACCEPTED_WITH_REASONS_TO_WITHHOLD' END]) FROM attributes
            UNION ALL SELECT case_id, feature, 'TRUTH_GIVEN_TWICE' FROM (SELECT case_id, feature, volts FROM attributes GROUP BY ALL HAVING count(*) > 1)
            UNION ALL SELECT case_id, NULL, 'DUPLICATE_CASE_ID' FROM cases GROUP BY case_id HAVING count(*) > 1
            UNION ALL SELECT case_id, NULL, 'FAMILY_IN_TWO_SPLITS' FROM cases WHERE family IN (SELECT family FROM cases GROUP BY 1 HAVING min(split) <> max(split))
        ) SELECT case_id, feature, problem, count(*) AS n FROM found WHERE problem IS NOT NULL GROUP BY ALL
    """,
    "case_class_problems": f"""
        WITH {_SQL}, known AS (SELECT DISTINCT 'EC' || lpad((p_partkey % 25)::VARCHAR, 6, '0') AS class_id, 'EF' || lpad((p_partkey % 40)::VARCHAR, 6, '0') AS feature FROM part), lost AS (
            SELECT case_id, NULL AS feature, 'UNKNOWN_CLASS' AS problem FROM cases WHERE class_id NOT IN (SELECT class_id FROM known)
            UNION ALL SELECT DISTINCT case_id, feature, 'UNKNOWN_FEATURE' FROM attributes a WHERE class_id IN (SELECT class_id FROM known) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.class_id = a.class_id AND k.feature = a.feature)
        ) SELECT feature, problem, count(*) AS n FROM lost GROUP BY 1, 2
    """,
    "case_set_summary": f"WITH {_SQL} SELECT count(*) AS cases, count(DISTINCT CASE WHEN k % 53 = 0 THEN ' ' ELSE 'm' END) AS manufacturers, count(DISTINCT family) AS families, count(DISTINCT class_id) AS classes, count(*) FILTER (split = 'DEV') AS dev, count(*) FILTER (split = 'LOCKED_TEST') AS locked, count(*) FILTER (k % 2 = 0) AS synthetic, count(*) FILTER (k % 2 = 1) AS reviewed, false AS only_synthetic FROM cases",
    "case_lookup": f"""
        WITH {_SQL}, w AS (SELECT DISTINCT CASE WHEN l_orderkey % 2 = 0 THEN 'c' || l_orderkey * 2 ELSE 'M-' || l_orderkey % 1500 END AS key FROM lineitem)
        SELECT key, coalesce(i.case_id, n.case_id) AS case_id FROM w LEFT JOIN (SELECT DISTINCT case_id FROM cases) i ON i.case_id = key LEFT JOIN (SELECT mpn, min(case_id) AS case_id FROM cases WHERE mpn IS NOT NULL GROUP BY 1) n ON n.mpn = key
    """,
}
