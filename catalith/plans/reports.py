"""Queries over evaluation reports, fingerprints and whole records, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.operators import report as R
from catalith.plans.catalog import read


def _cases(spark, sf_dir):
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        k.alias("case_id"), F.when(F.col("o_custkey") % 3 == 0, "locked").otherwise("dev").alias("split"), F.col("o_orderpriority").alias("family"),
        F.when(k % 5 == 0, "UNKNOWN").otherwise("EXACT").alias("disposition"), F.when(k % 5 != 0, F.concat(F.lit("m "), k.cast("string"))).alias("exact_mpn"),
    )


def _predictions(spark, sf_dir):
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").where("o_orderkey % 11 <> 0").select(
        k.alias("case_id"), F.when(k % 13 == 0, "TIMEOUT").otherwise("COMPLETED").alias("outcome"), F.when(k % 7 == 0, "EXACT").when(k % 5 == 0, "UNKNOWN").otherwise("EXACT").alias("disposition"), F.concat(F.lit("M"), (k + F.when(k % 17 == 0, 1).otherwise(0)).cast("string")).alias("mpn"),
    )


def _attributes(spark, sf_dir):
    """Line items as attributes, one for each order and place."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return read(spark, sf_dir, "lineitem").withColumns({"case_id": F.col("l_orderkey"), "feature": F.concat(F.lit("F"), n.cast("string"))})


def _judged(spark, sf_dir):
    p, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("int")
    rows = _attributes(spark, sf_dir)
    expected = rows.select(
        "case_id", "feature", F.when(p % 9 == 0, "NOT_APPLICABLE").when(p % 9 == 1, "UNKNOWN").otherwise("APPLICABLE").alias("applicability"), (p % 4 == 0).alias("buyer_critical"), F.when(p % 6 != 0, q.cast("string")).alias("truth_key"), F.when(s % 3 == 0, "AC-3").alias("truth_point"),
        F.when(p % 2 == 0, F.lit("a")).alias("truth_artifact"), F.lit(1).alias("truth_page"),
    )
    predicted = rows.where("l_partkey % 10 <> 0").select(
        "case_id", "feature", (s % 4 != 0).alias("accepted"), (q + F.when(p % 8 == 0, 1).otherwise(0)).cast("string").alias("value_key"), F.when(s % 6 == 0, "AC-3").when(s % 6 == 3, "AC-1").alias("point"), (s % 5 != 0).alias("verified"),
        F.when(p % 7 == 0, F.lit(None)).when(p % 3 == 0, "A").otherwise("B").alias("grade"), F.lit("a").alias("artifact"), F.when(p % 14 == 0, 2).otherwise(1).alias("page"),
    )
    return R.judgements(_cases(spark, sf_dir), _predictions(spark, sf_dir), expected, predicted)


def evaluation_report(spark, sf_dir):
    """Numerators and denominators of a whole evaluation, at five levels from one scan."""
    return R.report(_judged(spark, sf_dir))


def evaluation_rates(spark, sf_dir):
    """The rates of each split."""
    out = R.rates(R.report(_judged(spark, sf_dir)).where("level = 'SPLIT'"))
    return out.select("split", *[F.round(f"{r}_rate", 9).alias(f"{r}_rate") for r in R.RATIOS], F.round("unsupported_rate", 9).alias("unsupported_rate"), F.round("selective_risk", 9).alias("selective_risk"))


def case_set_fingerprint(spark, sf_dir):
    """One digest of all cases, under any partitioning."""
    return R.set_fingerprint(_cases(spark, sf_dir), "case_id", ["case_id", "split", "family", "disposition", "exact_mpn"])


def unexpected_predictions(spark, sf_dir):
    return R.unexpected(_predictions(spark, sf_dir).where("case_id % 3 = 0"), _cases(spark, sf_dir).where("split = 'dev'"))


def record_violations(spark, sf_dir):
    """Every constraint that each order, read as a record of attributes, breaks."""
    k, p, s = F.col("o_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    records = read(spark, sf_dir, "orders").select(k.alias("record_id"), F.when(k % 4 == 0, "FAMILY_OR_INCOMPLETE").otherwise("EXACT").alias("disposition"), F.concat(F.lit("M"), k.cast("string")).alias("mpn"), F.when(k % 10 == 0, "EC12").when(k % 10 != 1, F.lpad(F.concat(F.lit("EC"), F.lpad((k % 1000000).cast("string"), 6, "0")), 8, "0")).alias("class_id"))
    feature = F.concat(F.lit("F"), (p % 40).cast("string"))
    anchor = F.when(p % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit(" m"), (F.col("l_orderkey") + F.when(p % 9 == 0, 1).otherwise(0)).cast("string")))
    attributes = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), feature.alias("feature"), anchor.alias("anchor_mpn"), (s % 3 != 0).alias("accepted"), F.when(s % 4 == 0, "PROVEN").otherwise("NOT_REQUIRED").alias("family_invariance"), (s % 7 != 0).alias("verified"), F.when(p % 8 == 0, "NOT_APPLICABLE").otherwise("APPLICABLE").alias("applicability"))
    return R.record_violations(records, attributes)


QUERIES = {f.__name__: f for f in (evaluation_report, evaluation_rates, case_set_fingerprint, unexpected_predictions, record_violations)}

_CASES = """
    cases AS (
        SELECT o_orderkey AS case_id, CASE WHEN o_custkey % 3 = 0 THEN 'locked' ELSE 'dev' END AS split, o_orderpriority AS family,
               CASE WHEN o_orderkey % 5 = 0 THEN 'UNKNOWN' ELSE 'EXACT' END AS disposition, CASE WHEN o_orderkey % 5 <> 0 THEN 'm ' || o_orderkey END AS exact_mpn
        FROM orders
    ), predictions AS (
        SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 13 = 0 THEN 'TIMEOUT' ELSE 'COMPLETED' END AS outcome, CASE WHEN o_orderkey % 7 = 0 THEN 'EXACT' WHEN o_orderkey % 5 = 0 THEN 'UNKNOWN' ELSE 'EXACT' END AS said,
               'M' || (o_orderkey + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END) AS said_mpn
        FROM orders WHERE o_orderkey % 11 <> 0
    )
"""
_JUDGED = f"""
    WITH {_CASES}, held AS (
        SELECT c.*, p.outcome, p.said, p.said_mpn, coalesce(p.outcome = 'COMPLETED', false) AS ran FROM cases c LEFT JOIN predictions p USING (case_id)
    ), items AS (
        SELECT *, 'F' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS feature FROM lineitem
    ), met AS (
        SELECT split, family, feature, ran AND coalesce(l_partkey % 10 <> 0 AND l_suppkey % 4 <> 0, false) AS accepted, ran,
               l_partkey % 9 = 0 AS inapplicable, l_partkey % 9 = 1 AS unknown, l_partkey % 9 > 1 AS applies, l_partkey % 4 = 0 AS critical, l_partkey % 9 > 1 AND l_partkey % 6 <> 0 AS judgeable,
               l_partkey % 8 <> 0 AS value_right, l_partkey % 8 <> 0 AND (CASE WHEN l_suppkey % 6 = 0 THEN 'AC-3' WHEN l_suppkey % 6 = 3 THEN 'AC-1' END) IS NOT DISTINCT FROM (CASE WHEN l_suppkey % 3 = 0 THEN 'AC-3' END) AS whole_right,
               l_suppkey % 5 <> 0 AS verified, l_partkey % 2 = 0 AS known_place, l_partkey % 14 <> 0 AS page_right, CASE WHEN l_partkey % 7 = 0 THEN 'UNGRADED' WHEN l_partkey % 3 = 0 THEN 'A' ELSE 'B' END AS own_grade
        FROM items JOIN held ON l_orderkey = case_id
    ), judged AS (
        SELECT split, family, NULL AS feature, NULL AS grade, ran AND said = disposition AND (disposition <> 'EXACT' OR said_mpn = upper(replace(exact_mpn, ' ', ''))) AS identity_n, true AS identity_d,
               ran AND disposition <> 'EXACT' AND said = 'EXACT' AS false_exact_n, ran AND disposition <> 'EXACT' AS false_exact_d, false AS precision_n, false AS precision_d, false AS supported_n, false AS supported_d, false AS coverage_n, false AS coverage_d,
               false AS normalization_n, false AS normalization_d, false AS citations_n, false AS citations_d, false AS critical_n, false AS critical_d, outcome IS NULL AS missing_count, outcome IS NOT NULL AND NOT ran AS failed_count,
               false AS critical_withheld_count, false AS critical_unknown_count, false AS citations_open_count
        FROM held
        UNION ALL
        SELECT split, family, feature, CASE WHEN accepted AND judgeable THEN own_grade END, false, false, false, false, accepted AND judgeable AND whole_right, accepted AND (judgeable OR inapplicable), accepted AND applies AND verified, accepted AND applies,
               accepted AND judgeable, judgeable, accepted AND judgeable AND value_right, accepted AND judgeable, accepted AND judgeable AND known_place AND verified AND page_right, accepted AND judgeable AND known_place,
               accepted AND critical AND applies, critical AND CASE WHEN ran THEN applies ELSE NOT inapplicable END, false, false, critical AND CASE WHEN ran THEN applies ELSE NOT inapplicable END AND NOT accepted, ran AND critical AND unknown, accepted AND judgeable AND NOT known_place
        FROM met
    )
"""
_SUMS = ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in [f"{r}_{s}" for r in R.RATIOS for s in "nd"] + [f"{c}_count" for c in R.COUNTS])
_RATES = ", ".join(f"round({r}_n / nullif({r}_d, 0), 9) AS {r}_rate" for r in R.RATIOS)

ORACLE_SQL = {
    "evaluation_report": f"""
        {_JUDGED} SELECT * FROM (
            SELECT CASE grouping(split, family, feature, grade) WHEN 15 THEN 'ALL' WHEN 7 THEN 'SPLIT' WHEN 3 THEN 'FAMILY' WHEN 5 THEN 'FEATURE' ELSE 'GRADE' END AS level, split, family, feature, grade, {_SUMS}
            FROM judged GROUP BY GROUPING SETS ((), (split), (split, family), (split, feature), (split, grade)))
        WHERE NOT (level = 'FEATURE' AND feature IS NULL) AND NOT (level = 'GRADE' AND grade IS NULL)
    """,
    "evaluation_rates": f"""
        {_JUDGED}, sums AS (SELECT split, {_SUMS} FROM judged GROUP BY split)
        SELECT split, {_RATES}, round(1 - supported_n / nullif(supported_d, 0), 9) AS unsupported_rate, round(1 - precision_n / nullif(precision_d, 0), 9) AS selective_risk FROM sums
    """,
    "case_set_fingerprint": f"""
        WITH {_CASES}, digests AS (
            SELECT case_id::VARCHAR AS k, sha256('{{"case_id":' || case_id || ',"split":"' || split || '","family":"' || family || '","disposition":"' || disposition || '","exact_mpn":' || coalesce('"' || exact_mpn || '"', 'null') || '}}') AS d FROM cases
        ), leaves AS (
            SELECT substr(sha256(k), 1, 4) AS leaf, count(*) AS n, sha256(string_agg(d, '' ORDER BY k, d)) AS d FROM digests GROUP BY 1
        ), branches AS (
            SELECT substr(leaf, 1, 2) AS branch, sum(n) AS n, sha256(string_agg(d, '' ORDER BY leaf)) AS d FROM leaves GROUP BY 1
        )
        SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY branch)) AS fingerprint FROM branches
    """,
    "unexpected_predictions": "SELECT o_orderkey AS case_id FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 3 = 0 AND o_custkey % 3 = 0",
    "record_violations": """
        WITH records AS (
            SELECT o_orderkey AS record_id, o_orderkey % 4 <> 0 AS exact, CASE WHEN o_orderkey % 10 = 0 THEN 'EC12' WHEN o_orderkey % 10 <> 1 THEN 'EC' || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') END AS class_id FROM orders
        ), attributes AS (
            SELECT record_id, exact, 'F' || l_partkey % 40 AS feature, l_partkey % 5 = 0 AS loose, l_partkey % 5 <> 0 AND l_partkey % 9 <> 0 AS tied, l_suppkey % 3 <> 0 AS accepted, l_suppkey % 4 = 0 AS proven, l_suppkey % 7 <> 0 AS verified, l_partkey % 8 = 0 AS inapplicable
            FROM lineitem JOIN records ON l_orderkey = record_id
        ), broken AS (
            SELECT record_id, feature, unnest([CASE WHEN exact AND NOT tied THEN 'ANCHOR_NOT_RESOLVED_IDENTITY' END, CASE WHEN NOT exact AND NOT loose THEN 'ANCHOR_WITHOUT_EXACT_IDENTITY' END, CASE WHEN NOT exact AND accepted AND NOT proven THEN 'ACCEPTED_WITHOUT_FAMILY_PROOF' END,
                CASE WHEN exact AND proven THEN 'FAMILY_PROOF_UNDER_EXACT_IDENTITY' END, CASE WHEN accepted AND NOT verified THEN 'ACCEPTED_WITHOUT_VERIFIED_EVIDENCE' END, CASE WHEN accepted AND inapplicable THEN 'ACCEPTED_NOT_APPLICABLE' END]) AS violation
            FROM attributes
        )
        SELECT record_id, violation, count(*) AS n, min(feature) AS first_feature FROM broken WHERE violation IS NOT NULL GROUP BY 1, 2
        UNION ALL SELECT record_id, 'FEATURE_GIVEN_TWICE', count(*), min(feature) FROM (SELECT record_id, feature FROM attributes GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1
        UNION ALL SELECT record_id, 'MALFORMED_CLASS_ID', 1, NULL FROM records WHERE NOT regexp_full_match(class_id, 'EC[0-9]{6}')
    """,
}
