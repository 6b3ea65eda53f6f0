"""Queries over outcomes, exports and rule tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.operators import outcomes as O
from catalith.plans.catalog import read

_FILES = [("a.csv", 10), ("b.XLSX", 5 * 1024 * 1024), ("c.xlsx", 5 * 1024 * 1024 + 1), ("d.exe", 9), ("e.csv", 0), ("csv", 3), ("f.csv.zip", 3), ("", 1)]


def grid_cells(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit(" \t"), "o_orderstatus", F.lit(" ")).alias("status"), F.to_date("o_orderdate").alias("day"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("customer"))
    return O.cell_texts(rows)


def analyze_requests(spark, sf_dir):
    c = F.col
    rows = read(spark, sf_dir, "part").select(c("p_partkey").cast("string").alias("Mfg_Part_Num"), c("p_name").alias("Part_Desc"), c("p_brand").alias("E1_Brand"), c("p_type").alias("Unilog_Brand"), F.lit(None).cast("string").alias("DIB_Brand"), c("p_brand").alias("Part_Manuf"))
    return O.analyze_request(rows)


def known_cases(spark, sf_dir):
    """Line items of parts that are recorded cases, by case."""
    cases = read(spark, sf_dir, "part").where("p_size < 10").select(F.concat(F.lit("p-"), F.col("p_partkey").cast("string")).alias("mpn"), F.concat(F.lit("SIZE "), "p_size").alias("case"))
    rows = read(spark, sf_dir, "lineitem").select(F.concat(F.lit(" P-"), "l_partkey", F.lit(" ")).alias("number"))
    return O.known_case(rows, cases, "number").groupBy("case").agg(F.count(F.lit(1)).alias("n"))


def outcome_counts(spark, sf_dir):
    """How many line items are among those of each outcome; items may be of several."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    step = F.when(s % 5 == 0, "BLOCKED").when(s % 5 == 1, "WITHHELD").when(s % 5 == 2, "REVIEW").when(s % 5 == 3, "NOT_RUN").otherwise("DONE")
    rows = read(spark, sf_dir, "lineitem").select(
        (p % 7 != 0).alias("analyzed"), (p % 3 != 0).alias("detailed"), F.when(n != 3, F.array(F.lit("DONE"), step)).alias("statuses"),
        (n % 2).alias("verified"), F.when(p % 2 == 0, n % 3).alias("withheld"), F.when(s % 2 == 0, "NOT_RUN").otherwise("RAN").alias("discovery_status"),
    )
    return rows.agg(*[F.count_if(O.outcome_matches(x)).alias(x.lower()) for x in O.OUTCOMES])


def upload_checks(spark, sf_dir):
    rows = spark.createDataFrame(_FILES, "file_name string, size long")
    return rows.select("file_name", O.upload_problem("file_name", "size").alias("problem"))


def verified_facts(spark, sf_dir):
    """Each order as an analysed product, its line items as verified facts."""
    n = F.col("l_linenumber")
    fact = F.struct(
        F.concat(F.lit("L"), n).alias("label"), F.col("l_quantity").cast("int").cast("string").alias("value"), F.when(n % 2 == 0, "mm").alias("uom"), F.col("l_returnflag").alias("authority"),
        F.col("l_linestatus").alias("status"), (F.col("l_partkey") % 3 == 0).alias("delivery_eligible"), F.when(F.col("l_suppkey") % 2 == 0, "UNMAPPED").alias("mapping_status"),
    )
    results = read(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("m"), "l_orderkey").alias("mpn")).agg(F.collect_list(fact).alias("verified"))
    return O.verified_facts(results)


def csv_lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", O.csv_line(["doc_id", "text", "lang"]).alias("line"))


def _entries(spark, sf_dir):
    """Nations as manufacturers, in registries by region."""
    r = F.col("n_regionkey")
    authority = F.when(r == 0, "OFFICIAL").when(r < 3, "REVIEWED").when(r == 3, "SEED")
    domains = F.array(F.concat(F.lower("n_name"), F.lit(".example")), F.concat(F.lit("www."), F.lower("n_name"), F.lit(".example")))
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), domains.alias("domains"), authority.alias("authority"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_nationkey") % 3 == 1).alias("reviewed"), r.alias("registry"))


def entry_licenses(spark, sf_dir):
    return _entries(spark, sf_dir).select("key", O.licenses("authority", "reviewed").alias("licenses"))


def corpus_patterns(spark, sf_dir):
    return O.corpus_patterns(_entries(spark, sf_dir))


def registry_authority(spark, sf_dir):
    """Registries by region, and as many that have no rules."""
    regions = read(spark, sf_dir, "region")
    registries = regions.select(F.col("r_regionkey").alias("registry")).union(regions.select(F.col("r_regionkey") + 10))
    return O.authoritative(_entries(spark, sf_dir), registries)


def evidence_gates(spark, sf_dir):
    """Line items by what their evidence may do."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = read(spark, sf_dir, "lineitem").select(
        F.when(p % 3 == 0, "EXACT").when(p % 3 == 1, "FAMILY").alias("disposition"), F.when(s % 3 == 0, "").when(s % 3 == 1, "m").alias("mpn"), F.when(p % 4 == 0, "EXACT_SKU").when(p % 4 == 1, "FAMILY").when(p % 4 == 2, "RANGE").alias("scope"),
        F.when(s % 4 > 0, s % 2 == 0).alias("proves"), F.when(s % 5 == 0, "SPEC_TABLE").when(s % 5 == 1, "SPEC_LINE").when(s % 5 == 2, "STRUCTURED_API").when(s % 5 == 3, "PROSE").alias("modality"), F.concat(F.lit(" "), F.when(p % 2 == 0, "x").otherwise("7")).alias("raw"),
    )
    out = rows.select(O.identity_refusal("disposition", "mpn").alias("refusal"), O.establishes_scope("scope", "proves").alias("scoped"), O.is_structured("modality").alias("structured"), O.integer_or("raw", 0).cast("long").alias("number"))
    return out.groupBy("refusal", "scoped", "structured", "number").agg(F.count(F.lit(1)).alias("n"))


def run_totals(spark, sf_dir):
    """Orders as the rows of a run, by status; their line items as candidates."""
    s = F.col("l_suppkey")
    authority = F.when(s % 3 == 0, "APPROVED_MANUFACTURER").when(s % 3 == 1, "UNVERIFIED_MANUFACTURER").otherwise("UNKNOWN")
    candidate = F.struct(authority.alias("authority"), F.when(F.col("l_partkey") % 2 == 0, "EXACT").alias("relevance"), F.when(s % 5 > 0, s % 5 == 1).alias("licensing"))
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(candidate).alias("candidates"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    words = lambda n: F.split(F.repeat(F.lit("q"), n.cast("int")), "")
    rows = read(spark, sf_dir, "orders").join(items, k == F.col("l_orderkey"), "left").select(
        words(k % 3 + 1).alias("requested"), F.when(k % 4 > 0, words(F.lit(2))).alias("executed"), (c % 7).alias("results"), "candidates", F.when(c % 2 == 0, c % 5).alias("attempts"), (c % 2).alias("successes"), (c % 3).alias("artifacts"),
    )
    return O.run_totals(rows)


QUERIES = {f.__name__: f for f in (
    grid_cells, analyze_requests, known_cases, outcome_counts, upload_checks, verified_facts, csv_lines, entry_licenses, corpus_patterns, registry_authority, evidence_gates, run_totals,
)}

_ENTRIES = """e AS (SELECT n_name, lower(n_name) AS d, n_regionkey = 0 OR (n_regionkey IN (1, 2) AND n_nationkey % 3 = 1) AS ok FROM nation)"""
ORACLE_SQL = {
    "grid_cells": "SELECT o_orderkey::VARCHAR AS o_orderkey, trim(o_orderstatus) AS status, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_custkey % 2 = 0 THEN o_custkey::VARCHAR ELSE '' END AS customer FROM orders",
    "analyze_requests": "SELECT p_partkey::VARCHAR AS mpn, p_name AS description, p_brand AS e1_brand, p_type AS unilog_brand, NULL::VARCHAR AS dib_brand, p_brand AS manufacturer FROM part",
    "known_cases": "SELECT CASE WHEN p_size < 10 THEN concat('SIZE ', p_size) END AS case, count(*) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1",
    "outcome_counts": """WITH x AS (SELECT l_partkey % 7 <> 0 AS a, l_partkey % 3 <> 0 AS d, CASE WHEN l_linenumber <> 3 THEN l_suppkey % 5 ELSE 9 END AS st, l_linenumber % 2 = 1 AS v, l_partkey % 2 = 0 AND l_linenumber % 3 > 0 AS w, l_suppkey % 2 = 0 AS nr FROM lineitem)
        SELECT count(*) AS "all", count(*) FILTER (a) AS analyzed, count(*) FILTER (a AND d AND v) AS verified, count(*) FILTER (a AND (NOT d OR st = 3)) AS partial, count(*) FILTER (a AND d AND st = 0) AS blocked,
        count(*) FILTER (a AND d AND (w OR st IN (1, 2))) AS review, count(*) FILTER (a AND d AND nr AND NOT v) AS no_evidence FROM x""",
    "upload_checks": f"""WITH f(file_name, size) AS (VALUES {', '.join(f"('{n}', {s}::BIGINT)" for n, s in _FILES)}) SELECT file_name, CASE WHEN NOT regexp_matches(lower(file_name), '(^|[.])(csv|xlsx)$') THEN 'WRONG_FILE_TYPE' WHEN size > {O.MAX_FILE_BYTES} THEN 'OVERSIZED_FILE' WHEN size = 0 THEN 'EMPTY_FILE' END AS problem FROM f""",
    "verified_facts": """SELECT concat('m', l_orderkey) AS mpn, concat('L', l_linenumber) AS label, l_quantity::INT::VARCHAR AS value, CASE WHEN l_linenumber % 2 = 0 THEN 'mm' ELSE '' END AS uom, l_returnflag AS authority, l_linestatus AS status,
        CASE WHEN l_partkey % 3 = 0 THEN 'AUTHORIZED' WHEN l_suppkey % 2 = 0 THEN 'UNMAPPED' ELSE '' END AS delivery FROM lineitem""",
    "csv_lines": """SELECT doc_id, concat(doc_id, ',', CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN concat('"', replace(text, '"', '""'), '"') ELSE coalesce(text, '') END, ',', coalesce(lang, '')) AS line FROM documents""",
    "entry_licenses": f"WITH {_ENTRIES} SELECT n_name AS key, ok AS licenses FROM e",
    "corpus_patterns": f"WITH {_ENTRIES} SELECT n_name AS key, concat(w, d, '.example/*') AS pattern FROM e CROSS JOIN (VALUES (''), ('www.')) AS t(w) WHERE ok",
    "registry_authority": "SELECT r_regionkey AS registry, r_regionkey = 0 AND EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 0) AS authoritative FROM region UNION ALL SELECT r_regionkey + 10, false FROM region",
    "evidence_gates": """SELECT CASE WHEN l_partkey % 3 = 0 AND l_suppkey % 3 = 1 THEN NULL ELSE 'IDENTITY_NOT_EXACT' END AS refusal, l_partkey % 4 = 0 OR (l_partkey % 4 = 1 AND l_suppkey % 4 = 2) AS scoped, l_suppkey % 5 < 3 AS structured, CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE 7 END::BIGINT AS number, count(*) AS n
        FROM lineitem GROUP BY ALL""",
    "run_totals": """WITH c AS (SELECT count(*) AS candidates, count(*) FILTER (l_suppkey % 3 < 2) AS manufacturer_hosts, count(*) FILTER (l_partkey % 2 = 0) AS exact, count(*) FILTER (l_suppkey % 5 = 1) AS licensing FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
        SELECT count(*) AS rows, sum(o_orderkey % 3 + 1)::BIGINT AS queries, 2 * count(*) FILTER (o_orderkey % 4 > 0) AS provider_queries, sum(o_custkey % 7)::BIGINT AS results, any_value(candidates) AS candidates, any_value(manufacturer_hosts) AS manufacturer_hosts, any_value(exact) AS exact,
        any_value(licensing) AS licensing, sum(CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 5 ELSE 0 END)::BIGINT AS fetch_attempts, sum(o_custkey % 2)::BIGINT AS fetch_successes, sum(o_custkey % 3)::BIGINT AS artifacts FROM orders CROSS JOIN c""",
}
