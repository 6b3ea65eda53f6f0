"""Queries over records made of evidence, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.operators import records as R
from catalith.plans.catalog import read

CAPACITY = 5


def _items(spark, sf_dir):
    """Line items, numbered in their order: l_linenumber isn't unique there."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return read(spark, sf_dir, "lineitem").withColumn("n", n)


def _table_cells(spark, sf_dir):
    """Each order as a table on a page: a header row, and a row for each line item."""
    items = _items(spark, sf_dir)
    n = F.col("l_orderkey")
    body = items.select(n.alias("page"), F.lit(0).alias("table_index"), F.col("n").alias("row_index"), F.lit(False).alias("is_header"), F.array(
        F.concat(F.lit("q-"), F.col("l_partkey").cast("string")), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" mm")), F.concat(F.col("n").cast("string"), F.lit(" kg")), F.col("l_returnflag"),
    ).alias("row"))
    head = items.select(n.alias("page")).distinct().select("page", F.lit(0).alias("table_index"), F.lit(0).alias("row_index"), F.lit(True).alias("is_header"), F.array(*map(F.lit, ("Part", "Size", "", "Flag"))).alias("row"))
    cells = body.unionByName(head).select("page", "table_index", "row_index", "is_header", F.posexplode("row").alias("column_index", "text"))
    return cells.where("text <> '' OR column_index = 2")


def _table_claims(spark, sf_dir):
    k, n = F.col("l_orderkey"), F.col("n")
    weight = F.struct((n + F.when(F.col("l_suppkey") % 4 == 0, 1).otherwise(0)).cast("double").alias("number"), F.lit("kg").alias("unit"))
    return _items(spark, sf_dir).select(
        F.concat_ws("-", k, n).alias("claim_id"), k.alias("page"), F.when(F.col("l_partkey") % 7 == 0, "q-none").otherwise(F.concat(F.lit("Q - "), F.col("l_partkey").cast("string"))).alias("mpn"),
        ((F.col("l_quantity").cast("int") + F.when(F.col("l_partkey") % 5 == 0, 100).otherwise(0)) / 10).cast("double").alias("number"), F.lit("cm").alias("unit"),
        F.when(F.col("l_suppkey") % 2 == 0, F.array(weight)).alias("conditions"),
    )


def table_row_evidence(spark, sf_dir):
    out = R.row_evidence(_table_claims(spark, sf_dir), _table_cells(spark, sf_dir))
    return out.select("claim_id", F.col("row_index").cast("long").alias("row_index"), F.col("identity_column").cast("long").alias("identity_column"), "identity_cell", "text")


def table_verification(spark, sf_dir):
    pages = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.when(F.col("o_orderkey") % 11 == 0, "NO_RULING").otherwise("TABLES_EXTRACTED").alias("status"))
    out = R.verify_in_tables(_table_claims(spark, sf_dir), _table_cells(spark, sf_dir), pages)
    return out.select("claim_id", "status", "failure", F.col("row_index").cast("long").alias("row_index"))


def _facts(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    decision = F.when(p % 6 == 0, "WITHHOLD").when(p % 6 == 1, "UNMAPPED").when(p % 6 == 2, "REVIEW").otherwise("COMMIT")
    reason = F.when((p % 6 == 2) & (s % 3 == 0), "CONFLICT").when((p % 6 == 2) & (s % 3 == 1), "MULTIPLE_OPERATING_POINTS").otherwise("OTHER")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("T"), (s % 5).cast("string")).alias("target"), F.concat_ws("-", p, "l_linenumber").alias("source_key"), (p % 3).alias("priority"), decision.alias("decision"), reason.alias("reason"), (p % 4 != 0).alias("verified"))


def assembly_slots(spark, sf_dir):
    return R.in_slots(_facts(spark, sf_dir), ["l_orderkey"], CAPACITY).select("l_orderkey", "target", "source_key", F.col("slot").cast("long").alias("slot"), "contested", "fits")


def assembly_summary(spark, sf_dir):
    out = R.assembly_summary(_facts(spark, sf_dir), ["l_orderkey"], CAPACITY)
    return out.withColumn("contested_targets", F.array_join("contested_targets", ","))


def coverage_report(spark, sf_dir):
    p = F.col("l_partkey")
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", F.when(p % 3 == 0, "APPLICABLE").when(p % 3 == 1, "NOT_APPLICABLE").alias("applicability"), (p % 2 == 0).alias("accepted"), (F.col("l_linenumber") == 1).alias("buyer_critical"))
    out = R.coverage(rows, ["l_suppkey"]).withColumn("problem", R.coverage_problem())
    return out.withColumns({c: F.round(c, 9) for c in ("feature_coverage", "critical_coverage")})


def licensing_groups(spark, sf_dir):
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", (n % 3).alias("group"), (p % 5 != 0).alias("verified"), (F.col("l_suppkey") % 4 != 0).alias("eligible"), (n % 3).cast("string").alias("group_key"), F.concat(F.lit(" raw "), (n % 3).cast("string")).alias("group_raw"),
        F.when(F.col("l_orderkey") % 13 != 0, (F.col("l_orderkey") % 3).cast("string")).alias("value_key"), F.concat(F.lit("raw "), (F.col("l_orderkey") % 2).cast("string")).alias("value_raw"), (F.col("l_orderkey") % 5 == 0).alias("derived"),
    )
    return R.licensing(rows, ["l_orderkey"])


def record_comparison(spark, sf_dir):
    """Each customer's orders by slot, against those of the next customer."""
    slot = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record"), slot.alias("slot"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("value"), F.when(F.col("o_orderkey") % 2 == 0, "mm").alias("uom"))
    pairs = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("first"), (F.col("c_custkey") + 1).alias("second"))
    return R.compared_slots(rows, pairs)


def _answers(spark, sf_dir):
    entry = lambda **k: F.to_json(F.struct(*[v.alias(n) for n, v in k.items()]))
    n = F.col("page_id") % 4
    items = [
        F.lit('"noise"'), entry(title=F.lit("no url")), entry(url=F.concat(F.lit(" "), "url", F.lit(" ")), title=F.lit(" t "), rank=n, publisher_host=F.when(n == 1, "h.example")),
        F.lit('{"_provider_executed_queries":[]}'), F.concat(F.lit('{"url":"https://x.example/","_provider_executed_queries":[" a ","",'), F.to_json(F.array(n.cast("string"))).substr(2, 3), F.lit("]}")),
    ]
    return read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]")).alias("payload"))


def search_rows(spark, sf_dir):
    return R.search_results(_answers(spark, sf_dir), "payload").withColumn("rank", F.col("rank").cast("long"))


def search_rows_first(spark, sf_dir):
    """One result at most, by place: the limit is the provider's feature."""
    return R.search_results(_answers(spark, sf_dir), "payload", limit=1, own_rank=False).select("page_id", "url", F.col("rank").cast("long").alias("rank"))


def provider_queries(spark, sf_dir):
    return _answers(spark, sf_dir).select("page_id", F.array_join(R.executed_queries("payload"), "|").alias("queries"))


def source_types(spark, sf_dir):
    n = F.col("l_partkey")
    name = lambda c: F.when(c == 0, "APPROVED_MANUFACTURER").when(c == 1, "KNOWN_DISTRIBUTOR")
    kind = F.when(n % 3 == 0, "PRODUCT_PAGE").when(n % 3 == 1, "DATASHEET").otherwise("PDF_DOCUMENT")
    exact = R.supports_exact(F.when(n % 4 == 0, "RANGE").otherwise("EXACT_SKU"), F.concat(F.lit("m "), n), F.concat(F.lit("M"), n + F.when(n % 7 == 0, 1).otherwise(0)))
    authority = R.effective_authority(name(F.col("l_suppkey") % 3), name(F.col("l_linenumber") % 2))
    rows = read(spark, sf_dir, "lineitem").select(authority.alias("authority"), R.source_type(authority, kind).alias("source_type"), exact.alias("exact"))
    return rows.groupBy("authority", "source_type", "exact").agg(F.count(F.lit(1)).alias("n"))


def domain_reviews(spark, sf_dir):
    """Regions as manufacturers, their nations as domains; reviews confirm all, one too few, one too many, or an unknown one."""
    own = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.lower("n_name")).alias("domains"))
    entries = read(spark, sf_dir, "region").join(own, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("key"), "domains", (F.col("r_regionkey") == 1).alias("reviewed"), "r_regionkey")
    said = F.when(F.col("r_regionkey") == 2, F.array_sort("domains")[0]).otherwise(F.lit(None))
    domains = F.filter(F.col("domains"), lambda d: ~F.coalesce(d == said, F.lit(False)))
    reviews = entries.select(F.when(F.col("r_regionkey") == 4, "NOBODY").otherwise(F.col("key")).alias("key"), F.when(F.col("r_regionkey") == 3, F.concat(F.transform(domains, lambda d: F.concat(F.lit(" "), F.upper(d))), F.array(F.lit("zz.example")))).otherwise(domains).alias("domains"))
    return R.review_verdicts(reviews, entries.drop("r_regionkey"))


_HEADERS = ["MFR URL", "Ref URL 12", "Dept", "BRAND_NAME", "UNSPSC", "LONG_DESC2", "ITEM_FEATURES_3", "Prop 65", "ATTRIBUTE_UOM 50", "GTIN", "Warranty", "WEIGHT_UOM", "SDS_2", "Video Link", "Discontinued", "LONG_DESCx", "ATTRIBUTE_LABEL", "x MFR URL"]


def header_groups(spark, sf_dir):
    rows = spark.createDataFrame([(h,) for h in _HEADERS], "header string")
    return rows.select("header", R.header_group(F.col("header")).alias("group_name"))


def row_widths(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("fields"))
    return R.width_issues(rows, "fields", 1).select("doc_id", "found")


def operating_points(spark, sf_dir):
    mine = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"))
    truth = F.when(F.col("l_partkey") % 2 == 0, F.create_map(F.lit("status"), F.lit("O"), F.lit("flag"), F.lit("N"))).otherwise(F.create_map(F.lit("flag"), F.lit("N")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", R.same_operating_point(mine, truth).alias("same"))


QUERIES = {f.__name__: f for f in (
    table_row_evidence, table_verification, assembly_slots, assembly_summary, coverage_report, licensing_groups, record_comparison, search_rows, search_rows_first, provider_queries, source_types, domain_reviews,
    header_groups, row_widths, operating_points,
)}

_CLAIMS = """i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
    c AS (SELECT concat(l_orderkey, '-', n) AS claim_id, l_orderkey AS page, l_partkey AS p, l_quantity::INT + CASE WHEN l_partkey % 5 = 0 THEN 100 ELSE 0 END AS mm, CASE WHEN l_suppkey % 2 = 0 THEN n + CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END END AS kg FROM i)"""
_FACTS = """f AS (SELECT l_orderkey, concat('T', l_suppkey % 5) AS target, concat(l_partkey, '-', l_linenumber) AS source_key, l_partkey % 3 AS priority, l_partkey % 4 <> 0 AS verified,
    CASE l_partkey % 6 WHEN 0 THEN 'WITHHOLD' WHEN 1 THEN 'UNMAPPED' WHEN 2 THEN 'REVIEW' ELSE 'COMMIT' END AS decision, l_partkey % 6 = 2 AND l_suppkey % 3 < 2 AS contest FROM lineitem)"""
_ORDERS = "o AS (SELECT o_custkey AS record, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS slot, o_orderpriority AS label, o_orderstatus AS value, CASE WHEN o_orderkey % 2 = 0 THEN 'mm' ELSE '' END AS uom FROM orders)"
ORACLE_SQL = {
    "table_row_evidence": f"""WITH {_CLAIMS} SELECT claim_id, n AS row_index, 0::BIGINT AS identity_column, concat('q-', p) AS identity_cell, concat('Part Size Flag q-', p, ' ', l_quantity::INT, ' mm ', n, ' kg ', l_returnflag) AS text
        FROM c JOIN i ON l_orderkey = page AND l_partkey = p WHERE p % 7 <> 0""",
    "table_verification": f"""WITH {_CLAIMS}, r AS (SELECT claim_id, min(n) FILTER (l_quantity::INT = mm AND (kg IS NULL OR kg = n)) AS best FROM c JOIN i ON l_orderkey = page AND l_partkey = p GROUP BY 1),
        x AS (SELECT claim_id, best, CASE WHEN page % 11 = 0 THEN 'TABLE_STRUCTURE_UNRESOLVED' WHEN p % 7 = 0 THEN 'PRODUCT_REFERENCE_MISMATCH' WHEN best IS NULL THEN 'VALUE_NOT_SUPPORTED' END AS failure FROM c JOIN r USING (claim_id))
        SELECT claim_id, CASE WHEN failure IS NULL THEN 'EXACT_SPAN' ELSE 'UNVERIFIED' END AS status, failure, CASE WHEN failure IS NULL THEN best END AS row_index FROM x""",
    "assembly_slots": f"""WITH {_FACTS} SELECT l_orderkey, target, source_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY priority, target, source_key) AS slot, count(*) OVER (PARTITION BY l_orderkey, target) > 1 AS contested,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY priority, target, source_key) <= {CAPACITY} AS fits FROM f WHERE decision = 'COMMIT'""",
    "assembly_summary": f"""WITH {_FACTS}, s AS (SELECT l_orderkey, count(*) AS input_facts, count(*) FILTER (verified) AS verified, count(*) FILTER (decision = 'COMMIT') AS committed, count(*) FILTER (decision = 'WITHHOLD') AS withheld, count(*) FILTER (decision = 'UNMAPPED') AS unmapped,
        count(*) FILTER (decision = 'REVIEW') AS review, coalesce(string_agg(DISTINCT target, ',' ORDER BY target) FILTER (contest), '') AS contested_targets, count(DISTINCT target) FILTER (contest) AS conflicts FROM f GROUP BY 1),
        t AS (SELECT DISTINCT l_orderkey, true AS two FROM f WHERE decision = 'COMMIT' GROUP BY l_orderkey, target HAVING count(DISTINCT source_key) > 1),
        p AS (SELECT s.*, CASE WHEN two THEN 'CONTESTED_TARGET' WHEN committed > {CAPACITY} THEN 'SLOT_CAPACITY' END AS problem FROM s LEFT JOIN t USING (l_orderkey))
        SELECT *, CASE WHEN problem IS NULL THEN committed ELSE 0 END AS attributes_written, {CAPACITY}::BIGINT AS slots_available FROM p""",
    "coverage_report": """WITH s AS (SELECT l_suppkey, count(*) AS features_total, count(*) FILTER (l_partkey % 3 = 0) AS applicable_total, count(*) FILTER (l_partkey % 3 = 1) AS not_applicable_total, count(*) FILTER (l_partkey % 3 = 2) AS unknown_total,
        count(*) FILTER (l_partkey % 6 = 0) AS accepted_total, count(*) FILTER (l_linenumber = 1) AS critical_total, count(*) FILTER (l_linenumber = 1 AND l_partkey % 3 = 0) AS critical_applicable, count(*) FILTER (l_linenumber = 1 AND l_partkey % 6 = 0) AS critical_accepted FROM lineitem GROUP BY 1)
        SELECT *, round(accepted_total / nullif(applicable_total, 0), 9) AS feature_coverage, round(critical_accepted / nullif(critical_applicable, 0), 9) AS critical_coverage, NULL::VARCHAR AS problem FROM s""",
    "licensing_groups": """WITH m AS (SELECT l_orderkey, l_linenumber % 3 AS g, l_orderkey % 13 <> 0 AND (l_linenumber % 3 = l_orderkey % 3 OR (l_orderkey % 5 = 0 AND l_linenumber % 3 = l_orderkey % 2)) AND l_partkey % 5 <> 0 AND l_suppkey % 4 <> 0 AS ok FROM lineitem),
        g AS (SELECT l_orderkey, g, count(*) FILTER (ok) AS n FROM m GROUP BY 1, 2) SELECT l_orderkey, count(*) FILTER (n > 0) AS licensing_groups, sum(n)::BIGINT AS licensing_evidence FROM g GROUP BY 1""",
    "record_comparison": f"""WITH {_ORDERS}, p AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 2 = 0), x AS (SELECT a, b, o.* FROM p JOIN o ON record = a), y AS (SELECT a, b, o.* FROM p JOIN o ON record = b)
        SELECT coalesce(x.a, y.a) AS first, coalesce(x.b, y.b) AS second, coalesce(x.slot, y.slot) AS slot, coalesce(x.label, '') = coalesce(y.label, '') AS same_label,
        CASE WHEN x.value IS NULL OR y.value IS NULL THEN 'ONE_BLANK' WHEN x.value = y.value THEN 'IDENTICAL' ELSE 'DIFFERENT' END AS value_state, coalesce(x.uom, '') = coalesce(y.uom, '') AS same_uom FROM x FULL JOIN y ON x.a = y.a AND x.slot = y.slot""",
    "search_rows": """SELECT page_id, trim(url) AS url, 't' AS title, '' AS snippet, CASE WHEN page_id % 4 = 0 THEN 3 ELSE page_id % 4 END AS rank, CASE WHEN page_id % 4 = 1 THEN 'h.example' END AS publisher_host FROM pages WHERE trim(coalesce(url, '')) <> ''
        UNION ALL SELECT page_id, 'https://x.example/', '', '', 5, NULL FROM pages""",
    "search_rows_first": "SELECT page_id, CASE WHEN trim(coalesce(url, '')) <> '' THEN trim(url) ELSE 'https://x.example/' END AS url, CASE WHEN trim(coalesce(url, '')) <> '' THEN 3 ELSE 5 END::BIGINT AS rank FROM pages",
    "provider_queries": "SELECT page_id, concat('a|', page_id % 4) AS queries FROM pages",
    "source_types": """WITH x AS (SELECT l_partkey AS n, CASE l_suppkey % 3 WHEN 0 THEN 'APPROVED_MANUFACTURER' WHEN 1 THEN 'KNOWN_DISTRIBUTOR' ELSE CASE l_linenumber % 2 WHEN 0 THEN 'APPROVED_MANUFACTURER' ELSE 'KNOWN_DISTRIBUTOR' END END AS authority FROM lineitem)
        SELECT authority, CASE WHEN authority = 'APPROVED_MANUFACTURER' THEN CASE n % 3 WHEN 0 THEN 'MANUFACTURER_PAGE' WHEN 1 THEN 'MANUFACTURER_DATASHEET' END END AS source_type, n % 4 <> 0 AND n % 7 <> 0 AS exact, count(*) AS n FROM x GROUP BY 1, 2, 3""",
    "domain_reviews": """WITH e AS (SELECT r_regionkey AS k, r_name, list_sort(list(lower(n_name))) AS own FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2)
        SELECT CASE k WHEN 4 THEN 'NOBODY' ELSE r_name END AS key, CASE k WHEN 4 THEN 'UNKNOWN_MANUFACTURER' WHEN 1 THEN 'ALREADY_REVIEWED' WHEN 0 THEN 'APPLIES' ELSE 'DOMAINS_DIFFER' END AS verdict,
        CASE k WHEN 4 THEN NULL WHEN 2 THEN own[1] ELSE '' END AS missing, CASE k WHEN 4 THEN NULL WHEN 3 THEN 'zz.example' ELSE '' END AS extra FROM e""",
    "header_groups": f"""WITH h(header) AS (VALUES {', '.join(f"('{h}')" for h in _HEADERS)}) SELECT header, CASE {' '.join(f"WHEN regexp_matches(header, '{p}') THEN '{n}'" for n, p in R.HEADER_GROUPS)} ELSE 'other' END AS group_name FROM h""",
    "row_widths": "SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0) AS found FROM documents WHERE coalesce(len(string_split(text, chr(10))), 0) <> 1",
    "operating_points": "SELECT l_orderkey, l_linenumber, l_partkey % 2 = 0 AND l_returnflag = 'N' AND l_linestatus = 'O' AS same FROM lineitem",
}
