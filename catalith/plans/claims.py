"""Queries over claims, candidates and evidence, with their SQL twins: orders are pages and records, line items their lines, claims and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.operators import evaluation as V
from catalith.operators import evidence as E
from catalith.operators import verification as C
from catalith.operators.catalogue import FIELDS, exact_examples, slot_profile
from catalith.plans.catalog import read
from catalith.plans.records import _items


def _pages(spark, sf_dir):
    """A page for each order, with a line for each line item; some have drifted, some cover another number."""
    k = F.col("l_orderkey")
    line = F.concat(F.lit("q-"), F.col("l_partkey").cast("string"), F.lit("; "), F.when(F.col("l_suppkey") % 7 == 0, "< ").otherwise(""), F.col("l_quantity").cast("int").cast("string"), F.lit(" mm; flag "), F.col("l_returnflag"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n")
    pages = _items(spark, sf_dir).groupBy("l_orderkey").agg(text.alias("text"))
    covers = F.when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, "O-0").otherwise(F.concat(F.lit(" o-"), k.cast("string")))
    return pages.select(F.sha2(k.cast("string"), 256).alias("sha"), F.when(k % 19 == 0, 2).otherwise(1).alias("page"), "text", F.when(k % 23 == 0, F.lit("x")).otherwise(F.sha2("text", 256)).alias("text_sha"), covers.alias("covers_mpn"))


def claim_verification(spark, sf_dir):
    """Each line item's claim against the page that is said to state it."""
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    mpn = F.concat(F.lit("O-"), k.cast("string"))
    claims = _items(spark, sf_dir).select(
        F.concat_ws("-", k, "n").alias("claim_id"), F.when(k % 29 == 0, "no hash").otherwise(F.sha2(F.when(k % 31 == 0, F.lit("none")).otherwise(k.cast("string")), 256)).alias("sha"), F.lit(1).alias("page"), mpn.alias("mpn"),
        F.when(p % 37 == 0, F.lit(None)).when(p % 41 == 0, "O-1x").otherwise(F.lower(mpn)).alias("resolved_mpn"), F.when(p % 11 == 0, "q-none;").otherwise(F.concat(F.lit("q-"), p.cast("string"), F.lit(";"))).alias("fragment"),
        F.when(p % 5 == 0, "alphanumeric").when(p % 43 == 0, "logical").otherwise("numeric").alias("kind"), F.when(p % 3 == 0, F.col("l_quantity") / 10).when(p % 3 == 1, F.col("l_quantity")).otherwise(F.col("l_quantity") + F.when(p % 2 == 0, 1).otherwise(0)).cast("double").alias("number"),
        F.when(p % 3 == 0, "cm").when(p % 9 == 1, "V").otherwise("mm").alias("unit"), F.concat(F.lit("flag "), F.when(p % 2 == 0, F.col("l_returnflag")).otherwise("Z")).alias("value"),
    )
    return C.verify(claims, _pages(spark, sf_dir))


def resolved_attributes(spark, sf_dir):
    """Profile slots of each order from the candidates that its line items make."""
    k, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    slots = F.inline(F.array(*[F.struct(F.lit(f"s{i}").alias("slot_key"), F.lit(f"L{i}").alias("label"), F.lit("numeric" if i % 2 else None).alias("kind"), F.lit("mm" if i == 1 else None).alias("uom")) for i in range(4)]))
    profile = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record"), slots)
    i = (s % 4).cast("string")
    candidates = _items(spark, sf_dir).select(
        k.alias("record"), F.concat(F.lit("s"), i).alias("slot_key"), F.concat_ws("-", k, "n").alias("candidate_id"), F.concat(F.lit("L"), F.when(p % 23 == 0, "x").otherwise(i)).alias("label"), F.when(p % 13 == 0, "text").otherwise("numeric").alias("value_kind"),
        F.when(p % 5 != 0, "mm").alias("value_uom"), F.when(p % 7 != 0, (p % 2).cast("string")).alias("value_key"), (p % 3 != 0).alias("eligible"), F.when(p % 11 == 0, "REVIEW").otherwise("WITHHOLD").alias("decision"), F.col("n").alias("rank"),
    )
    return C.resolve_slots(profile, candidates)


def evidence_standing(spark, sf_dir):
    """Whether each line item, read as an attribute with its evidence, may be delivered, and what its evidence may speak for."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    piece = F.struct(F.when(p % 5 != 0, "a").alias("artifact"), F.when(p % 3 != 0, "l").alias("locator"), F.when(p % 7 != 0, p % 2 == 0).alias("verified"))
    evidence = F.when(s % 6 != 0, F.array(piece))
    authority = F.get(F.array(*map(F.lit, ("ORGANIZER_EXAMPLE", "MANUFACTURER_EVIDENCE", "HUMAN_APPROVED", "MODEL_PROPOSAL"))), (s % 4).cast("int"))
    decision, value, unit = F.when(p % 4 == 0, "REVIEW").otherwise("COMMIT"), F.when(p % 8 != 1, "v"), F.when(p % 9 == 0, "UNRESOLVED").otherwise("EXACT")
    rows = read(spark, sf_dir, "lineitem").select(
        E.has_value_authority(authority, evidence).alias("standing"), E.delivery_eligible(decision, value, unit, authority, evidence).alias("eligible"),
        E.eligible_evidence(F.when(p % 2 == 0, "EXACT_SKU").otherwise("RANGE"), F.when(p % 3 != 0, F.concat(F.lit("M"), (s % 2).cast("string"))), F.lit("M1")).alias("in_scope"),
        E.value_present(F.concat(F.lit("w "), F.col("l_quantity").cast("int").cast("string"), F.lit(" mm")), F.col("l_quantity").cast("int").cast("string"), F.when(p % 3 == 0, "mm").when(p % 3 == 1, "cm"), p % 6 == 2).alias("present"),
    )
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def best_members(spark, sf_dir):
    """The strongest piece of evidence of each order."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    members = _items(spark, sf_dir).select("l_orderkey", (p % 3).alias("verification_order"), (s % 2).alias("scope_order"), (p % 2).alias("modality_order"), (s % 5 == 0).alias("manufacturer"), F.col("n").alias("ordinal"), F.concat_ws("-", "l_orderkey", "n").alias("member_id"))
    return E.best_member(members, ["l_orderkey"])


def support_grades(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    members = read(spark, sf_dir, "lineitem").select("l_orderkey", (p % 3 != 0).alias("verified"), (s % 4 == 0).alias("manufacturer"), (p % 2 == 0).alias("establishes_scope"), (s % 3 != 0).alias("complete"), (p % 7 != 0).alias("in_scope"), (s % 5).alias("origin"))
    return E.support_factors(members, ["l_orderkey"])


def group_conflicts(spark, sf_dir):
    """Orders whose line items, taken as one fact, aren't one."""
    p = F.col("l_partkey")
    members = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("key"), F.create_map(F.lit("status"), F.when(p % 2 == 0, F.lower("l_linestatus")).otherwise(F.col("l_linestatus")), F.lit("line"), (F.col("l_linenumber") % 3).cast("string")).alias("conditions"))
    return V.group_violations(members, ["l_orderkey"])


def document_text_status(spark, sf_dir):
    """Sources by how many of their documents hold text."""
    docs = read(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 8 < F.length("source") * 2 - 7, " ").otherwise(F.col("text")).alias("text"))
    return V.text_status(docs, ["source"], "text").select("source", F.round("share", 9).alias("share"), "status")


def value_comparisons(spark, sf_dir):
    p = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select("p_size", F.when(p % 4 == 0, " ").when(p % 4 == 1, F.col("p_brand")).otherwise(F.col("p_name")).alias("a"), F.when(p % 3 == 0, F.lit(None)).when(p % 3 == 1, F.col("p_brand")).otherwise(F.col("p_name")).alias("b"))
    return rows.groupBy("p_size", V.value_comparison("a", "b").alias("state")).agg(F.count(F.lit(1)).alias("n"))


def costs_by_currency(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.when(k % 5 != 0, F.floor("o_totalprice")).alias("cost"), F.when(k % 3 == 0, "EUR").when(k % 3 == 1, "USD").alias("currency"))
    return V.by_currency(rows, "cost", "currency")


def furthest_candidates(spark, sf_dir):
    """Of each order's line items, taken as candidates, the one that got furthest."""
    p = F.col("l_partkey")
    rows = _items(spark, sf_dir).select("l_orderkey", F.concat_ws("-", "l_orderkey", "n").alias("candidate_id"), F.col("n").alias("position"), F.when(p % 5 == 0, "ACQUIRED").when(p % 3 == 0, "ELIGIBLE").otherwise("REJECTED").alias("status"))
    return E.preferred(rows, ["l_orderkey"])


def example_matches(spark, sf_dir):
    """Parts as raw rows against examples that equal some of them in all six fields; some examples contradict each other."""
    p = F.col("p_partkey")
    fields = {"Mfg_Part_Num": F.col("p_name"), "Part_Desc": F.col("p_type"), "E1_Brand": F.col("p_brand"), "Unilog_Brand": F.lit("-"), "DIB_Brand": (p % 2).cast("string"), "Part_Manuf": F.lit("M")}
    rows = read(spark, sf_dir, "part").select("p_partkey", *[fields[f].alias(f) for f in FIELDS])
    examples = rows.where("p_partkey % 3 = 0").withColumn("classpath", F.concat(F.lit("c"), (p % 5).cast("string")))
    again = rows.where("p_partkey % 15 = 0").withColumn("classpath", F.lit("other"))
    out = exact_examples(rows, examples.unionByName(again).select(*FIELDS, "classpath"))
    return out.select("p_partkey", "classpath", "delivery")


def example_profile(spark, sf_dir):
    """The slots that all example records share."""
    k = F.col("o_orderkey")
    slots = F.inline(F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(f"L{i}").alias("label"), F.when(k % 7 == 0, "cm" if i == 2 else "mm").otherwise("mm" if i else "").alias("uom")) for i in range(4)]))
    return slot_profile(read(spark, sf_dir, "orders").select(k.alias("record"), slots), "record").select(F.col("slot").cast("long").alias("slot"), "label", "uom")


def duplicate_proposals(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 5).alias("key"))
    return E.duplicate_keys(rows, ["l_orderkey", "key"])


def scope_bindings(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(p % 3 != 0, (s % 3).cast("string")).alias("covers"), F.when(p % 2 == 0, "EXACT_SKU").otherwise("FAMILY").alias("scope"), (s % 2).cast("string").alias("mpn"))
    need = F.when(p % 4 == 0, F.array(F.lit("VOLTAGE"), F.lit("PHASE"))).otherwise(F.array(F.lit("VOLTAGE")))
    status = E.qualifier_status(need, F.create_map(F.when(s % 2 == 0, "VOLTAGE").otherwise("DUTY"), F.lit("x")), s % 5 != 0)
    counted = read(spark, sf_dir, "lineitem").groupBy(status["status"].alias("status"), F.array_join(status["missing"], ",").alias("missing")).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("qualifiers"))
    bound = rows.groupBy(E.scope_binding("covers", "scope", "mpn").alias("status")).agg(F.count(F.lit(1)).alias("n")).select("status", F.lit(None).cast("string").alias("missing"), "n", F.lit("binding").alias("what"))
    return counted.unionByName(bound)


QUERIES = {f.__name__: f for f in (
    claim_verification, resolved_attributes, evidence_standing, best_members, support_grades, group_conflicts, document_text_status, value_comparisons, costs_by_currency, furthest_candidates, example_matches, example_profile, duplicate_proposals, scope_bindings,
)}

_N = "i AS (SELECT *, l_orderkey AS k, l_partkey AS p, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)"
ORACLE_SQL = {
    "claim_verification": f"""
        WITH {_N}, c AS (
            SELECT k || '-' || n AS claim_id, k, p, CASE WHEN p % 5 = 0 THEN 'a' WHEN p % 43 = 0 THEN 'l' ELSE 'n' END AS kind, CASE p % 3 WHEN 2 THEN l_quantity + CASE WHEN p % 2 = 0 THEN 1 ELSE 0 END ELSE l_quantity END AS mm, p % 9 = 1 AS volts, 'flag ' || CASE WHEN p % 2 = 0 THEN l_returnflag ELSE 'Z' END AS value FROM i
        ), met AS (
            SELECT c.claim_id, any_value(c.k) AS k, any_value(c.p) AS p, count(x.k) AS lines, max(CASE WHEN c.kind = 'l' THEN 'UNSUPPORTED_VALUE_KIND' WHEN c.kind = 'a' THEN CASE WHEN c.value = 'flag ' || x.l_returnflag THEN NULL ELSE 'VALUE_NOT_SUPPORTED' END
                    WHEN c.volts THEN 'UNIT_NOT_SUPPORTED' WHEN x.l_quantity <> c.mm THEN 'VALUE_NOT_SUPPORTED' WHEN x.s % 7 = 0 THEN 'OPERATOR_MISMATCH' END) AS worst,
                   min(CASE WHEN c.kind = 'l' THEN 'UNSUPPORTED_VALUE_KIND' WHEN c.kind = 'a' THEN CASE WHEN c.value = 'flag ' || x.l_returnflag THEN NULL ELSE 'VALUE_NOT_SUPPORTED' END
                    WHEN c.volts THEN 'UNIT_NOT_SUPPORTED' WHEN x.l_quantity <> c.mm THEN 'VALUE_NOT_SUPPORTED' WHEN x.s % 7 = 0 THEN 'OPERATOR_MISMATCH' END) AS bad,
                   count(CASE WHEN c.kind = 'l' THEN 1 WHEN c.kind = 'a' THEN CASE WHEN c.value = 'flag ' || x.l_returnflag THEN NULL ELSE 1 END WHEN c.volts THEN 1 WHEN x.l_quantity <> c.mm THEN 1 WHEN x.s % 7 = 0 THEN 1 END) AS n_bad
            FROM c LEFT JOIN i x ON x.k = c.k AND x.p = c.p GROUP BY 1
        ), j AS (
            SELECT claim_id, CASE WHEN p % 37 = 0 THEN 'PRODUCT_SCOPE_NOT_SUPPORTED' WHEN p % 41 = 0 THEN 'PRODUCT_REFERENCE_MISMATCH' WHEN k % 29 = 0 THEN 'ARTIFACT_MISMATCH' WHEN k % 31 = 0 THEN 'ARTIFACT_UNREADABLE' WHEN k % 13 = 0 AND k % 19 = 0 THEN 'ARTIFACT_UNREADABLE'
                WHEN k % 13 <> 0 AND k % 17 = 0 THEN 'PRODUCT_REFERENCE_MISMATCH' WHEN k % 19 = 0 THEN 'PAGE_NOT_FOUND' WHEN k % 23 = 0 THEN 'ARTIFACT_UNREADABLE' WHEN k % 13 = 0 THEN 'PRODUCT_SCOPE_NOT_SUPPORTED' WHEN p % 11 = 0 THEN 'FRAGMENT_NOT_FOUND'
                WHEN n_bad > 0 AND n_bad < lines THEN 'AMBIGUOUS_MATCH' WHEN n_bad > 0 THEN bad END AS failure FROM met
        ) SELECT claim_id, failure, CASE WHEN failure IS NULL THEN 'EXACT_SPAN' ELSE 'UNVERIFIED' END AS status FROM j
    """,
    "resolved_attributes": f"""
        WITH {_N}, slots AS (SELECT o_orderkey AS record, unnest([0, 1, 2, 3]) AS g FROM orders), sums AS (
            SELECT record, g, count(k) AS n, coalesce(bool_or(p % 23 = 0), false) AS labels, g % 2 = 1 AND coalesce(bool_or(p % 7 <> 0 AND p % 13 = 0), false) AS kinds, g = 1 AND coalesce(bool_or(p % 7 <> 0 AND p % 5 = 0), false) AS uoms,
                   min(p % 2) FILTER (p % 7 <> 0) AS lo, max(p % 2) FILTER (p % 7 <> 0) AS hi, count(*) FILTER (p % 7 <> 0 AND k IS NOT NULL) AS valued, min(n) FILTER (p % 3 <> 0) AS best, coalesce(bool_or(p % 11 = 0), false) AS review
            FROM slots LEFT JOIN i ON k = record AND s % 4 = g GROUP BY 1, 2
        ), r AS (
            SELECT *, CASE WHEN n = 0 THEN 'NO_CANDIDATE' WHEN labels THEN 'LABEL_MISMATCH' WHEN kinds THEN 'VALUE_KIND_MISMATCH' WHEN uoms THEN 'UOM_MISMATCH' WHEN lo <> hi THEN 'CONFLICTING_VALUES' WHEN best IS NOT NULL THEN CASE WHEN valued > 1 THEN 'DUPLICATE_AGREEMENT' ELSE 'ELIGIBLE' END ELSE 'NOT_ELIGIBLE' END AS reason FROM sums
        )
        SELECT record, 's' || g AS slot_key, CASE WHEN reason = 'NO_CANDIDATE' THEN 'WITHHOLD' WHEN reason IN ('ELIGIBLE', 'DUPLICATE_AGREEMENT') THEN 'COMMIT' WHEN reason <> 'NOT_ELIGIBLE' OR review THEN 'REVIEW' ELSE 'WITHHOLD' END AS decision, reason,
               CASE WHEN reason IN ('ELIGIBLE', 'DUPLICATE_AGREEMENT') THEN record || '-' || best END AS winner FROM r
    """,
    "evidence_standing": """
        WITH x AS (SELECT l_partkey AS p, l_suppkey AS s, l_suppkey % 6 <> 0 AND l_partkey % 5 <> 0 AND l_partkey % 3 <> 0 AND l_partkey % 7 <> 0 AND l_partkey % 2 = 0 AS licensed FROM lineitem),
        y AS (SELECT *, s % 4 <> 3 AND (s % 4 <> 1 OR licensed) AS standing FROM x),
        z AS (SELECT standing, p % 4 <> 0 AND p % 8 <> 1 AND p % 9 <> 0 AND standing AS eligible, p % 2 <> 0 OR (p % 3 <> 0 AND s % 2 = 1) AS in_scope, CASE WHEN p % 6 = 2 THEN false WHEN p % 3 = 1 THEN false ELSE true END AS present FROM y)
        SELECT *, count(*) AS n FROM z GROUP BY ALL
    """,
    "best_members": f"WITH {_N} SELECT l_orderkey, k || '-' || n AS member_id FROM i QUALIFY row_number() OVER (PARTITION BY k ORDER BY p % 3, s % 2, p % 2, s % 5 <> 0, n) = 1",
    "support_grades": """
        WITH x AS (SELECT l_orderkey, l_partkey % 3 <> 0 AS v, l_suppkey % 4 = 0 AS m, l_partkey % 2 = 0 AS e, l_suppkey % 3 <> 0 AS c, l_partkey % 7 <> 0 AS i, l_suppkey % 5 AS o FROM lineitem),
        g AS (SELECT l_orderkey, bool_or(v) AS verified_span, bool_or(v AND m) AS manufacturer_origin, bool_or(v AND e) AS scope_established, bool_or(v AND c) AS conditions_complete, bool_and(NOT v OR i) AS family_invariance_ok, count(DISTINCT CASE WHEN v THEN o END) AS independent_roots FROM x GROUP BY 1)
        SELECT *, CASE WHEN verified_span AND family_invariance_ok THEN CASE manufacturer_origin::INT + scope_established::INT + conditions_complete::INT WHEN 3 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END END AS grade FROM g
    """,
    "group_conflicts": """
        SELECT l_orderkey, 'UNEQUAL_KEYS' AS violation FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1
        UNION ALL SELECT l_orderkey, 'CONFLICTING_STATUS' FROM lineitem GROUP BY 1 HAVING count(DISTINCT lower(l_linestatus)) > 1 UNION ALL SELECT l_orderkey, 'CONFLICTING_LINE' FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber % 3) > 1
    """,
    "document_text_status": """
        WITH s AS (SELECT source, avg(CASE WHEN trim(coalesce(CASE WHEN doc_id % 8 < length(source) * 2 - 7 THEN ' ' ELSE text END, '')) <> '' THEN 1 ELSE 0 END) AS share FROM documents GROUP BY 1)
        SELECT source, round(share, 9) AS share, CASE WHEN share = 1 THEN 'ALL_PAGES' WHEN share >= 0.1 THEN 'PARTIAL' ELSE 'MOSTLY_WITHOUT' END AS status FROM s
    """,
    "value_comparisons": """
        WITH x AS (SELECT p_size, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_brand ELSE p_name END AS a, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN p_brand ELSE p_name END AS b FROM part)
        SELECT p_size, CASE WHEN a = '' AND b = '' THEN 'BOTH_BLANK' WHEN a = '' OR b = '' THEN 'ONE_BLANK' WHEN a = b THEN 'IDENTICAL' ELSE 'DIFFERENT' END AS state, count(*) AS n FROM x GROUP BY 1, 2
    """,
    "costs_by_currency": "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'UNSPECIFIED' END AS currency, CAST(sum(floor(o_totalprice)) AS BIGINT) AS cost, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1",
    "furthest_candidates": f"WITH {_N} SELECT l_orderkey, k || '-' || n AS candidate_id FROM i QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE WHEN p % 5 = 0 THEN 0 WHEN p % 3 = 0 THEN 1 ELSE 2 END, n) = 1",
    "example_matches": """
        WITH r AS (SELECT p_partkey AS k, p_name, p_type, p_brand, p_partkey % 2 AS d FROM part), x AS (SELECT p_name, p_type, p_brand, d, 'c' || k % 5 AS c FROM r WHERE k % 3 = 0 UNION ALL SELECT p_name, p_type, p_brand, d, 'other' FROM r WHERE k % 15 = 0),
        o AS (SELECT p_name, p_type, p_brand, d, min(c) AS classpath FROM x GROUP BY ALL HAVING count(DISTINCT c) = 1)
        SELECT k AS p_partkey, classpath, CASE WHEN classpath IS NULL THEN 'WITHHOLD' ELSE 'COMMIT' END AS delivery FROM r LEFT JOIN o USING (p_name, p_type, p_brand, d)
    """,
    "example_profile": "SELECT i AS slot, 'L' || i AS label, CASE i WHEN 1 THEN 'mm' WHEN 3 THEN 'mm' END AS uom FROM (SELECT unnest(range(0, 4)) AS i) WHERE EXISTS (SELECT 1 FROM orders)",
    "duplicate_proposals": "SELECT l_orderkey, l_partkey % 5 AS key, CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_partkey % 5) > 1 THEN 'DUPLICATE_SOURCE_KEY' END AS rejected FROM lineitem",
    "scope_bindings": """
        SELECT CASE WHEN l_partkey % 3 <> 0 AND l_suppkey % 3 <> l_suppkey % 2 THEN 'CONTRADICTED' WHEN l_partkey % 2 = 0 AND l_partkey % 3 <> 0 THEN 'EXACT' ELSE 'NOT_ESTABLISHED' END AS status, NULL AS missing, count(*) AS n, 'binding' AS what FROM lineitem GROUP BY 1
        UNION ALL SELECT CASE WHEN l_suppkey % 5 = 0 THEN 'UNKNOWN' WHEN l_suppkey % 2 = 1 OR l_partkey % 4 = 0 THEN 'PARTIAL' ELSE 'COMPLETE' END,
               CASE WHEN l_suppkey % 5 <> 0 THEN concat_ws(',', CASE WHEN l_partkey % 4 = 0 THEN 'PHASE' END, CASE WHEN l_suppkey % 2 = 1 THEN 'VOLTAGE' END) END, count(*), 'qualifiers' FROM lineitem GROUP BY 1, 2
    """,
}
