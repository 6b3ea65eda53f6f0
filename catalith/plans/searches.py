"""Queries over searches, sources given by hand and storage gates, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.operators import searches as S
from catalith.plans import discovery as P
from catalith.plans.catalog import read


def _calls(spark, sf_dir):
    n = F.col("page_id")
    query = F.concat(F.lit('"'), F.regexp_extract("url", "/([0-9]+)", 1), F.lit('"'))
    options = F.when(n % 4 == 0, F.create_map(F.lit("site"), F.lit("x"), F.lit("lang"), F.lit("en"))).when(n % 4 == 1, F.create_map().cast("map<string,string>"))
    key = S.search_key(query, F.lit("web"), F.when(n % 5 == 0, 20).otherwise(10), F.when(n % 3 != 0, F.lit("v1")), options)
    return read(spark, sf_dir, "pages").select("page_id", query.alias("query"), key.alias("key"))


def search_keys(spark, sf_dir):
    return _calls(spark, sf_dir)


def search_provenance(spark, sf_dir):
    """Searches replayed from records: what the provider ran, and how many results it gave."""
    calls = _calls(spark, sf_dir)
    hit = lambda i: F.concat(F.lit('{"url":"https://h.example/'), F.col("page_id").cast("string"), F.lit(f'/{i}","rank":{i}}}'))
    ran = F.concat(F.lit('{"_provider_executed_queries":["'), F.col("page_id").cast("string"), F.lit('"," a ","'), F.col("page_id").cast("string"), F.lit('",""]}'))
    payload = F.concat(F.lit("["), F.concat_ws(",", hit(1), F.when(F.col("page_id") % 2 == 0, hit(2)), ran), F.lit("]"))
    records = calls.where("page_id % 6 <> 0").select("key", payload.alias("payload"), F.col("page_id").alias("captured_at"))
    done = S.search_executions(calls.select(F.col("page_id").alias("call_id"), "key"), records)
    results = S.execution_results(done.select("call_id", "outcome", "payload")).groupBy("call_id").agg(F.count(F.lit(1)).alias("n_results"), F.max("url").alias("last_url"))
    return done.join(results, "call_id", "left").select("call_id", "outcome", F.array_join("provider_queries", "|").alias("provider_queries"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "last_url")


def manual_sources(spark, sf_dir):
    """Pages as sources that a person names; some URLs may not be fetched."""
    n = F.col("page_id")
    url = F.when(n % 17 == 0, F.regexp_replace("url", "^https?", "ftp")).when(n % 19 == 0, F.regexp_replace("url", "^(https?://)[^/?#]*", r"$110.0.0.7")).otherwise(F.col("url"))
    rows = P.candidates(spark, sf_dir).select(F.col("page_id").alias("source_id"), url.alias("url"), "hint", "mpn")
    return S.manual_plan(rows, P._registry(spark)).withColumn("rejections", F.array_join("rejections", ","))


def storage_gate(spark, sf_dir):
    n = F.col("page_id")
    final = F.when(n % 5 == 0, "KNOWN_DISTRIBUTOR").when(n % 5 == 1, "APPROVED_MANUFACTURER")
    rows = P.candidates(spark, sf_dir).withColumns({"final_authority": final, "relevance": F.when(n % 2 == 0, "EXACT").otherwise(F.col("relevance")), "method": F.when(n % 8 != 0, "WEB_SEARCH")})
    return rows.select("page_id", S.storage_refusal(F.col("authority"), F.col("final_authority"), F.col("relevance"), F.col("method")).alias("refusal"))


def hint_domains(spark, sf_dir):
    """Nations' customers name their nation; each region's entry has its nations as hints and its suppliers' hosts as domains."""
    nations = read(spark, sf_dir, "nation")
    hosts = read(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.array_sort(F.collect_set(F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit(".example")))).alias("domains"))
    entries = nations.where("n_nationkey % 4 <> 0").groupBy("n_regionkey").agg(F.collect_list(F.concat(F.lit(" "), F.lower("n_name"))).alias("hints")).join(hosts, "n_regionkey").select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("key"), "hints", "domains")
    named = read(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("hint"))
    out = S.domains_for_hint(named, entries)
    return out.groupBy("hint", "key", F.array_join("domains", ",").alias("domains")).agg(F.count(F.lit(1)).alias("n"))


def context_evidence(spark, sf_dir):
    k = F.col("p_partkey")
    brands = F.when(k % 5 != 0, F.array_distinct(F.array("p_brand", F.when(k % 2 == 0, F.col("p_brand")).otherwise(F.lit("Other")))))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("d"), F.array("p_type").alias("c"), brands.alias("b"), F.when(k % 3 == 0, F.lit("")).otherwise(F.upper("p_brand")).alias("m"), F.when(k % 4 != 0, F.lit("Other")).alias("x"))
    e = rows.select("p_partkey", S.context_evidence("d", "c", "b", "m", "x").alias("e"))
    return e.select("p_partkey", "e.raw_description", "e.normalized_description", F.array_join("e.matched_cues", ",").alias("matched_cues"), "e.authority", "e.manufacturer_context", F.array_join("e.brand_context", ",").alias("brand_context"))


def target_values(spark, sf_dir):
    """Line items' quantities in the unit that their target wants, or why not."""
    k = F.col("l_partkey")
    unit = F.get(F.array(*map(F.lit, ("mm", "kV", "furlong", "°C"))), (k % 4).cast("int"))
    target = F.when(k % 3 == 0, "m").when(k % 3 == 1, "V")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", k.alias("k"), F.col("l_quantity").alias("value"), unit.alias("unit"), target.alias("target"), F.when(k % 7 == 0, "alphanumeric").otherwise("numeric").alias("kind"))
    out = S.for_target(rows, "value", "unit", "target", "kind")
    return out.groupBy("target_uom", F.coalesce(F.regexp_extract("target_problem", ": (.*)$", 1), F.lit("")).alias("why")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("target_value"), 3).alias("total"))


def index_metrics(spark, sf_dir):
    n = F.count(F.lit(1))
    cases = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(n.alias("proposals"), F.count_if(F.expr("l_suppkey % 2 = 0")).alias("bound"), F.count_if(F.expr("l_suppkey % 4 = 0")).alias("verified"), F.count_if(F.expr("l_suppkey % 4 = 2")).alias("withheld"), F.count_if(F.expr("l_suppkey % 8 = 0")).alias("mapped"))
    return S.index_metrics(cases)


QUERIES = {f.__name__: f for f in (search_keys, search_provenance, manual_sources, storage_gate, hint_domains, context_evidence, target_values, index_metrics)}

_CALLS = """
    calls AS (
        SELECT page_id, '"' || regexp_extract(url, '/([0-9]+)', 1) || '"' AS query FROM pages
    ), keyed AS (
        SELECT *, sha256('{"max_results":' || CASE WHEN page_id % 5 = 0 THEN 20 ELSE 10 END || CASE WHEN page_id % 4 = 0 THEN ',"options":{"lang":"en","site":"x"}' ELSE '' END || ',"provider":"web","query":"\\"' || replace(query, '"', '') || '\\""' || CASE WHEN page_id % 3 <> 0 THEN ',"version":"v1"' ELSE '' END || '}') AS key FROM calls
    )
"""
_AUTH = f"a AS ({P.ORACLE_SQL['host_authority']}), v AS ({P.ORACLE_SQL['url_relevance']})"
ORACLE_SQL = {
    "search_keys": f"WITH {_CALLS} SELECT page_id, query, key FROM keyed",
    "search_provenance": f"""
        WITH {_CALLS}, last AS (SELECT key, max(page_id) AS p FROM keyed WHERE page_id % 6 <> 0 GROUP BY 1)
        SELECT page_id AS call_id, CASE WHEN p IS NULL THEN 'MISS' ELSE 'HIT' END AS outcome, CASE WHEN p IS NULL THEN '' ELSE p || '|a' END AS provider_queries, CASE WHEN p IS NULL THEN 0 WHEN p % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n_results,
               'https://h.example/' || p || CASE WHEN p % 2 = 0 THEN '/2' ELSE '/1' END AS last_url
        FROM keyed LEFT JOIN last USING (key)
    """,
    "storage_gate": f"""
        WITH {_AUTH} SELECT page_id, CASE WHEN NOT (authority = 'APPROVED_MANUFACTURER' AND page_id % 5 <> 0 AND (page_id % 2 = 0 OR relevance = 'EXACT')) THEN 'REDIRECT_AUTHORITY_LOST' WHEN page_id % 8 = 0 THEN 'DISCOVERY_PROVENANCE_UNDECLARED' END AS refusal FROM a JOIN v USING (page_id)
    """,
    "hint_domains": """
        WITH e AS (SELECT n_regionkey, 'R' || n_regionkey AS key, string_agg(DISTINCT replace(lower(n_name), ' ', '-') || '.example', ',' ORDER BY replace(lower(n_name), ' ', '-') || '.example') AS domains FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
        SELECT n_name AS hint, CASE WHEN n_nationkey % 4 <> 0 THEN key END AS key, CASE WHEN n_nationkey % 4 <> 0 THEN coalesce(domains, '') ELSE '' END AS domains, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN e USING (n_regionkey) GROUP BY ALL
    """,
    "context_evidence": """
        SELECT p_partkey, p_name AS raw_description, array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ' ') AS normalized_description, p_type AS matched_cues, 'DETERMINISTIC_INTERNAL' AS authority, CASE WHEN p_partkey % 3 <> 0 THEN upper(p_brand) END AS manufacturer_context,
               concat_ws(',', CASE WHEN p_partkey % 5 <> 0 THEN p_brand END, CASE WHEN (p_partkey % 5 <> 0 AND p_partkey % 2 = 1 AND p_brand <> 'Other') OR p_partkey % 4 <> 0 THEN 'Other' END) AS brand_context
        FROM part
    """,
    "target_values": """
        WITH x AS (SELECT l_quantity AS v, l_partkey AS k, ['mm', 'kV', 'furlong', '°C'][k % 4 + 1] AS unit, CASE k % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'V' END AS target, k % 7 = 0 OR k % 3 = 2 AS plain FROM lineitem),
        y AS (SELECT *, CASE WHEN plain THEN '' WHEN unit = 'furlong' THEN 'unknown unit' WHEN (unit = 'mm') = (target = 'm') AND unit IN ('mm', 'kV') AND (unit = 'kV') = (target = 'V') THEN '' ELSE 'incompatible' END AS why FROM x)
        SELECT CASE WHEN plain THEN unit WHEN why = '' THEN target END AS target_uom, why, count(*) AS n, round(sum(CASE WHEN plain THEN v WHEN why = '' THEN CASE target WHEN 'm' THEN v / 1000 ELSE v * 1000 END END), 3) AS total FROM y GROUP BY 1, 2
    """,
    "index_metrics": "SELECT count(DISTINCT l_orderkey) AS cases, count(*) AS proposals, count(*) FILTER (l_suppkey % 2 = 0) AS bound, count(*) FILTER (l_suppkey % 4 = 0) AS verified, count(*) FILTER (l_suppkey % 4 = 2) AS withheld, count(*) FILTER (l_suppkey % 8 = 0) AS mapped, (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)) AS deepest FROM lineitem",
    "manual_sources": f"""
        WITH {_AUTH}, s AS (
            SELECT page_id, CASE WHEN page_id % 17 = 0 THEN 'SCHEME_NOT_ALLOWED' WHEN page_id % 19 = 0 THEN 'PRIVATE_ADDRESS' ELSE 'OK' END AS static_url,
                   CASE WHEN page_id % 17 <> 0 AND page_id % 19 = 0 THEN 'UNKNOWN' ELSE authority END AS authority, relevance FROM a JOIN v USING (page_id)
        ), r AS (
            SELECT *, CASE WHEN authority IN ('BLOCKED', 'UNKNOWN') THEN 'DOMAIN_NOT_APPROVED' WHEN authority = 'KNOWN_MARKETPLACE' THEN 'MARKETPLACE_SOURCE' WHEN authority = 'KNOWN_DISTRIBUTOR' THEN 'DISTRIBUTOR_SOURCE' WHEN authority = 'OTHER_MANUFACTURER' THEN 'OTHER_MANUFACTURER_DOMAIN' WHEN authority = 'UNVERIFIED_MANUFACTURER' THEN 'AUTHORITY_NOT_ESTABLISHED' END AS r1,
                   CASE relevance WHEN 'FAMILY_ONLY' THEN 'FAMILY_ONLY' WHEN 'SIBLING' THEN 'SIBLING_REFERENCE' WHEN 'AMBIGUOUS' THEN 'AMBIGUOUS_REFERENCE' WHEN 'ABSENT' THEN 'MPN_ABSENT' END AS r2 FROM s
        )
        SELECT page_id AS source_id, authority, relevance, static_url, static_url = 'OK' AS dns_deferred, concat_ws(',', r1, r2, CASE WHEN static_url <> 'OK' THEN static_url END) AS rejections, static_url = 'OK' AND authority = 'APPROVED_MANUFACTURER' AND relevance = 'EXACT' AS would_attempt FROM r
    """,
}
