"""Discovery queries over pages, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.functions import text as T
from catalith.operators import discovery as D
from catalith.operators.catalogue import first_per
from catalith.plans.catalog import read

#: (domain, role, owner, licensed): an injected registry.
REGISTRY = [
    ("example.com", "MANUFACTURER", "com", True), ("m.example.com", "MANUFACTURER", "com", True), ("example.org", "MANUFACTURER", "org", False),
    ("example.net", "DISTRIBUTOR", "net", False), ("tionsh.example.net", "MARKETPLACE", "tion", False), ("blog.ththsh.example.org", "BLOCKED", "x", False), ("thering.example.org", "BLOCKED", "x", False),
]


def _registry(spark):
    return spark.createDataFrame(REGISTRY, "domain string, role string, owner string, licensed boolean")


def candidates(spark, sf_dir):
    """Pages as search results: the hint is the owner the page id asks for, the product number the page's path number less its last digit for some."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", T.url_host("url").alias("host"))
    hint = F.when(F.col("page_id") % 3 == 0, "com").when(F.col("page_id") % 3 == 1, "org").otherwise("net")
    number = F.regexp_extract("url", "/([0-9]+)", 1)
    mpn = F.when(F.col("page_id") % 4 == 0, number).when(F.col("page_id") % 4 == 1, F.concat(number, F.lit("7"))).when(F.col("page_id") % 4 == 2, F.concat(F.substring(number, 1, 4), F.lit("X9"))).otherwise("NONE")
    rows = D.with_owner(pages, _registry(spark)).withColumns({"hint": hint, "mpn": mpn, "product": F.col("page_id") % 40})
    return rows.withColumns({
        "authority": D.authority(F.col("hint")),
        "relevance": D.relevance(D.relevance_texts(F.col("url"), F.lit("")), F.col("mpn")),
        "kind": D.kind(F.col("url"), F.lit("")),
    })


def host_authority(spark, sf_dir):
    return candidates(spark, sf_dir).select("page_id", "host", "hint", "authority")


def url_relevance(spark, sf_dir):
    return candidates(spark, sf_dir).select("page_id", "mpn", "relevance")


def source_kind(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    title = F.when(F.col("page_id") % 5 == 0, "Product catalogue").when(F.col("page_id") % 5 == 1, "Instruction leaflet").when(F.col("page_id") % 5 == 2, "Datasheet").otherwise("")
    url = F.when(F.col("page_id") % 7 == 0, F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.lit(".pdf?x=1"))).when(F.col("page_id") % 7 == 1, F.regexp_replace("url", "/(en|de|fr|es)/", "/products/")).otherwise(F.col("url"))
    return pages.select("page_id", D.kind(url, title).alias("kind"))


def rank_candidates(spark, sf_dir):
    ranked = D.ranked(candidates(spark, sf_dir), ["product"], "page_id", "url")
    return ranked.select("product", "page_id", F.col("position").cast("long").alias("position"))


def fetch_budget(spark, sf_dir):
    ranked = D.ranked(candidates(spark, sf_dir), ["product"], "page_id", "url")
    return D.within_budget(ranked, ["product"], 1).select("product", "page_id", "fetch")


def discovery_diagnose(spark, sf_dir):
    return D.diagnose(candidates(spark, sf_dir), ["product"])


def rejection_counts(spark, sf_dir):
    return candidates(spark, sf_dir).select(F.explode(D.rejections()).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def first_sighting(spark, sf_dir):
    """Of URLs that come back for several searches, the first one in search order."""
    pages = read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[^?#]*", 0).alias("url"), (F.col("page_id") % 7).alias("query_pos"), "page_id")
    return first_per(pages, ["url"], ["query_pos", "page_id"]).select("url", "query_pos", "page_id")


def url_checks(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    host = F.get(F.array(*map(F.lit, ("10.0.0.1", "192.168.1.9:80", "8.8.8.8", "localhost", "user@172.20.1.1", "example.com", ""))), (F.col("page_id") % 7).cast("int"))
    scheme = F.when(F.col("page_id") % 11 == 0, "ftp").otherwise("https")
    url = F.concat(scheme, F.lit("://"), host, F.lit("/a"))
    return pages.select("page_id", D.url_structure(url).alias("verdict"))


QUERIES = {f.__name__: f for f in (host_authority, url_relevance, source_kind, rank_candidates, fetch_budget, discovery_diagnose, rejection_counts, first_sighting, url_checks)}

_REG = ", ".join(f"('{d}', '{r}', '{o}', {licensed})" for d, r, o, licensed in REGISTRY)
_C = f"""WITH reg(domain, role, owner, licensed) AS (VALUES {_REG}),
    p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') AS host, CASE page_id % 3 WHEN 0 THEN 'com' WHEN 1 THEN 'org' ELSE 'net' END AS hint,
                 regexp_extract(url, '/([0-9]+)', 1) AS num, page_id % 40 AS product FROM pages),
    o AS (SELECT page_id, role, owner, licensed FROM p JOIN reg ON host = domain OR ends_with(host, concat('.', domain))
          QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY CASE role WHEN 'BLOCKED' THEN 0 WHEN 'MANUFACTURER' THEN 1 WHEN 'MARKETPLACE' THEN 2 ELSE 3 END, length(domain) DESC, domain) = 1),
    w AS (SELECT p.*, CASE page_id % 4 WHEN 0 THEN num WHEN 1 THEN concat(num, '7') WHEN 2 THEN concat(substr(num, 1, 4), 'X9') ELSE 'NONE' END AS mpn,
                 list_distinct(regexp_extract_all(upper(concat(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), ' ', array_to_string(list_transform(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda q: regexp_extract(q, '=(.*)', 1)), ' '), ' ', regexp_extract(url, '#(.*)$', 1))), '[A-Z0-9]+')) AS words FROM p),
    s AS (SELECT *, list_filter(words, lambda x: length(x) >= 5 AND x <> mpn AND starts_with(mpn, x)) AS fam,
                 list_filter(words, lambda x: length(x) >= 5 AND x <> mpn AND NOT starts_with(mpn, x) AND substr(x, 1, 5) = substr(mpn, 1, 5)) AS sib FROM w),
    c AS (SELECT s.*, CASE WHEN host = '' THEN 'UNKNOWN' WHEN role = 'BLOCKED' THEN 'BLOCKED' WHEN role = 'MANUFACTURER' AND owner <> hint THEN 'OTHER_MANUFACTURER' WHEN role = 'MANUFACTURER' AND licensed THEN 'APPROVED_MANUFACTURER'
                 WHEN role = 'MANUFACTURER' THEN 'UNVERIFIED_MANUFACTURER' WHEN role = 'MARKETPLACE' THEN 'KNOWN_MARKETPLACE' WHEN role = 'DISTRIBUTOR' THEN 'KNOWN_DISTRIBUTOR' ELSE 'UNKNOWN' END AS authority,
                 CASE WHEN list_contains(words, mpn) THEN 'EXACT' WHEN len(sib) > 1 THEN 'AMBIGUOUS' WHEN len(sib) = 1 THEN 'SIBLING' WHEN len(fam) > 0 THEN 'FAMILY_ONLY' ELSE 'ABSENT' END AS relevance,
                 CASE WHEN regexp_matches(lower(url), 'catalog|catalogue') THEN 'CATALOG' WHEN regexp_matches(lower(url), 'manual|instruction') THEN 'MANUAL' ELSE 'UNKNOWN' END AS kind
          FROM s LEFT JOIN o USING (page_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY list_position({list(D.AUTHORITIES)}, authority), list_position({list(D.RELEVANCES)}, relevance), list_position({list(D.KINDS)}, kind), page_id, url) AS position FROM c)"""
ORACLE_SQL = {
    "host_authority": f"{_C} SELECT page_id, host, hint, authority FROM c",
    "url_relevance": f"{_C} SELECT page_id, mpn, relevance FROM c",
    "source_kind": """WITH x AS (SELECT page_id, lower(CASE page_id % 7 WHEN 0 THEN concat(regexp_extract(url, '^[^?#]*', 0), '.pdf?x=1') WHEN 1 THEN regexp_replace(url, '/(en|de|fr|es)/', '/products/') ELSE url END) AS u,
            lower(CASE page_id % 5 WHEN 0 THEN 'Product catalogue' WHEN 1 THEN 'Instruction leaflet' WHEN 2 THEN 'Datasheet' ELSE '' END) AS t FROM pages)
        SELECT page_id, CASE WHEN regexp_matches(concat(u, ' ', t), 'catalog') THEN 'CATALOG' WHEN regexp_matches(concat(u, ' ', t), 'manual|instruction') THEN 'MANUAL'
            WHEN regexp_matches(concat(u, ' ', t), 'datasheet|data-sheet|spec-sheet') OR ends_with(regexp_extract(u, '://[^/?#]*([^?#]*)', 1), '.pdf') THEN 'DATASHEET'
            WHEN contains(regexp_extract(u, '://[^/?#]*([^?#]*)', 1), '/product') THEN 'PRODUCT_PAGE' ELSE 'UNKNOWN' END AS kind FROM x""",
    "rank_candidates": f"{_C} SELECT product, page_id, position FROM r",
    "fetch_budget": f"""{_C} SELECT product, page_id, CASE WHEN NOT e THEN 'NOT_ELIGIBLE' WHEN n <= 1 THEN 'FETCH' ELSE 'FETCH_BUDGET_EXHAUSTED' END AS fetch FROM (
        SELECT *, authority = 'APPROVED_MANUFACTURER' AND relevance = 'EXACT' AS e, sum(CASE WHEN authority = 'APPROVED_MANUFACTURER' AND relevance = 'EXACT' THEN 1 ELSE 0 END) OVER (PARTITION BY product ORDER BY position) AS n FROM r)""",
    "discovery_diagnose": f"""{_C} SELECT product, CASE WHEN bool_or(authority = 'APPROVED_MANUFACTURER' AND relevance = 'EXACT') THEN 'ELIGIBLE_NOT_ACQUIRED' WHEN bool_or(authority = 'UNVERIFIED_MANUFACTURER') THEN 'DOMAIN_REVIEW_REQUIRED'
        WHEN bool_or(authority = 'APPROVED_MANUFACTURER') THEN CASE WHEN bool_and(relevance = 'FAMILY_ONLY') FILTER (authority = 'APPROVED_MANUFACTURER') THEN 'FAMILY_ONLY' WHEN bool_and(relevance = 'SIBLING') FILTER (authority = 'APPROVED_MANUFACTURER') THEN 'SIBLING_ONLY' ELSE 'NO_EXACT_MPN' END
        WHEN bool_and(authority = 'KNOWN_DISTRIBUTOR') THEN 'ONLY_DISTRIBUTORS' WHEN bool_and(authority = 'KNOWN_MARKETPLACE') THEN 'ONLY_MARKETPLACES' ELSE 'NO_MANUFACTURER_DOMAIN' END AS outcome, count(*) AS candidates FROM c GROUP BY 1""",
    "rejection_counts": f"""{_C} SELECT reason, count(*) AS n FROM (
        SELECT CASE WHEN authority IN ('BLOCKED', 'UNKNOWN') THEN 'DOMAIN_NOT_APPROVED' WHEN authority = 'KNOWN_MARKETPLACE' THEN 'MARKETPLACE_SOURCE' WHEN authority = 'KNOWN_DISTRIBUTOR' THEN 'DISTRIBUTOR_SOURCE' WHEN authority = 'OTHER_MANUFACTURER' THEN 'OTHER_MANUFACTURER_DOMAIN' WHEN authority = 'UNVERIFIED_MANUFACTURER' THEN 'AUTHORITY_NOT_ESTABLISHED' END AS reason FROM c
        UNION ALL SELECT CASE relevance WHEN 'FAMILY_ONLY' THEN 'FAMILY_ONLY' WHEN 'SIBLING' THEN 'SIBLING_REFERENCE' WHEN 'AMBIGUOUS' THEN 'AMBIGUOUS_REFERENCE' WHEN 'ABSENT' THEN 'MPN_ABSENT' END FROM c) WHERE reason IS NOT NULL GROUP BY 1""",
    "first_sighting": "SELECT regexp_extract(url, '^[^?#]*', 0) AS url, page_id % 7 AS query_pos, page_id FROM pages QUALIFY row_number() OVER (PARTITION BY regexp_extract(url, '^[^?#]*', 0) ORDER BY page_id % 7, page_id) = 1",
    "url_checks": "SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'SCHEME_NOT_ALLOWED' ELSE ['PRIVATE_ADDRESS', 'PRIVATE_ADDRESS', 'OK', 'LOCALHOST', 'PRIVATE_ADDRESS', 'OK', 'HOST_MISSING'][page_id % 7 + 1] END AS verdict FROM pages",
}
