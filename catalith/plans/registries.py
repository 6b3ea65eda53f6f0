"""Queries over a taxonomy, text keys, page identity and row reports, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.functions import text as T
from catalith.functions import values as V
from catalith.operators import discovery as D
from catalith.operators import webidentity as W
from catalith.plans.catalog import read
from catalith.sources import html
from catalith.sources import registries as R

UNIT = ("mm", "V", "kg", "Hz")


def _s(*parts):
    return F.concat(*[p.cast("string") if hasattr(p, "cast") else F.lit(p) for p in parts])


def _taxonomy(spark, sf_dir):
    """Regions as groups, nations as classes, parts as features; some ids point nowhere."""
    nation, part, lines = (read(spark, sf_dir, t) for t in ("nation", "part", "lineitem"))
    n, p, k = F.col("n_nationkey"), F.col("p_partkey"), F.col("l_partkey")
    units = spark.createDataFrame([(f"U{i}", u) for i, u in enumerate(UNIT)], "UNITID string, UNITABBREV string")
    return R.taxonomy({
        "group": read(spark, sf_dir, "region").select(_s("R", F.col("r_regionkey")).alias("GROUPID"), F.col("r_name").alias("GROUPDESC")),
        "class": nation.select(_s("C", n).alias("CLASSID"), F.when(n % 10 == 0, "R9").otherwise(_s("R", F.col("n_regionkey"))).alias("GROUPID"), F.col("n_name").alias("CLASSDESC")),
        "synonym": read(spark, sf_dir, "supplier").select(_s("C", F.col("s_suppkey") % 27).alias("CLASSID"), F.col("s_name").alias("SYNONYM")),
        "feature": part.select(_s("F", p).alias("FEATUREID"), F.col("p_name").alias("FEATUREDESC"), F.get(F.array(*map(F.lit, "NLA")), (p % 3).cast("int")).alias("FEATURETYPE")),
        "unit": units, "value": spark.createDataFrame([("VA", "Amber"), ("VN", "Navy")], "VALUEID string, VALUEDESC string"),
        "classfeature": part.select(_s("m", p).alias("MAPID"), _s("C", p % 26).alias("CLASSID"), _s("F", F.when(p % 50 == 0, p + 1000000).otherwise(p)).alias("FEATUREID"), F.when(p % 7 == 0, _s("U", p % 5)).alias("UNITID"), F.col("p_size").cast("string").alias("SORTNR")),
        "classfeaturevalue": lines.where("l_partkey % 3 = 2").select(_s("m", k + F.when(k % 40 == 0, 2000000).otherwise(0)).alias("MAPID"), _s("V", F.col("l_returnflag")).alias("VALUEID"), F.lit("1").alias("SORTNR")).distinct(),
    })


def taxonomy_issues(spark, sf_dir):
    return _taxonomy(spark, sf_dir)["issues"]


def taxonomy_features(spark, sf_dir):
    """Features of classes that exist, with unit and place."""
    return _taxonomy(spark, sf_dir)["class_features"].select("CLASSID", "FEATUREID", "FEATUREDESC", "FEATURETYPE", "UNITABBREV", F.col("position").cast("long").alias("position"))


def value_validation(spark, sf_dir):
    """Line items as values claimed for their part's feature, and what is wrong with them."""
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    value = (
        F.when(k % 3 == 0, F.when(s % 5 == 0, "many").when(s % 5 == 1, "NaN").otherwise(F.col("l_quantity").cast("string"))).when(k % 3 == 1, F.when(s % 4 == 0, "maybe").when(s % 4 == 1, "TRUE").otherwise("false"))
        .otherwise(F.when(s % 3 == 0, "AMBER").when(s % 3 == 1, "navy").otherwise("blue"))
    )
    unit = F.when(s % 7 == 0, F.lit(None)).when(k % 7 == 0, F.get(F.array(*map(F.lit, (*UNIT, None))), ((k + F.when(s % 7 == 1, 1).otherwise(0)) % 5).cast("int")))
    claims = read(spark, sf_dir, "lineitem").select(_s("C", k % 26 + F.when(s % 11 == 0, 1).otherwise(0)).alias("CLASSID"), _s("F", k).alias("FEATUREID"), value.alias("value"), unit.alias("unit"))
    out = R.validate_values(claims, _taxonomy(spark, sf_dir))
    return out.groupBy("issue", F.substring("FEATUREID", -1, 1).alias("last")).agg(F.count(F.lit(1)).alias("n"))


def reference_keys(spark, sf_dir):
    """Numbers, brands and words of parts as they are compared."""
    p = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select("p_partkey", _s(" a-", p, " ", p % 7, "B ").alias("mpn"), _s("A-", p, p % 7, F.when(p % 3 == 0, "c").otherwise("b")).alias("other"), F.regexp_replace("p_brand", "#", "  #\t").alias("brand"), F.concat_ws(" ", _s("P-", p), "p_name", F.lit("(of) a, x/y"), "p_type").alias("d"))
    words = T.without_prefix(T.tokens("d"), T.tokens(_s("p-", p)))
    return rows.select("p_partkey", T.canonical_mpn("mpn").alias("mpn"), (T.canonical_mpn("mpn") == T.canonical_mpn("other")).alias("same_mpn"), T.canonical_brand("brand").alias("brand"), F.array_join(words, " ").alias("words"), F.array_join(T.class_tokens("d"), " ").alias("class_tokens"))


def shared_prefixes(spark, sf_dir):
    p = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", D.prefix_length(_s(p, "X"), F.reverse(_s(p))).cast("long").alias("shared"))


def source_units(spark, sf_dir):
    """Spellings of units, and the known unit that each stands for."""
    k = F.col("l_partkey")
    spelt = F.get(F.array(*map(F.lit, ("MM", " mm ", "KV", "mw", "hz", "Va", "furlong", "", "kΩ", "S"))), (k % 10).cast("int"))
    return read(spark, sf_dir, "lineitem").groupBy(spelt.alias("spelt"), V.resolve_source_unit(spelt).alias("unit")).agg(F.count(F.lit(1)).alias("n"))


def rendered_numbers(spark, sf_dir):
    """Numbers from a ten-millionth to ten billion, as they are shown."""
    x = (F.col("l_extendedprice") / 7 + 0.0001234567) * F.get(F.array(*map(F.lit, (1e-11, 1e-7, 1e-4, 1.0, 100.0, 1e5))), (F.col("l_partkey") % 6).cast("int"))
    return read(spark, sf_dir, "lineitem").groupBy(T.format_g(x).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


def line_ends(spark, sf_dir):
    """Texts whose line ends come in three kinds, brought to one."""
    ended = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit("\n"), F.lit("\r"))).otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.line_endings(ended), 256).alias("sha"))


def excerpts(spark, sf_dir):
    """What stands around the first `the` of each text."""
    docs = read(spark, sf_dir, "documents").withColumn("at", F.position(F.lit("the"), F.col("text"))).where("at > 0")
    return docs.select("doc_id", T.excerpt("text", "at", 20, 3).alias("around"))


def relevance_texts(spark, sf_dir):
    """What of a URL and title is searched for a product number."""
    texts = D.relevance_texts(F.col("url"), F.when(F.col("page_id") % 2 == 0, F.lit("A title")))
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(texts, "|").alias("texts"))


def web_identity(spark, sf_dir):
    """Whether each page, given structured data of several shapes, is about one product."""
    n = F.col("page_id")
    shape = n % 12
    product = lambda mpn: _s('{"@type":"Product","mpn":"', mpn, '"}')
    own, other = product(_s("M-", n)), product(F.lit("X"))
    script = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    head = (
        F.when(shape == 0, script(own)).when(shape == 1, script(F.concat(F.lit('{"mainEntity":'), own, F.lit(',"related":'), other, F.lit("}")))).when(shape == 2, script(F.concat(F.lit('{"@graph":['), own, F.lit(","), other, F.lit("]}"))))
        .when(shape == 3, script(F.concat(F.lit('{"@graph":['), own, F.lit(',{"@type":"Product"}]}')))).when(shape == 4, script(F.concat(F.lit('{"@type":"Product","mpn":"X","isRelatedTo":'), own, F.lit("}")))).when(shape == 5, script(other))
        .when(shape == 6, script(F.lit("{oops"))).when(shape == 7, _s("<title>m - ", n, " sheet</title>")).when(shape == 8, _s('<link rel="canonical" href="/p/M-', n, '">')).when(shape == 9, script(F.lit('{"@type":"Product","mpn":5}'))).otherwise("")
    )
    body = F.when(shape == 10, _s("<p>number M -", n, " here</p>")).otherwise("")
    rows = read(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("<html><head>"), head, F.lit("</head><body>"), body, F.regexp_replace("html", r"(?s)<title>.*?</title>", ""), F.lit("</body></html>")).alias("html"), F.when(n % 29 == 0, " ").otherwise(_s(" m-", n)).alias("mpn"), F.lit("Acme  Co").alias("brand"),
        F.when(n % 31 == 0, "Other").otherwise("ACME CO").alias("publisher"), F.when(n % 37 == 0, "UNKNOWN").otherwise("APPROVED_MANUFACTURER").alias("authority"),
    )
    return W.page_identity(html.parse_pages(rows), "page_id")


def row_reports(spark, sf_dir):
    """Each part's stages and the first that stopped it."""
    p = F.col("p_partkey")
    pick = lambda k, *names: F.get(F.array(*map(F.lit, names)), (p % k).cast("int"))
    rows = read(spark, sf_dir, "part").select(_s("P-", p).alias("Mfg_Part_Num"), pick(3, "COMMIT", "REVIEW", "WITHHOLD").alias("manuf_decision"), _s("m", p % 4).alias("manuf_reason"), pick(2, "COMMIT", "REVIEW").alias("class_decision"), _s("c", p % 5).alias("class_reason"))
    return W.report(W.timeline(rows))


QUERIES = {f.__name__: f for f in (
    taxonomy_issues, taxonomy_features, value_validation, reference_keys, shared_prefixes, source_units, rendered_numbers, line_ends, excerpts, relevance_texts, web_identity, row_reports,
)}

_TAX = """
    class AS (SELECT n_nationkey AS c, CASE WHEN n_nationkey % 10 = 0 THEN 9 ELSE n_regionkey END AS r FROM nation), cf AS (SELECT p_partkey AS m, p_partkey % 26 AS c, CASE WHEN p_partkey % 50 = 0 THEN p_partkey + 1000000 ELSE p_partkey END AS f, CASE WHEN p_partkey % 7 = 0 THEN p_partkey % 5 END AS u, p_size FROM part),
    cfv AS (SELECT DISTINCT l_partkey + CASE WHEN l_partkey % 40 = 0 THEN 2000000 ELSE 0 END AS m, l_returnflag AS v FROM lineitem WHERE l_partkey % 3 = 2), unit AS (SELECT unnest([0, 1, 2, 3]) AS u, unnest(['mm', 'V', 'kg', 'Hz']) AS abbrev),
    features AS (SELECT cf.m, cf.c, p_partkey AS f, p_name, ['N', 'L', 'A'][p_partkey % 3 + 1] AS kind, abbrev, cf.p_size::BIGINT AS position FROM cf JOIN part ON p_partkey = cf.f LEFT JOIN unit USING (u))
"""
ORACLE_SQL = {
    "taxonomy_issues": f"""
        WITH {_TAX}
        SELECT DISTINCT 'class' AS "table", 'group' AS missing_in, 'R' || r AS id FROM class WHERE r NOT IN (SELECT r_regionkey FROM region)
        UNION ALL SELECT DISTINCT 'synonym', 'class', 'C' || s_suppkey % 27 FROM supplier WHERE s_suppkey % 27 NOT IN (SELECT c FROM class) UNION ALL SELECT DISTINCT 'classfeature', 'class', 'C' || c FROM cf WHERE c NOT IN (SELECT c FROM class)
        UNION ALL SELECT DISTINCT 'classfeature', 'feature', 'F' || f FROM cf WHERE f NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT DISTINCT 'classfeature', 'unit', 'U' || u FROM cf WHERE u NOT IN (SELECT u FROM unit)
        UNION ALL SELECT DISTINCT 'classfeaturevalue', 'value', 'V' || v FROM cfv WHERE v NOT IN ('A', 'N') UNION ALL SELECT DISTINCT 'classfeaturevalue', 'classfeature', 'm' || m FROM cfv WHERE m NOT IN (SELECT m FROM cf)
    """,
    "taxonomy_features": f"""WITH {_TAX} SELECT 'C' || c AS "CLASSID", 'F' || f AS "FEATUREID", p_name AS "FEATUREDESC", kind AS "FEATURETYPE", abbrev AS "UNITABBREV", position FROM features""",
    "value_validation": f"""
        WITH {_TAX}, picks AS (SELECT DISTINCT features.c, features.f FROM cfv JOIN features USING (m) WHERE v IN ('A', 'N')), amber AS (SELECT features.c, features.f, bool_or(v = 'A') AS a, bool_or(v = 'N') AS n FROM cfv JOIN features USING (m) WHERE v IN ('A', 'N') GROUP BY 1, 2),
        claims AS (SELECT l_partkey AS k, l_suppkey AS s, l_partkey % 26 + CASE WHEN l_suppkey % 11 = 0 THEN 1 ELSE 0 END AS c, CASE WHEN l_suppkey % 7 <> 0 AND l_partkey % 7 = 0 THEN ['mm', 'V', 'kg', 'Hz', NULL][(l_partkey + CASE WHEN l_suppkey % 7 = 1 THEN 1 ELSE 0 END) % 5 + 1] END AS unit FROM lineitem),
        met AS (SELECT claims.*, x.kind, x.abbrev, y.f IS NOT NULL AS listed, y.a, y.n FROM claims LEFT JOIN features x ON x.c = claims.c AND x.f = claims.k LEFT JOIN amber y ON y.c = claims.c AND y.f = claims.k),
        judged AS (SELECT k % 10 AS last, CASE WHEN kind IS NULL THEN 'UNKNOWN_FEATURE' WHEN kind = 'N' AND s % 5 = 0 THEN 'NOT_A_NUMBER' WHEN kind = 'N' AND s % 5 = 1 THEN 'NOT_FINITE' WHEN kind = 'N' AND abbrev IS NOT NULL AND unit IS NULL THEN 'UNIT_MISSING'
            WHEN unit IS NOT NULL AND unit IS DISTINCT FROM abbrev THEN 'UNIT_UNEXPECTED' WHEN kind = 'L' AND s % 4 = 0 THEN 'NOT_A_BOOLEAN' WHEN kind = 'A' AND listed AND NOT ((s % 3 = 0 AND a) OR (s % 3 = 1 AND n)) THEN 'NOT_IN_PICKLIST' END AS issue FROM met)
        SELECT issue, last::VARCHAR AS last, count(*) AS n FROM judged GROUP BY 1, 2
    """,
    "reference_keys": r"""
        WITH x AS (SELECT p_partkey, p_partkey AS p, p_brand, lower(p_name || ' (of) a, x/y ' || p_type) AS d FROM part)
        SELECT p_partkey, 'A-' || p || p % 7 || 'B' AS mpn, p % 3 <> 0 AS same_mpn, upper(replace(p_brand, '#', ' # ')) AS brand, array_to_string(regexp_extract_all(d, '[a-z0-9]+'), ' ') AS words,
               (WITH w AS (SELECT unnest(string_split('p ' || p || ' ' || translate(d, ',;/()[]{}-_+.:\"''', '                 '), ' ')) AS w, generate_subscripts(string_split('p ' || p || ' ' || translate(d, ',;/()[]{}-_+.:\"''', '                 '), ' '), 1) AS i)
                SELECT string_agg(w, ' ' ORDER BY i) FROM (SELECT w, min(i) AS i FROM w WHERE length(w) > 1 GROUP BY w)) AS class_tokens
        FROM x
    """,
    "shared_prefixes": "SELECT p_partkey, (SELECT count(*) FROM (SELECT unnest(range(1, length(p_partkey::VARCHAR) + 1)) AS i) WHERE substr(p_partkey::VARCHAR || 'X', 1, i) = substr(reverse(p_partkey::VARCHAR), 1, i)) AS shared FROM part",
    "source_units": "SELECT ['MM', ' mm ', 'KV', 'mw', 'hz', 'Va', 'furlong', '', 'kΩ', 'S'][l_partkey % 10 + 1] AS spelt, ['mm', 'mm', 'kV', NULL, 'Hz', 'VA', NULL, NULL, 'kΩ', 's'][l_partkey % 10 + 1] AS unit, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "rendered_numbers": "SELECT format('{:g}', (l_extendedprice / 7 + 0.0001234567::DOUBLE) * [1e-11::DOUBLE, 1e-7::DOUBLE, 1e-4::DOUBLE, 1.0::DOUBLE, 100.0::DOUBLE, 1e5::DOUBLE][l_partkey % 6 + 1]) AS shown, count(*) AS n FROM lineitem GROUP BY 1",
    "line_ends": "SELECT doc_id, sha256(text) AS sha FROM documents",
    "excerpts": "SELECT doc_id, substr(text, greatest(1, instr(text, 'the') - 20), instr(text, 'the') + 23 - greatest(1, instr(text, 'the') - 20)) AS around FROM documents WHERE contains(text, 'the')",
    "relevance_texts": r"""
        WITH x AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS frag FROM pages)
        SELECT page_id, array_to_string(list_concat([CASE WHEN page_id % 2 = 0 THEN 'A title' ELSE '' END], list_transform(list_filter(list_concat(list_concat(string_split(path, '/'), list_transform(string_split(query, '&'), lambda q: regexp_extract(q, '=(.*)', 1))), [frag]), lambda t: t <> ''), lambda t: url_decode(t))), '|') AS texts FROM x
    """,
    "web_identity": """
        WITH x AS (SELECT page_id, page_id % 12 AS s, page_id AS n FROM pages), r AS (
            SELECT page_id, CASE WHEN n % 29 = 0 THEN 'INVALID_TARGET_MPN' WHEN n % 37 = 0 THEN 'MANUFACTURER_AUTHORITY_REQUIRED' WHEN n % 31 = 0 THEN 'PUBLISHER_MISMATCH' ELSE ['EXACT_PRODUCT_MPN', 'EXACT_PRODUCT_MPN', 'CONFLICTING_PRODUCT_MPN', 'MULTIPLE_PRODUCTS_AMBIGUOUS', 'TARGET_ONLY_IN_NONPRIMARY_PRODUCT',
                'PRODUCT_MPN_MISMATCH', 'MALFORMED_JSONLD', 'MPN_ONLY_IN_TITLE', 'MPN_ONLY_IN_URL', 'MPN_ABSENT', 'MPN_ONLY_IN_VISIBLE_TEXT', 'NO_PRODUCT_IDENTITY_STRUCTURE'][s + 1] END AS reason FROM x)
        SELECT page_id, reason, CASE WHEN reason = 'EXACT_PRODUCT_MPN' THEN 'EXACT' WHEN reason IN ('CONFLICTING_PRODUCT_MPN', 'MULTIPLE_PRODUCTS_AMBIGUOUS') THEN 'REVIEW' ELSE 'WITHHOLD' END AS decision FROM r
    """,
    "row_reports": """
        WITH x AS (SELECT p_partkey AS p, ['VERIFIED', 'REVIEW', 'WITHHELD'][p_partkey % 3 + 1] AS m, ['VERIFIED', 'REVIEW'][p_partkey % 2 + 1] AS c FROM part)
        SELECT 'P-' || p AS mpn, CASE WHEN m = 'WITHHELD' THEN 'WITHHELD' WHEN m = 'REVIEW' OR c = 'REVIEW' THEN 'REVIEW' ELSE 'PARTIAL' END AS state, CASE WHEN m <> 'VERIFIED' THEN 'm' || p % 4 WHEN c <> 'VERIFIED' THEN 'c' || p % 5 ELSE '' END AS reason FROM x
    """,
}
