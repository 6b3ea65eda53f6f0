"""Queries over a catalogue view of part and supplier, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.functions import text as T
from catalith.functions import values as V
from catalith.operators import catalogue as C

#: Injected product families: each phrase list is one cue, all of whose phrases must occur.
CUES = [("WIDGET", ("widget",)), ("FASTENER", ("bolt",)), ("FASTENER", ("ring", "rod")), ("GEARING", ("gear",)), ("GEARING", ("gear", "ring")), ("ROD", ("rod",)), ("SMALL_WIDGET", ("small", "widget"))]
PRECEDENCE = (("SMALL_WIDGET", "WIDGET"),)
FAMILIES = sorted({f for f, _ in CUES} | {"UNKNOWN"})
DECISIONS = ["COMMIT", "REVIEW", "WITHHOLD", "UNMAPPED"]


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(spark, sf_dir):
    """The six catalogue fields of each part; supplier keys run from 0, so part p has supplier p mod their number."""
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    part = read(spark, sf_dir, "part")
    n = supplier.count()
    key, mpn = F.col("p_partkey"), F.concat(F.lit("P-"), F.col("p_partkey").cast("string"))
    rows = part.join(supplier, key % n == F.col("s_suppkey"))
    return rows.select(
        key.alias("row_number"),
        mpn.alias("Mfg_Part_Num"),
        F.concat_ws(" ", mpn, "p_name", "p_type").alias("Part_Desc"),
        F.when(key % 5 == 0, "-- Unbranded --").otherwise(F.col("p_brand")).alias("E1_Brand"),
        F.lit("-- No Unilog Brand --").alias("Unilog_Brand"),
        F.when(key % 4 == 0, "-- No DIB Brand --").when(key % 4 == 1, F.lower("p_brand")).when(key % 4 == 2, F.col("p_brand")).otherwise("Brand#0").alias("DIB_Brand"),
        F.when(key % 25 == 0, "-").otherwise(F.concat(F.col("s_name"), F.lit(" (S"), F.col("s_suppkey").cast("string"), F.lit(")"))).alias("Part_Manuf"),
        "p_brand",
        "p_type",
    )


VIEW = """
    n AS (SELECT count(*) AS n FROM supplier), cat AS (
        SELECT p_partkey AS row_number, concat('P-', p_partkey) AS mpn, concat('P-', p_partkey, ' ', p_name, ' ', p_type) AS descr,
               CASE WHEN p_partkey % 5 = 0 THEN '-- Unbranded --' ELSE p_brand END AS e1, '-- No Unilog Brand --' AS uni,
               CASE p_partkey % 4 WHEN 0 THEN '-- No DIB Brand --' WHEN 1 THEN lower(p_brand) WHEN 2 THEN p_brand ELSE 'Brand#0' END AS dib,
               CASE WHEN p_partkey % 25 = 0 THEN '-' ELSE concat(s_name, ' (S', s_suppkey, ')') END AS manuf, p_brand, p_type
        FROM part, n JOIN supplier ON s_suppkey = p_partkey % n.n
    )"""
_USABLE = lambda c, dash="": f"CASE WHEN trim({c}) = '' OR regexp_full_match(trim({c}), '--\\s*.*?\\s*--'){dash and f' OR trim({c}) = ' + chr(39) + '-' + chr(39)} THEN NULL ELSE trim({c}) END"
_KEY = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
_BRANDS = f"""SELECT row_number, list_filter([{_USABLE('e1')}, {_USABLE('uni')}, {_USABLE('dib')}], lambda x: x IS NOT NULL) AS u FROM cat"""
_CONSENSUS = f"""
    b AS ({_BRANDS}), k AS (SELECT row_number, u, len(u) AS n, len(list_distinct(list_transform(u, lambda x: {_KEY('x')}))) AS k FROM b),
    brands AS (SELECT row_number, CASE WHEN k = 1 THEN u[1] END AS brand,
        CASE WHEN n = 0 THEN 'WITHHOLD' WHEN n > 1 AND k = 1 THEN 'COMMIT' ELSE 'REVIEW' END AS brand_decision,
        CASE WHEN n = 0 THEN 'PLACEHOLDER' WHEN n > 1 AND k = 1 THEN 'BRAND_SOURCE_CONSENSUS' WHEN k > 1 THEN 'CONFLICTING_BRAND_SOURCES' ELSE 'SINGLE_BRAND_SOURCE' END AS brand_reason FROM k)"""
_MANUF = """
    m AS (SELECT row_number, trim(manuf) AS s FROM cat), manufs AS (
        SELECT row_number, CASE WHEN s = '' THEN 'MISSING' WHEN s = '-' THEN 'PLACEHOLDER' WHEN regexp_full_match(s, '.+?\\s*\\([^()]+\\)') THEN 'NAME_WITH_CODE' ELSE 'NAME_ONLY' END AS manuf_status,
               CASE WHEN s <> '-' THEN regexp_extract(s, '^(.*?)\\s*\\(([^()]*)\\)$', 1) END AS manuf_name,
               CASE WHEN s <> '-' THEN regexp_extract(s, '^(.*?)\\s*\\(([^()]*)\\)$', 2) END AS manuf_code FROM m)"""
_HAS = lambda p: f"contains(t, ' {p} ')"
_CLASSES = f"""
    t AS (SELECT row_number, concat(' ', array_to_string(regexp_extract_all(lower(descr), '[a-z0-9]+'), ' '), ' ') AS t,
                 len(regexp_extract_all(lower(descr), '[a-z0-9]+')) - 2 AS content FROM cat),
    f AS (SELECT row_number, content, {_HAS('small')} AND {_HAS('widget')} AND {_HAS('widget')} AS both_w,
          list_filter([CASE WHEN {_HAS('bolt')} OR ({_HAS('ring')} AND {_HAS('rod')}) THEN 'FASTENER' END, CASE WHEN {_HAS('gear')} THEN 'GEARING' END,
                       CASE WHEN {_HAS('rod')} THEN 'ROD' END, CASE WHEN {_HAS('small')} AND {_HAS('widget')} THEN 'SMALL_WIDGET' END,
                       CASE WHEN {_HAS('widget')} AND NOT {_HAS('small')} THEN 'WIDGET' END], lambda x: x IS NOT NULL) AS fam FROM t),
    classes AS (SELECT row_number, CASE WHEN len(fam) = 1 THEN fam[1] ELSE 'UNKNOWN' END AS family, array_to_string(fam, ',') AS candidates,
          CASE len(fam) WHEN 1 THEN 'COMMIT' WHEN 0 THEN 'WITHHOLD' ELSE 'REVIEW' END AS class_decision,
          CASE WHEN len(fam) = 1 THEN CASE WHEN both_w THEN 'SPECIFIC_FAMILY_PRECEDENCE' ELSE 'STRONG_LEXICAL_CUE' END WHEN len(fam) > 1 THEN 'OVERLAPPING_FAMILY_CUES'
               WHEN content <= 2 THEN 'INSUFFICIENT_DESCRIPTION' ELSE 'NO_FAMILY_CUE' END AS class_reason FROM f)"""


def catalog_clean(spark, sf_dir):
    rows = C.cleaned(catalogue(spark, sf_dir))
    return rows.select("row_number", *[F.col(f"clean_{c}").alias(c.lower()) for c in C.FIELDS])


def brand_consensus(spark, sf_dir):
    return C.brand_consensus(C.cleaned(catalogue(spark, sf_dir))).select("row_number", "brand", "brand_decision", "brand_reason")


def manufacturer_parse(spark, sf_dir):
    return C.parse_manufacturer(catalogue(spark, sf_dir)).select("row_number", "manuf_status", "manuf_name", "manuf_code")


def classified(spark, sf_dir):
    return C.classify(catalogue(spark, sf_dir), CUES, PRECEDENCE)


def family_classify(spark, sf_dir):
    return classified(spark, sf_dir).select("row_number", "family", "class_decision", "class_reason", "candidates")


def family_representatives(spark, sf_dir):
    return C.first_per(classified(spark, sf_dir), ["family"], ["row_number"], 3).select("family", F.col("position").cast("long").alias("position"), "row_number", "Mfg_Part_Num")


def family_histogram(spark, sf_dir):
    return C.zero_filled(classified(spark, sf_dir), "family", [*FAMILIES, "NEVER_SEEN"])


def decision_counts_zero_filled(spark, sf_dir):
    return C.zero_filled(C.brand_consensus(C.cleaned(catalogue(spark, sf_dir))), "brand_decision", DECISIONS)


def catalog_decisions(spark, sf_dir):
    """The flagship: clean, parse, decide brands, classify, and count by decision."""
    rows = C.parse_manufacturer(C.brand_consensus(C.cleaned(classified(spark, sf_dir))))
    return rows.groupBy("class_decision", "brand_decision", "manuf_status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("brand").alias("brands"))


def _rules(spark, sf_dir):
    """Canonical names from suppliers in odd spellings; every seventh name has two owners."""
    s = read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0")
    n = F.col("s_suppkey")
    name = F.col("s_name")
    alias = F.when(n % 6 == 0, F.upper(name)).when(n % 6 == 2, F.concat(F.lit("  "), name, F.lit("  "))).otherwise(F.concat(F.translate(name, "#", "-"), F.lit(" Inc.")))
    canonical = F.concat(F.lit("Canon "), n.cast("string"))
    one = s.select(canonical.alias("canonical"), alias.alias("alias"), F.lit(True).alias("is_alias"))
    two = s.where(n % 14 == 0).select(F.concat(F.lit("Rival "), n.cast("string")).alias("canonical"), alias.alias("alias"), F.lit(True).alias("is_alias"))
    return one.union(two)


def staged_lookup(spark, sf_dir):
    names = C.parse_manufacturer(catalogue(spark, sf_dir)).select("row_number", "manuf_name")
    return C.staged_lookup(names, "manuf_name", _rules(spark, sf_dir), "row_number").select("row_number", F.col("stage").cast("long").alias("stage"), "reason", "canonical")


_STAGE_KEYS = lambda c: f"[{c}, trim(regexp_replace({c}, '\\s+', ' ', 'g')), lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), {_KEY(c)}, CASE WHEN len(list_filter(string_split({_KEY(c)}, ' '), lambda t: t NOT IN {T.LEGAL_SUFFIXES})) > 0 THEN array_to_string(list_filter(string_split({_KEY(c)}, ' '), lambda t: t NOT IN {T.LEGAL_SUFFIXES}), ' ') ELSE {_KEY(c)} END]"


def company_keys(spark, sf_dir):
    decorated = lambda c, k: F.concat(F.col(c), F.when(F.col(k) % 3 == 0, " Co., Inc.").when(F.col(k) % 3 == 1, " USA LLC").otherwise("  GmbH"))
    supplier = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("side"), F.col("s_suppkey").alias("id"), decorated("s_name", "s_suppkey").alias("name"))
    customer = read(spark, sf_dir, "customer").select(F.lit("customer").alias("side"), F.col("c_custkey").alias("id"), decorated("c_name", "c_custkey").alias("name"))
    return supplier.union(customer).select("side", "id", T.company_key("name").alias("legal_key"), T.company_key("name", T.HINT_SUFFIXES).alias("hint_key"))


_SUFFIXED = lambda c, s: f"CASE WHEN len(list_filter(string_split({_KEY(c)}, ' '), lambda t: t NOT IN {s})) > 0 THEN array_to_string(list_filter(string_split({_KEY(c)}, ' '), lambda t: t NOT IN {s}), ' ') ELSE {_KEY(c)} END"


def row_validation(spark, sf_dir):
    """Issues of each row: parts whose name repeats, blank fields, placeholders."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_number"), F.upper("p_name").alias("key"), F.when(F.col("p_partkey") % 10 == 0, " ").otherwise(F.col("p_brand")).alias("brand"))
    n = F.count(F.lit(1)).over(Window.partitionBy("key"))
    issues = F.array(F.when(n > 1, "DUPLICATE_MPN"), F.when(T.strip("brand") == "", "BLANK_BRAND"))
    return part.select("row_number", F.array_join(F.filter(issues, lambda x: x.isNotNull()), ",").alias("issues"), n.alias("same"))


def name_code_cardinality(spark, sf_dir):
    """Manufacturers that come with more than one code; some rows give theirs another one."""
    other = F.when(F.col("row_number") % 37 == 7, F.replace("Part_Manuf", F.lit("(S"), F.lit("(T"))).otherwise(F.col("Part_Manuf"))
    rows = C.parse_manufacturer(catalogue(spark, sf_dir).withColumn("Part_Manuf", other)).where("manuf_status = 'NAME_WITH_CODE'")
    return rows.groupBy(F.col("manuf_name").alias("name")).agg(F.count_distinct("manuf_code").alias("codes"), F.count(F.lit(1)).alias("n")).where("codes > 1")


def brand_source_patterns(spark, sf_dir):
    rows = C.cleaned(catalogue(spark, sf_dir))
    pattern = F.concat_ws("+", *[F.when(F.col(f"clean_{c}").isNotNull(), F.lit(c)) for c in C.BRANDS])
    return rows.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def one_row_per_manufacturer(spark, sf_dir):
    rows = C.parse_manufacturer(catalogue(spark, sf_dir)).where("manuf_name IS NOT NULL").withColumn("key", F.lower("manuf_name"))
    return C.first_per(rows, ["key"], ["row_number"]).select("row_number", "manuf_name", "Mfg_Part_Num")


def sample_mpns(spark, sf_dir):
    """For each manufacturer: rows, the last spelling, and its first five part numbers; samples are cut before they are gathered."""
    rows = C.parse_manufacturer(catalogue(spark, sf_dir)).where("manuf_code IS NOT NULL")
    five = C.first_per(rows, ["manuf_code"], ["row_number"], 5).groupBy("manuf_code").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_number", "Mfg_Part_Num"))), lambda x: x["Mfg_Part_Num"]), ",").alias("samples"))
    stats = rows.groupBy("manuf_code").agg(F.count(F.lit(1)).alias("n"), F.max_by("manuf_name", "row_number").alias("last_name"))
    return stats.join(five, "manuf_code")


def query_builder(spark, sf_dir):
    rows = C.parse_manufacturer(catalogue(spark, sf_dir)).where("manuf_name IS NOT NULL")
    domains = F.array(F.concat(F.lower("manuf_code"), F.lit(".example.com")), F.concat(F.lower("manuf_code"), F.lit(".example.org")), F.lit("third.example"))
    rows = rows.select("row_number", F.col("Mfg_Part_Num").alias("mpn"), F.col("manuf_name").alias("manufacturer"), F.col("p_brand").alias("brand"), F.when(F.col("row_number") % 2 == 0, domains).otherwise(F.array().cast("array<string>")).alias("domains"))
    return C.build_queries(rows).select("row_number", F.array_join("queries", " | ").alias("queries"), F.size("queries").cast("long").alias("n"))


def unit_convert(spark, sf_dir):
    size = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.get(F.array(*map(F.lit, ("mm", "in", "m", "kg", "°C", "furlong"))), (F.col("p_partkey") % 6).cast("int")).alias("unit"), F.get(F.array(*map(F.lit, ("mm", "cm", "in", "K"))), (F.col("p_partkey") % 4).cast("int")).alias("to"))
    return V.convert(size, "x", "unit", "to").select("p_partkey", "unit", "to", F.round("converted", 6).alias("converted"), "convert_status")


def slot_assembly(spark, sf_dir):
    """Slots 1, 2, ... of each brand's part types, by priority then label."""
    types = read(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    slot = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("n").desc(), "p_type")).cast("long")
    return types.select("p_brand", "p_type", "n", slot.alias("slot"))


def schema_diff(spark, sf_dir):
    """Headers of two contracts: missing, extra, and the first place where the order differs."""
    a = spark.createDataFrame([(i, h) for i, h in enumerate("sku name brand type size price unit note".split())], "pos int, header string")
    b = spark.createDataFrame([(i, h) for i, h in enumerate("sku brand name type size cost unit".split())], "pos int, header string")
    missing = a.join(b, "header", "left_anti").select(F.lit("MISSING").alias("kind"), "header", F.col("pos").cast("long").alias("pos"))
    extra = b.join(a, "header", "left_anti").select(F.lit("EXTRA").alias("kind"), "header", F.col("pos").cast("long").alias("pos"))
    moved = a.alias("a").join(b.alias("b"), F.expr("a.pos = b.pos AND a.header <> b.header")).select(F.lit("ORDER").alias("kind"), F.col("a.header").alias("header"), F.col("a.pos").cast("long").alias("pos"))
    return missing.union(extra).union(moved.orderBy("pos").limit(1))


def grid_search_page(spark, sf_dir):
    """Search, sort and page as a grid does: case-blind substring, total order, offset."""
    part = read(spark, sf_dir, "part")
    found = part.where(F.lower("p_name").contains("gear") | F.lower("p_brand").contains("gear"))
    return found.orderBy("p_brand", F.col("p_size").desc(), "p_partkey").offset(20).limit(25).select("p_partkey", "p_name", "p_brand", "p_size")


QUERIES = {f.__name__: f for f in (
    catalog_clean, brand_consensus, manufacturer_parse, family_classify, family_representatives, family_histogram, decision_counts_zero_filled, catalog_decisions, staged_lookup, company_keys,
    row_validation, name_code_cardinality, brand_source_patterns, one_row_per_manufacturer, sample_mpns, query_builder, unit_convert, slot_assembly, schema_diff, grid_search_page,
)}

_WITH = f"WITH {VIEW}"
_UNIT_ROWS = ", ".join(f"('{s}', '{d}', {f}::DOUBLE, {s in V.AFFINE})" for s, d, f in V.UNITS)
ORACLE_SQL = {
    "catalog_clean": f"{_WITH} SELECT row_number, {_USABLE('mpn')} AS mfg_part_num, {_USABLE('descr')} AS part_desc, {_USABLE('e1')} AS e1_brand, {_USABLE('uni')} AS unilog_brand, {_USABLE('dib')} AS dib_brand, {_USABLE('manuf', 'dash')} AS part_manuf FROM cat",
    "brand_consensus": f"{_WITH}, {_CONSENSUS} SELECT row_number, brand, brand_decision, brand_reason FROM brands",
    "manufacturer_parse": f"{_WITH}, {_MANUF} SELECT row_number, manuf_status, manuf_name, manuf_code FROM manufs",
    "family_classify": f"{_WITH}, {_CLASSES} SELECT row_number, family, class_decision, class_reason, candidates FROM classes",
    "family_representatives": f"{_WITH}, {_CLASSES} SELECT family, row_number() OVER (PARTITION BY family ORDER BY row_number) AS position, row_number, mpn AS \"Mfg_Part_Num\" FROM classes JOIN cat USING (row_number) QUALIFY position <= 3",
    "family_histogram": f"{_WITH}, {_CLASSES} SELECT member, count(family) AS n FROM (VALUES {', '.join(f'({f!r})' for f in [*FAMILIES, 'NEVER_SEEN'])}) v(member) LEFT JOIN classes ON family = member GROUP BY 1",
    "decision_counts_zero_filled": f"{_WITH}, {_CONSENSUS} SELECT member, count(brand_decision) AS n FROM (VALUES {', '.join(f'({f!r})' for f in DECISIONS)}) v(member) LEFT JOIN brands ON brand_decision = member GROUP BY 1",
    "catalog_decisions": f"{_WITH}, {_CONSENSUS}, {_MANUF}, {_CLASSES} SELECT class_decision, brand_decision, manuf_status, count(*) AS n, count(DISTINCT brand) AS brands FROM classes JOIN brands USING (row_number) JOIN manufs USING (row_number) GROUP BY 1, 2, 3",
    "staged_lookup": f"""{_WITH}, {_MANUF}, s AS (SELECT s_suppkey AS k, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0),
        al AS (SELECT k, CASE WHEN k % 6 = 0 THEN upper(name) WHEN k % 6 = 2 THEN concat('  ', name, '  ') ELSE concat(replace(name, '#', '-'), ' Inc.') END AS alias FROM s),
        rules AS (SELECT concat('Canon ', k) AS canonical, alias FROM al UNION ALL SELECT concat('Rival ', k), alias FROM al WHERE k % 14 = 0),
        r AS (SELECT canonical, unnest({_STAGE_KEYS('alias')}) AS key, unnest(range(5)) AS stage FROM rules),
        v AS (SELECT row_number, unnest({_STAGE_KEYS('manuf_name')}) AS key, unnest(range(5)) AS stage FROM manufs WHERE manuf_name IS NOT NULL),
        h AS (SELECT row_number, stage, count(DISTINCT canonical) AS c, min(canonical) AS canonical FROM v JOIN r USING (stage, key) WHERE key <> '' GROUP BY 1, 2),
        best AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY row_number ORDER BY stage) = 1)
        SELECT m.row_number, stage, CASE WHEN c > 1 THEN 'AMBIGUOUS_ALIAS' WHEN c IS NULL THEN 'UNKNOWN_MANUFACTURER' ELSE ['EXACT_ALIAS', 'WHITESPACE_NORMALIZED', 'CASE_NORMALIZED', 'PUNCTUATION_NORMALIZED', 'LEGAL_SUFFIX_NORMALIZED'][stage + 1] END AS reason,
               CASE WHEN c = 1 THEN canonical END AS canonical FROM manufs m LEFT JOIN best b ON b.row_number = m.row_number""",
    "company_keys": f"""WITH x AS (SELECT 'supplier' AS side, s_suppkey AS id, concat(s_name, CASE s_suppkey % 3 WHEN 0 THEN ' Co., Inc.' WHEN 1 THEN ' USA LLC' ELSE '  GmbH' END) AS name FROM supplier
        UNION ALL SELECT 'customer', c_custkey, concat(c_name, CASE c_custkey % 3 WHEN 0 THEN ' Co., Inc.' WHEN 1 THEN ' USA LLC' ELSE '  GmbH' END) FROM customer)
        SELECT side, id, {_SUFFIXED('name', T.LEGAL_SUFFIXES)} AS legal_key, {_SUFFIXED('name', T.HINT_SUFFIXES)} AS hint_key FROM x""",
    "row_validation": "SELECT p_partkey AS row_number, concat_ws(',', CASE WHEN same > 1 THEN 'DUPLICATE_MPN' END, CASE WHEN p_partkey % 10 = 0 THEN 'BLANK_BRAND' END) AS issues, same FROM (SELECT p_partkey, count(*) OVER (PARTITION BY upper(p_name)) AS same FROM part)",
    "name_code_cardinality": f"{_WITH}, {_MANUF} SELECT manuf_name AS name, count(DISTINCT CASE WHEN row_number % 37 = 7 THEN 'T' || substr(manuf_code, 2) ELSE manuf_code END) AS codes, count(*) AS n FROM manufs WHERE manuf_status = 'NAME_WITH_CODE' GROUP BY 1 HAVING codes > 1",
    "brand_source_patterns": f"{_WITH} SELECT concat_ws('+', CASE WHEN {_USABLE('e1')} IS NOT NULL THEN 'E1_Brand' END, CASE WHEN {_USABLE('uni')} IS NOT NULL THEN 'Unilog_Brand' END, CASE WHEN {_USABLE('dib')} IS NOT NULL THEN 'DIB_Brand' END) AS pattern, count(*) AS n FROM cat GROUP BY 1",
    "one_row_per_manufacturer": f"{_WITH}, {_MANUF} SELECT row_number, manuf_name, mpn AS \"Mfg_Part_Num\" FROM manufs JOIN cat USING (row_number) WHERE manuf_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(manuf_name) ORDER BY row_number) = 1",
    "sample_mpns": f"{_WITH}, {_MANUF} SELECT manuf_code, count(*) AS n, max_by(manuf_name, row_number) AS last_name, array_to_string(list(mpn ORDER BY row_number)[1:5], ',') AS samples FROM manufs JOIN cat USING (row_number) WHERE manuf_code IS NOT NULL GROUP BY 1",
    "query_builder": f"""{_WITH}, {_MANUF}, q AS (SELECT row_number, list_concat(CASE WHEN row_number % 2 = 0 THEN [concat('site:', lower(manuf_code), '.example.com "', mpn, '"'), concat('site:', lower(manuf_code), '.example.org "', mpn, '"')] ELSE [] END,
        [concat('"', manuf_name, '" "', mpn, '"'), concat('"', mpn, '" datasheet'), concat('"', p_brand, '" "', mpn, '"')])[1:4] AS q FROM manufs JOIN cat USING (row_number) WHERE manuf_name IS NOT NULL)
        SELECT row_number, array_to_string(q, ' | ') AS queries, len(q) AS n FROM q""",
    "unit_convert": f"""WITH u(symbol, dimension, factor, affine) AS (VALUES {_UNIT_ROWS}), x AS (SELECT p_partkey, p_size::DOUBLE AS x, ['mm', 'in', 'm', 'kg', '°C', 'furlong'][p_partkey % 6 + 1] AS unit, ['mm', 'cm', 'in', 'K'][p_partkey % 4 + 1] AS "to" FROM part),
        j AS (SELECT x.*, s.symbol AS ss, t.symbol AS ts, CASE WHEN s.symbol IS NULL OR t.symbol IS NULL THEN 'UNKNOWN_UNIT' WHEN s.dimension <> t.dimension THEN 'INCOMPATIBLE' WHEN s.symbol = t.symbol THEN 'IDENTITY' WHEN s.affine OR t.affine THEN 'AFFINE_REFUSED' ELSE 'CONVERTED' END AS convert_status, s.factor / t.factor AS f
              FROM x LEFT JOIN u s ON s.symbol = unit LEFT JOIN u t ON t.symbol = "to")
        SELECT p_partkey, unit, "to", round(CASE convert_status WHEN 'IDENTITY' THEN x WHEN 'CONVERTED' THEN x * f END, 6) AS converted, convert_status FROM j""",
    "slot_assembly": "SELECT p_brand, p_type, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS slot FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)",
    "schema_diff": """WITH a AS (SELECT unnest(string_split('sku name brand type size price unit note', ' ')) AS header, unnest(range(8)) AS pos), b AS (SELECT unnest(string_split('sku brand name type size cost unit', ' ')) AS header, unnest(range(7)) AS pos)
        SELECT 'MISSING' AS kind, header, pos FROM a WHERE header NOT IN (SELECT header FROM b) UNION ALL SELECT 'EXTRA', header, pos FROM b WHERE header NOT IN (SELECT header FROM a)
        UNION ALL SELECT * FROM (SELECT 'ORDER', a.header, a.pos FROM a JOIN b ON a.pos = b.pos AND a.header <> b.header ORDER BY a.pos LIMIT 1)""",
    "grid_search_page": "SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE contains(lower(p_name), 'gear') OR contains(lower(p_brand), 'gear') ORDER BY p_brand, p_size DESC, p_partkey LIMIT 25 OFFSET 20",
}
