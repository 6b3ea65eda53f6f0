"""Queries over web pages with structured data, with their SQL twins.

The driver's pages have no JSON-LD, so each page is given a block and two labelled
lines made from its own columns in front of its own text; SQL makes the same and reads it with
JSON functions of its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.operators import webattributes as W
from catalith.plans.catalog import read
from catalith.session import scratch_folder
from catalith.sources import artifacts as A

RULES = (
    ("depth", "NUMBER", ["Depth"], False, []),
    ("height", "NUMBER", ["Height"], False, []),
    ("finish", "ENUM", ["finish"], True, []),
    ("wattage", "NUMBER", [], False, ["Wattage"]),
    ("socket", "TEXT", [], False, ["Socket"]),
)


def _rules(spark):
    return spark.createDataFrame(RULES, "source_key string, rule_kind string, property_names array<string>, own_id boolean, text_labels array<string>")


def _shaped(spark, sf_dir):
    """pages with what is made of them: n, mpn, other (an id that is the target's or not), json, watts, socket, html."""
    n = F.col("page_id")
    text = lambda c: F.col(c).cast("string")
    df = read(spark, sf_dir, "pages").select("page_id", "url", "html", n.alias("n"), F.concat(F.lit("M-"), n.cast("string")).alias("mpn"))
    df = df.withColumn("other", F.when(n % 3 == 0, F.concat(F.lit("M-"), (n + 1).cast("string"))).otherwise(F.concat(F.lit(" m-"), n.cast("string"))))
    prop = lambda name, value, unit=None, own=None: F.struct(F.lit("PropertyValue").alias("@type"), F.lit(name).alias("name"), (F.lit(None).cast("string") if own is None else own).alias("propertyID"), value.alias("value"), (F.lit(None).cast("string") if unit is None else unit).alias("unitText"))
    inches = F.concat((n % 40).cast("string"), F.lit(" in"))
    again = F.when(n % 5 == 0, (n % 9).cast("string")).otherwise((n % 7).cast("string"))
    props = F.array(prop("Depth", inches), prop("Height", (n % 7).cast("string"), F.lit("in")), prop("finish", F.lit("Matte Black"), own=F.col("other")), prop("Height", again, F.lit("in")))
    related = F.struct(F.lit("Product").alias("@type"), F.array(prop("Depth", F.lit("99 in"))).alias("additionalProperty"))
    document = F.struct(F.when(n % 19 == 0, "Thing").otherwise("Product").alias("@type"), F.col("mpn").alias("mpn"), F.col("url").alias("url"), props.alias("additionalProperty"), related.alias("isRelatedTo"))
    df = df.withColumns({"json": F.concat(F.to_json(document), F.when(n % 23 == 0, ",").otherwise("")), "watts": F.concat(F.lit("Wattage: "), (n % 60).cast("string"), F.lit(" W")), "socket": F.concat(F.when(n % 7 == 0, "Base").when(n % 7 == 1, "Socket: Socket").otherwise("Socket"), F.lit(": E26"))})
    page = F.concat(F.lit('<html><head><script type="application/ld+json">'), F.col("json"), F.lit("</script></head><body><p>"), F.col("watts"), F.lit("</p><p>"), F.col("socket"), F.lit("</p>"), F.col("html"), F.lit("</body></html>"))
    return df.withColumn("page", page)


def _stored(df, name):
    """df as files: what is parsed or exploded once is read by several joins."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _artifacts(spark, sf_dir):
    return _stored(A.read_artifacts(_shaped(spark, sf_dir), "page_id", html="page"), "artifacts")


def _nodes(artifacts):
    return _stored(A.json_nodes(artifacts, "page_id"), "nodes")


def _proposals(spark, sf_dir):
    """Five proposals for each page, some of them wrong in one way."""
    n = F.col("n")
    locator = lambda **k: F.struct(*[F.lit(k[c]).cast(t).alias(c) if not hasattr(k.get(c), "cast") else k[c].cast(t).alias(c) for c, t in (("kind", "string"), ("element", "int"), ("begin", "int"), ("end", "int"), ("block", "int"), ("pointer", "string"), ("page", "int"))])
    blank = dict.fromkeys(("kind", "element", "begin", "end", "block", "pointer", "page"))
    json_at = lambda pointer: locator(**blank | {"kind": "HTML_JSONLD", "block": 0, "pointer": pointer})
    row = lambda key, value, uom, kind, excerpt, at: F.struct(F.lit(key).alias("source_key"), value.alias("raw_value"), uom.alias("raw_uom"), F.lit(kind).alias("value_kind"), excerpt.alias("excerpt"), at.alias("locator"))
    depth = (n % 40 + F.when(n % 6 == 1, 1).otherwise(0)).cast("string")
    related = n % 6 == 2
    watts_end = F.length("watts")
    items = F.array(
        row("depth", F.when(related, "99").otherwise(depth), F.when(n % 6 == 0, "cm").otherwise("in"), "NUMBER", F.when(related, "99 in").otherwise(F.concat((n % 40).cast("string"), F.lit(" in"))),
            json_at(F.when(related, "/isRelatedTo/additionalProperty/0/value").when(n % 6 == 3, "/additionalProperty/00/value").otherwise("/additionalProperty/0/value"))),
        row("height", F.concat((n % 7).cast("string"), F.when(n % 4 == 0, ".0").otherwise("")), F.when(n % 8 == 7, "").otherwise("in"), "NUMBER", (n % 7).cast("string"), json_at(F.lit("/additionalProperty/1/value"))),
        row("finish", F.when(n % 2 == 0, "matte black").otherwise("Matte Black"), F.lit(""), "ENUM", F.lit("Matte Black"), json_at(F.lit("/additionalProperty/2/value"))),
        row("wattage", (n % 60).cast("string"), F.lit("W"), "NUMBER", F.when(n % 9 == 0, "Wattage: many").otherwise(F.col("watts")), locator(**blank | {"kind": "HTML_TEXT", "element": 4, "begin": 0, "end": watts_end})),
        row("socket", F.when(n % 10 == 0, "E27").otherwise("E26"), F.lit(""), "TEXT", F.col("socket"), locator(**blank | {"kind": "HTML_TEXT", "element": 5, "begin": watts_end + 1, "end": watts_end + 1 + F.length("socket")})),
    )
    return _shaped(spark, sf_dir).select("page_id", F.inline(items))


def _identities(spark, sf_dir, artifacts):
    n = F.col("page_id")
    known = artifacts.select("page_id", "sha256")
    return known.select(
        "page_id", F.when(n % 11 == 0, "REVIEW").otherwise("EXACT").alias("decision"), F.lit("EXACT_SKU").alias("scope"), F.concat(F.lit("m-"), n.cast("string")).alias("covers_mpn"), F.concat(F.lit("M-"), n.cast("string")).alias("target"),
        F.when(n % 17 == 0, F.lit("0" * 64)).otherwise(F.col("sha256")).alias("identity_sha256"), "sha256", F.when(n % 13 == 0, "KNOWN_DISTRIBUTOR").otherwise(W.APPROVED).alias("authority"),
    )


def web_verification(spark, sf_dir):
    """Each proposal with its status, reason and what the page says."""
    artifacts = _artifacts(spark, sf_dir)
    nodes = _nodes(artifacts)
    out = W.verify_web_attributes(_proposals(spark, sf_dir), "page_id", _rules(spark), _identities(spark, sf_dir, artifacts), nodes, W.property_entries(nodes, "page_id"), A.text_fragments(artifacts, "page_id"))
    return out.select("page_id", "source_key", "raw_value", "raw_uom", "status", "reason", "source_label", "source_value", "source_uom")


def _bound(spark, sf_dir):
    artifacts = _artifacts(spark, sf_dir)
    nodes = _nodes(artifacts)
    concepts = spark.createDataFrame([(k, kind, "finish" if own else None) for k, kind, _, own, _ in RULES], "source_key string, concept_kind string, variant_name string")
    proposals = _proposals(spark, sf_dir).withColumn("target", F.concat(F.lit("M-"), F.col("page_id").cast("string")))
    twice = proposals.where("page_id % 15 = 4 AND source_key = 'socket'")
    other = proposals.where("page_id % 15 = 5 AND source_key = 'depth'").withColumns({"source_key": F.lit("colour")})
    kind = F.when((F.col("page_id") % 15 == 6) & (F.col("source_key") == "height"), "TEXT").otherwise(F.col("value_kind"))
    at = F.when((F.col("page_id") % 15 == 7) & (F.col("source_key") == "depth"), F.lit(None)).otherwise(F.col("locator"))
    all_ = proposals.unionByName(twice).unionByName(other).withColumns({"value_kind": kind, "locator": at})
    return W.bind_proposals(all_, "page_id", concepts, W.addresses("page_id", A.text_fragments(artifacts, "page_id"), nodes), W.property_entries(nodes, "page_id"))


def web_binding(spark, sf_dir):
    return _bound(spark, sf_dir).select("page_id", "source_key", "binding", "code", "value_key")


def web_rejections(spark, sf_dir):
    """How many proposals ended in which way, by attribute."""
    return W.rejection_counts(_bound(spark, sf_dir), ["source_key"])


def json_node_kinds(spark, sf_dir):
    """Nodes of all JSON-LD by pointer and kind."""
    nodes = A.json_nodes(_artifacts(spark, sf_dir), "page_id")
    return nodes.groupBy("pointer", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def page_intake(spark, sf_dir):
    """Pages by how their reading ended, under limits that some of them exceed."""
    n = F.col("page_id")
    odd = F.when(n % 9 == 0, "").when(n % 9 == 1, F.concat(F.lit("%PDF-1.7 "), "html")).when(n % 9 == 2, F.repeat("html", 3)).otherwise(F.col("html"))
    pages = read(spark, sf_dir, "pages").select("page_id", odd.alias("html"), F.when(n % 9 == 3, "application/pdf").when(n % 9 == 4, "TEXT/HTML; charset=utf-8").otherwise("text/html").alias("media_type"))
    found = A.read_artifacts(pages, "page_id", media_type="media_type", max_bytes=6_000, elements=40)
    return found.select("page_id", "status", F.col("n_bytes").cast("long").alias("n_bytes"), "sha256")


QUERIES = {f.__name__: f for f in (web_verification, web_binding, web_rejections, json_node_kinds, page_intake)}

#: What both sides make of a page, and its proposals, in SQL. JSON is read by DuckDB's own functions.
_MADE = """
    shaped AS (
        SELECT page_id, page_id AS n, url, 'M-' || page_id AS mpn, CASE WHEN page_id % 3 = 0 THEN 'M-' || (page_id + 1) ELSE ' m-' || page_id END AS other, page_id % 23 = 0 AS broken,
               'Wattage: ' || page_id % 60 || ' W' AS watts, CASE page_id % 7 WHEN 0 THEN 'Base' WHEN 1 THEN 'Socket: Socket' ELSE 'Socket' END || ': E26' AS socket,
               json_object('@type', CASE WHEN page_id % 19 = 0 THEN 'Thing' ELSE 'Product' END, 'mpn', 'M-' || page_id, 'url', url, 'additionalProperty', json_array(
                   json_object('@type', 'PropertyValue', 'name', 'Depth', 'value', page_id % 40 || ' in'),
                   json_object('@type', 'PropertyValue', 'name', 'Height', 'value', (page_id % 7)::VARCHAR, 'unitText', 'in'),
                   json_object('@type', 'PropertyValue', 'name', 'finish', 'propertyID', CASE WHEN page_id % 3 = 0 THEN 'M-' || (page_id + 1) ELSE ' m-' || page_id END, 'value', 'Matte Black'),
                   json_object('@type', 'PropertyValue', 'name', 'Height', 'value', CASE WHEN page_id % 5 = 0 THEN (page_id % 9)::VARCHAR ELSE (page_id % 7)::VARCHAR END, 'unitText', 'in')),
                   'isRelatedTo', json_object('@type', 'Product', 'additionalProperty', json_array(json_object('@type', 'PropertyValue', 'name', 'Depth', 'value', '99 in')))) AS doc
        FROM pages
    ), proposals AS (
        SELECT page_id, 'depth' AS source_key, CASE WHEN n % 6 = 2 THEN '99' ELSE (n % 40 + CASE WHEN n % 6 = 1 THEN 1 ELSE 0 END)::VARCHAR END AS raw_value, CASE WHEN n % 6 = 0 THEN 'cm' ELSE 'in' END AS raw_uom, 'NUMBER' AS value_kind,
               CASE WHEN n % 6 = 2 THEN '99 in' ELSE n % 40 || ' in' END AS excerpt, CASE n % 6 WHEN 2 THEN '/isRelatedTo/additionalProperty/0/value' WHEN 3 THEN '/additionalProperty/00/value' ELSE '/additionalProperty/0/value' END AS pointer, NULL AS stored_text FROM shaped
        UNION ALL SELECT page_id, 'height', (n % 7)::VARCHAR || CASE WHEN n % 4 = 0 THEN '.0' ELSE '' END, CASE WHEN n % 8 = 7 THEN '' ELSE 'in' END, 'NUMBER', (n % 7)::VARCHAR, '/additionalProperty/1/value', NULL FROM shaped
        UNION ALL SELECT page_id, 'finish', CASE WHEN n % 2 = 0 THEN 'matte black' ELSE 'Matte Black' END, '', 'ENUM', 'Matte Black', '/additionalProperty/2/value', NULL FROM shaped
        UNION ALL SELECT page_id, 'wattage', (n % 60)::VARCHAR, 'W', 'NUMBER', CASE WHEN n % 9 = 0 THEN 'Wattage: many' ELSE watts END, NULL, watts FROM shaped
        UNION ALL SELECT page_id, 'socket', CASE WHEN n % 10 = 0 THEN 'E27' ELSE 'E26' END, '', 'TEXT', socket, NULL, socket FROM shaped
    )
"""

ORACLE_SQL = {
    "web_verification": f"""
        WITH {_MADE}, properties AS (
            SELECT page_id, json_extract_string(p, '$.name') AS name, json_extract_string(p, '$.value') AS value, coalesce(json_extract_string(p, '$.unitText'), '') AS unit, json_extract_string(p, '$.propertyID') AS own
            FROM (SELECT page_id, unnest(json_extract(doc, '$.additionalProperty[*]')) AS p FROM shaped)
        ), contradicting AS (
            SELECT page_id, CASE name WHEN 'Depth' THEN 'depth' WHEN 'Height' THEN 'height' END AS source_key FROM properties WHERE name IN ('Depth', 'Height') GROUP BY ALL HAVING count(DISTINCT (value, unit)) > 1
        ), met AS (
            SELECT p.*, s.broken, s.n, s.doc, replace(pointer, '/value', '') AS entry, c.page_id IS NOT NULL AS contradicts,
                   CASE WHEN pointer NOT LIKE '%/00/%' THEN json_extract_string(doc, pointer) END AS value, json_extract_string(doc, replace(pointer, '/value', '/name')) AS name,
                   coalesce(json_extract_string(doc, replace(pointer, '/value', '/unitText')), '') AS unit, upper(replace(json_extract_string(doc, replace(pointer, '/value', '/propertyID')), ' ', '')) AS own,
                   CASE p.source_key WHEN 'wattage' THEN 'Wattage' WHEN 'socket' THEN 'Socket' END AS label
            FROM proposals p JOIN shaped s USING (page_id) LEFT JOIN contradicting c ON c.page_id = p.page_id AND c.source_key = p.source_key
        ), judged AS (
            SELECT *, trim(substr(stored_text, length(label) + 2)) AS rest, CASE
                WHEN n % 11 = 0 THEN 'IDENTITY_NOT_EXACT' WHEN n % 17 = 0 THEN 'ARTIFACT_MISMATCH' WHEN n % 13 = 0 THEN 'MANUFACTURER_AUTHORITY_REQUIRED'
                WHEN pointer IS NOT NULL THEN CASE
                    WHEN broken THEN 'LOCATOR_INVALID'
                    WHEN json_extract_string(doc, '$."@type"') <> 'Product' OR NOT regexp_full_match(pointer, '/additionalProperty/[0-9]+/value') THEN 'OUTSIDE_TARGET_PRODUCT'
                    WHEN value IS NULL OR value <> excerpt THEN 'LOCATOR_INVALID'
                    WHEN name <> CASE source_key WHEN 'depth' THEN 'Depth' WHEN 'height' THEN 'Height' ELSE 'finish' END THEN 'SOURCE_PROPERTY_NOT_AUTHORIZED'
                    WHEN source_key = 'finish' AND own <> 'M-' || page_id THEN 'PROPERTY_ID_MISMATCH'
                    WHEN contradicts THEN 'CONFLICTING_PROPERTY_VALUES'
                    WHEN unit <> '' AND unit <> raw_uom THEN 'UOM_NOT_SUPPORTED'
                    WHEN unit = '' AND raw_uom <> '' AND value <> raw_value || ' ' || raw_uom THEN 'UOM_NOT_SUPPORTED'
                    WHEN value_kind = 'ENUM' AND lower(value) <> lower(raw_value) THEN 'VALUE_NOT_SUPPORTED'
                    WHEN value_kind = 'NUMBER' AND split_part(value, ' ', 1)::DECIMAL(18, 6) <> raw_value::DECIMAL(18, 6) THEN 'VALUE_NOT_SUPPORTED'
                    ELSE 'FACT_VERIFIED' END
                WHEN stored_text <> excerpt THEN 'LOCATOR_INVALID'
                WHEN len(regexp_extract_all(stored_text, label || ':')) > 1 THEN 'AMBIGUOUS_TEXT_FRAGMENT'
                WHEN NOT starts_with(stored_text, label || ':') THEN 'EXPECTED_LABEL_MISSING'
                WHEN raw_uom <> '' AND trim(substr(stored_text, length(label) + 2)) <> raw_value || ' ' || raw_uom THEN 'UOM_NOT_SUPPORTED'
                WHEN raw_uom = '' AND trim(substr(stored_text, length(label) + 2)) <> raw_value THEN 'VALUE_NOT_SUPPORTED'
                ELSE 'FACT_VERIFIED' END AS reason
            FROM met
        )
        SELECT page_id, source_key, raw_value, raw_uom, CASE reason WHEN 'FACT_VERIFIED' THEN 'VERIFIED' WHEN 'CONFLICTING_PROPERTY_VALUES' THEN 'REVIEW' ELSE 'UNVERIFIED' END AS status, reason,
               CASE WHEN seen THEN coalesce(name, label) END AS source_label,
               CASE WHEN NOT seen THEN NULL WHEN reason = 'FACT_VERIFIED' AND raw_uom <> '' AND unit = '' THEN raw_value ELSE coalesce(value, rest) END AS source_value,
               CASE WHEN NOT seen THEN NULL WHEN reason = 'FACT_VERIFIED' AND unit = '' THEN raw_uom ELSE unit END AS source_uom
        FROM (SELECT *, reason IN ('FACT_VERIFIED', 'CONFLICTING_PROPERTY_VALUES', 'UOM_NOT_SUPPORTED', 'VALUE_NOT_SUPPORTED', 'PROPERTY_ID_MISMATCH', 'SOURCE_PROPERTY_NOT_AUTHORIZED') AS seen FROM judged)
    """,
}

_BOUND = f"""
    WITH {_MADE}, offered AS (
        SELECT * FROM proposals UNION ALL SELECT * FROM proposals WHERE page_id % 15 = 4 AND source_key = 'socket'
        UNION ALL SELECT * REPLACE ('colour' AS source_key) FROM proposals WHERE page_id % 15 = 5 AND source_key = 'depth'
    ), met AS (
        SELECT p.*, s.broken, CASE WHEN NOT broken AND pointer NOT LIKE '%/00/%' THEN json_extract_string(doc, pointer) WHEN stored_text IS NOT NULL THEN stored_text END AS stored,
               upper(replace(json_extract_string(doc, replace(pointer, '/value', '/propertyID')), ' ', '')) AS own, count(*) OVER (PARTITION BY p.page_id, source_key) AS times
        FROM offered p JOIN shaped s USING (page_id)
    ), coded AS (
        SELECT *, CASE
            WHEN times > 1 THEN 'DUPLICATE_SOURCE_KEY' WHEN source_key = 'colour' THEN 'UNKNOWN_SOURCE_KEY' WHEN page_id % 15 = 6 AND source_key = 'height' THEN 'VALUE_KIND_MISMATCH'
            WHEN page_id % 15 = 7 AND source_key = 'depth' THEN 'MISSING_LOCATOR' WHEN stored IS NULL THEN 'LOCATOR_INVALID' WHEN stored <> excerpt THEN 'SOURCE_MISMATCH'
            WHEN pointer IS NOT NULL AND raw_uom = '' AND raw_value <> stored THEN 'SOURCE_MISMATCH'
            WHEN (pointer IS NULL OR raw_uom <> '') AND NOT contains(stored, raw_value || CASE WHEN raw_uom = '' THEN '' ELSE ' ' || raw_uom END) THEN 'SOURCE_MISMATCH'
            WHEN source_key = 'finish' AND own <> 'M-' || page_id THEN 'SOURCE_MISMATCH' END AS refused
        FROM met
    ), bound AS (
        SELECT page_id, source_key, CASE WHEN refused IS NULL THEN 'BOUND' ELSE 'REJECTED' END AS binding,
               coalesce(refused, CASE WHEN raw_uom NOT IN ('', 'in') THEN 'UNKNOWN_UOM' ELSE 'CANDIDATE_REQUIRES_REVIEW' END) AS code,
               CASE WHEN refused IS NULL THEN value_kind || '|' || CASE value_kind WHEN 'ENUM' THEN lower(raw_value) WHEN 'NUMBER' THEN replace(raw_value, '.0', '') ELSE raw_value END || '|' || CASE raw_uom WHEN 'in' THEN 'in' ELSE '' END END AS value_key
        FROM coded
    )
"""
ORACLE_SQL |= {
    "web_binding": f"{_BOUND} SELECT * FROM bound",
    "web_rejections": f"{_BOUND} SELECT source_key, code, count(*) AS n FROM bound GROUP BY ALL",
    "json_node_kinds": f"""
        WITH {_MADE}, nodes AS (
            SELECT replace(replace(replace(fullkey, '$', ''), '.', '/'), '[', '/') AS path, type, atom, key FROM shaped, json_tree(shaped.doc) WHERE NOT broken
        )
        SELECT replace(replace(path, ']', ''), '"', '') AS pointer, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'string' END AS kind, count(*) AS n, sum(length(json_extract_string(atom, '$')))::BIGINT AS chars
        FROM nodes GROUP BY ALL
    """,
    "page_intake": """
        WITH odd AS (
            SELECT page_id, CASE page_id % 9 WHEN 0 THEN '' WHEN 1 THEN '%PDF-1.7 ' || html WHEN 2 THEN repeat(html, 3) ELSE html END AS html, page_id % 9 = 3 AS other FROM pages
        ), sized AS (
            SELECT *, strlen(html) AS n_bytes, sha256(html) AS sha256, len(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<script.*?</script>', '<script>', 'g'), '<[A-Za-z]')) AS elements FROM odd
        )
        SELECT page_id, CASE WHEN other THEN 'NOT_HTML' WHEN n_bytes = 0 THEN 'EMPTY' WHEN n_bytes > 6000 THEN 'TOO_MANY_BYTES' WHEN starts_with(html, '%PDF-') THEN 'PDF_SIGNATURE'
                    WHEN elements > 40 THEN 'TOO_MANY_ELEMENTS' ELSE 'PARSED' END AS status, n_bytes, sha256
        FROM sized
    """,
}
