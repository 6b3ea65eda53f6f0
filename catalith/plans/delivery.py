"""Queries over whole delivery records, with their SQL twins: parts are raw rows, line items their facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.operators import delivery as D
from catalith.plans.catalog import read

HEADERS = ["Mfg_Part_Num", "Part_Desc", "E1_Brand", "MANUFACTURER_NAME", "BRAND_NAME", "Classpath", "UNSPSC", *[f"ATTRIBUTE_{k} {i}" for i in (1, 2, 3) for k in ("LABEL", "VALUE", "UOM")]]


def _facts(spark, sf_dir):
    """A fact for each part and supplier group: two sources for a target where a part has many line items there."""
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    rows = read(spark, sf_dir, "lineitem").where("l_suppkey % 9 < 4").groupBy(p.alias("p"), (s % 9).alias("g"), (F.col("l_linenumber") % 2).alias("h")).agg(F.max("l_quantity").alias("q"))
    return rows.select(
        F.concat(F.lit("P-"), F.col("p").cast("string")).alias("part"), F.concat(F.lit("T"), F.col("g").cast("string")).alias("target"), F.concat_ws("-", F.lit("k"), "g", F.when(F.col("p") % 4 == 0, F.col("h").cast("string"))).alias("source_key"), (F.col("g") % 2).alias("priority"),
        F.when((F.col("h") == 1) & (F.col("p") % 4 != 0), "WITHHOLD").otherwise("COMMIT").alias("decision"), F.lit("OTHER").alias("reason"), F.lit(True).alias("verified"), F.col("q").cast("int").cast("string").alias("value"), F.when(F.col("g") != 2, "mm").alias("uom"),
    )


def delivery_records(spark, sf_dir):
    k = F.col("p_partkey")
    part = F.concat(F.lit("P-"), k.cast("string"))
    parts = read(spark, sf_dir, "part")
    rows = parts.select(k.alias("row_number"), part.alias("Mfg_Part_Num"), F.when(k % 8 == 0, "-- none --").otherwise(F.col("p_name")).alias("Part_Desc"), F.when(k % 6 != 0, F.col("p_brand")).alias("E1_Brand"))
    shifted = F.when(k % 41 == 0, F.concat(part, F.lit("x"))).otherwise(part)
    normal = parts.where("p_partkey % 5 <> 0").select(k.alias("row_number"), shifted.alias("part"), F.when(k % 3 != 0, F.upper("p_brand")).alias("manufacturer"), F.col("p_brand").alias("brand"))
    normal = normal.unionByName(normal.where("row_number % 43 = 0"))
    fields = F.create_map(F.lit("Classpath"), F.col("p_type"), F.lit("Unknown"), F.lit("x"), F.lit("BRAND_NAME"), F.when(k % 10 == 1, "Own"))
    classes = parts.where("p_partkey % 7 <> 0").select(k.alias("row_number"), F.when(k % 47 == 0, "P-0").otherwise(part).alias("part"), fields.alias("fields"))
    return D.delivery_records(rows, HEADERS, normal, classes, _facts(spark, sf_dir))


def delivery_provenance(spark, sf_dir):
    return D.provenance(_facts(spark, sf_dir), "part", 3)


QUERIES = {f.__name__: f for f in (delivery_records, delivery_provenance)}

_FACTS = """
    grouped AS (
        SELECT l_partkey AS p, l_suppkey % 9 AS g, l_linenumber % 2 AS h, max(l_quantity)::INT::VARCHAR AS value FROM lineitem WHERE l_suppkey % 9 < 4 GROUP BY 1, 2, 3
    ), committed AS (
        SELECT 'P-' || p AS part, 'T' || g AS label, 'k-' || g || CASE WHEN p % 4 = 0 THEN '-' || h ELSE '' END AS source_key, g % 2 AS priority, value, CASE WHEN g <> 2 THEN 'mm' ELSE '' END AS uom FROM grouped WHERE h = 0 OR p % 4 = 0
    ), judged AS (
        SELECT part, CASE WHEN max(keys) > 1 THEN 'CONTESTED_TARGET' WHEN sum(n) > 3 THEN 'SLOT_CAPACITY' END AS problem FROM (SELECT part, label, count(*) AS n, count(DISTINCT source_key) AS keys FROM committed GROUP BY 1, 2) GROUP BY 1
    ), slots AS (
        SELECT part, row_number() OVER (PARTITION BY part ORDER BY priority, label, source_key) AS slot, label, value, uom, source_key FROM committed SEMI JOIN (SELECT part FROM judged WHERE problem IS NULL) USING (part)
    )
"""
_CELLS = ", ".join(f"max(CASE WHEN slot = {i} THEN {c} END) AS {c}{i}" for i in (1, 2, 3) for c in ("label", "value", "uom"))
_OUT = ", ".join(f"""CASE WHEN problem IS NULL THEN coalesce({c}{i}, '') END AS "ATTRIBUTE_{c.upper()} {i}" """ for i in (1, 2, 3) for c in ("label", "value", "uom"))
_WHEN = lambda c, name: f'CASE WHEN problem IS NULL THEN coalesce({c}, \'\') END AS "{name}"'
ORACLE_SQL = {
    "delivery_provenance": f"WITH {_FACTS} SELECT * FROM slots",
    "delivery_records": f"""
        WITH {_FACTS}, wide AS (SELECT part, count(*) AS n, {_CELLS} FROM slots GROUP BY 1), met AS (
            SELECT p_partkey AS k, p.*, w.*, CASE WHEN k % 43 = 0 AND k % 5 <> 0 THEN 'NORMALIZATION_GIVEN_TWICE' WHEN k % 41 = 0 AND k % 5 <> 0 THEN 'NORMALIZATION_OF_ANOTHER_ROW' WHEN k % 47 = 0 AND k % 7 <> 0 THEN 'CLASSIFICATION_OF_ANOTHER_ROW' ELSE j.problem END AS problem
            FROM part p LEFT JOIN judged j ON j.part = 'P-' || p_partkey LEFT JOIN wide w ON w.part = 'P-' || p_partkey
        )
        SELECT k AS row_number, problem, CASE WHEN problem IS NULL THEN coalesce(n, 0) ELSE 0 END AS attributes, {_WHEN("'P-' || k", "Mfg_Part_Num")}, {_WHEN("CASE WHEN k % 8 = 0 THEN '-- none --' ELSE p_name END", "Part_Desc")},
               {_WHEN("CASE WHEN k % 6 <> 0 THEN p_brand END", "E1_Brand")}, {_WHEN("CASE WHEN k % 5 <> 0 AND k % 3 <> 0 THEN upper(p_brand) END", "MANUFACTURER_NAME")},
               {_WHEN("coalesce(CASE WHEN k % 10 = 1 AND k % 7 <> 0 THEN 'Own' END, CASE WHEN k % 5 <> 0 THEN p_brand END)", "BRAND_NAME")}, {_WHEN("CASE WHEN k % 7 <> 0 THEN p_type END", "Classpath")}, {_WHEN("NULL::VARCHAR", "UNSPSC")}, {_OUT}
        FROM met
    """,
}
