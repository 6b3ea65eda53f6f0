"""Queries that write a table as files and read them again as a user would, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.functions import values as V
from catalith.operators.catalogue import FIELDS
from catalith.plans.catalog import VIEW, catalogue, read
from catalith.session import scratch_folder
from catalith.sources import catalogue as S
from catalith.sources import stores
from catalith.streaming import catalogue as stream

HEADERS = ["Mfg_Part_Num", "Part_Desc", *[f"ATTRIBUTE_{k} {i}" for i in (1, 2) for k in ("LABEL", "VALUE", "UOM")], "UPC"]


def _odd(c):
    """Descriptions with quotes, separators and line ends in them."""
    n = F.col("row_number")
    return F.when(n % 5 == 0, F.concat(F.lit('a "quoted", '), c)).when(n % 5 == 1, F.concat(c, F.lit("\nsecond line"))).when(n % 5 == 2, F.concat(F.lit("x,"), c)).otherwise(c)


def catalogue_files(spark, sf_dir):
    """The catalogue through delimited files: columns by name, an extra one as a map, quoted line ends whole."""
    path = scratch_folder(spark, "catalogue")
    rows = catalogue(spark, sf_dir).withColumn("Part_Desc", _odd(F.col("Part_Desc")))
    rows.select(F.col("row_number").cast("string").alias("Row"), *reversed(FIELDS)).write.csv(path, header=True, quote='"', escape='"')
    out = S.read_catalogue(spark, path)
    return out.select(F.col("extra")["Row"].cast("long").alias("row_number"), *FIELDS, "malformed")


def delivery_files(spark, sf_dir):
    """Delivery rows with attributes in numbered slots, written and read back; empty text stays empty."""
    contract = S.DeliveryContract(HEADERS)
    base = catalogue(spark, sf_dir).select("row_number", "Mfg_Part_Num", _odd(F.col("Part_Desc")).alias("Part_Desc"))
    n = F.col("row_number")
    slots = F.array(*[F.when(n % (i + 2) == 0, F.struct(F.lit(i).alias("slot"), F.lit(f"L{i}").alias("label"), (n % 10).cast("string").alias("value"), F.when(n % 3 == 0, "mm").alias("uom"))) for i in (1, 2)])
    facts = base.select("row_number", F.inline(F.filter(slots, lambda x: x.isNotNull())))
    path = scratch_folder(spark, "delivery")
    S.write_delivery(contract.assemble(base, facts, "row_number").select("row_number", *HEADERS), path)
    back = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema=", ".join(f"`{c}` string" for c in ("row_number", *HEADERS)))
    return back.select(F.col("row_number").cast("long").alias("row_number"), *[F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(h) for h in HEADERS])


def delivery_contract(spark, sf_dir):
    """How the parts' own columns differ from a contract, and each contract's fingerprint and slots."""
    found = S.conformance(read(spark, sf_dir, "part").columns, ["p_partkey", "p_name", "p_size", "p_colour"])
    contract = S.DeliveryContract(HEADERS)
    n = read(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("rows"))
    return n.select("rows", F.lit(",".join(found["missing"])).alias("missing"), F.lit(",".join(found["extra"])).alias("extra"), F.lit(found["first_divergence"]).cast("long").alias("first_divergence"), F.lit(len(contract.slots)).cast("long").alias("slots"), F.lit(contract.fingerprint()).alias("fingerprint"))


def stored_texts(spark, sf_dir):
    """Texts put into a store by content, twice, and asked for again; one hash was never stored."""
    path = scratch_folder(spark, "store")
    docs = read(spark, sf_dir, "documents")
    for _ in range(2):
        stores.put_artifacts(docs.select("text"), path)
    wanted = docs.select(F.when(F.col("doc_id") % 100 == 0, F.lit("0" * 64)).otherwise(F.sha2("text", 256)).alias("sha"))
    return stores.load_artifacts(spark, path, wanted).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def streamed_decisions(spark, sf_dir):
    """The catalogue's decisions from a stream of files, read through once; the same as from a table."""
    folder, out, checkpoint = (scratch_folder(spark, x) for x in ("in", "out", "cp"))
    catalogue(spark, sf_dir).select(*FIELDS).repartition(3, "Mfg_Part_Num").write.csv(folder, header=True, quote='"', escape='"')
    stream.write_decisions(stream.read_stream(spark, folder), out, checkpoint, [("WIDGET", ("widget",)), ("FASTENER", ("bolt",))]).awaitTermination()
    rows = spark.read.parquet(out)
    return rows.groupBy("family", "class_decision", "class_reason").agg(F.count(F.lit(1)).alias("n"))


def unit_dimensions(spark, sf_dir):
    """Parts' sizes in each unit of the dimension that their unit has, in the table's order."""
    units = V.compatible_units(spark)
    asked = F.get(F.array(*map(F.lit, ("length", "voltage", "nothing"))), (F.col("p_partkey") % 3).cast("int"))
    rows = read(spark, sf_dir, "part").select("p_size", asked.alias("dimension")).join(units, "dimension", "left")
    return rows.groupBy("dimension", F.array_join("symbols", ",").alias("symbols")).agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("total"))


QUERIES = {f.__name__: f for f in (catalogue_files, delivery_files, delivery_contract, stored_texts, streamed_decisions, unit_dimensions)}

_DESC = "CASE row_number % 5 WHEN 0 THEN 'a \"quoted\", ' || descr WHEN 1 THEN descr || chr(10) || 'second line' WHEN 2 THEN 'x,' || descr ELSE descr END"
_SLOT = lambda i: ", ".join(f"""CASE WHEN row_number % {i + 2} = 0 THEN {v} ELSE '' END AS "ATTRIBUTE_{k} {i}" """ for k, v in (("LABEL", f"'L{i}'"), ("VALUE", "(row_number % 10)::VARCHAR"), ("UOM", "CASE WHEN row_number % 3 = 0 THEN 'mm' ELSE '' END")))
ORACLE_SQL = {
    "catalogue_files": f"""WITH {VIEW} SELECT row_number, mpn AS "Mfg_Part_Num", {_DESC} AS "Part_Desc", e1 AS "E1_Brand", uni AS "Unilog_Brand", dib AS "DIB_Brand", manuf AS "Part_Manuf", false AS malformed FROM cat""",
    "delivery_files": f"""WITH {VIEW} SELECT row_number, mpn AS "Mfg_Part_Num", {_DESC} AS "Part_Desc", {_SLOT(1)}, {_SLOT(2)}, '' AS "UPC" FROM cat""",
    "delivery_contract": f"SELECT count(*) AS rows, 'p_colour' AS missing, 'p_brand,p_type,p_retailprice' AS extra, 2::BIGINT AS first_divergence, 2::BIGINT AS slots, sha256('[{','.join(chr(34) + h + chr(34) for h in HEADERS)}]') AS fingerprint FROM part",
    "stored_texts": """
        WITH w AS (SELECT DISTINCT CASE WHEN doc_id % 100 = 0 THEN repeat('0', 64) ELSE sha256(text) END AS sha FROM documents WHERE text IS NOT NULL OR doc_id % 100 = 0), t AS (SELECT DISTINCT text, sha256(text) AS sha FROM documents WHERE text IS NOT NULL)
        SELECT CASE WHEN text IS NULL THEN 'MISSING' ELSE 'OK' END AS status, count(*) AS n, sum(length(text))::BIGINT AS chars FROM w LEFT JOIN t USING (sha) GROUP BY 1
    """,
    "streamed_decisions": f"""
        WITH {VIEW}, x AS (SELECT regexp_matches(' ' || array_to_string(regexp_extract_all(lower(descr), '[a-z0-9]+'), ' ') || ' ', ' widget ') AS w, regexp_matches(' ' || array_to_string(regexp_extract_all(lower(descr), '[a-z0-9]+'), ' ') || ' ', ' bolt ') AS b FROM cat)
        SELECT CASE WHEN w AND NOT b THEN 'WIDGET' WHEN b AND NOT w THEN 'FASTENER' ELSE 'UNKNOWN' END AS family, CASE WHEN w AND b THEN 'REVIEW' WHEN w OR b THEN 'COMMIT' ELSE 'WITHHOLD' END AS class_decision,
               CASE WHEN w AND b THEN 'OVERLAPPING_FAMILY_CUES' WHEN w OR b THEN 'STRONG_LEXICAL_CUE' ELSE 'NO_FAMILY_CUE' END AS class_reason, count(*) AS n FROM x GROUP BY ALL
    """,
    "unit_dimensions": """
        SELECT dimension, CASE dimension WHEN 'length' THEN 'mm,cm,m,in' WHEN 'voltage' THEN 'V,mV,kV' END AS symbols, count(*) AS n, sum(p_size)::BIGINT AS total FROM (SELECT p_size, ['length', 'voltage', 'nothing'][p_partkey % 3 + 1] AS dimension FROM part) GROUP BY ALL
    """,
}
