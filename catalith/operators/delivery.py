"""A delivery record as a whole: what is carried over from the raw row, what each stage decided, and the verified attributes in their slots.

A record is refused, with a typed problem and no values, where a stage's result belongs to another row, is
given twice, or where its attributes can't be written whole. Nothing is overwritten and nothing is cut off.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.operators.records import assembly_summary

# Fields whose raw value, placeholders too, is carried over, and the fields of the resolved identity.
PASSTHROUGH = ("Mfg_Part_Num", "Part_Desc", "E1_Brand", "Unilog_Brand", "DIB_Brand", "Part_Manuf")
IDENTITY = {"MANUFACTURER_NAME": "manufacturer", "BRAND_NAME": "brand"}
_SLOT = re.compile(r"ATTRIBUTE_(LABEL|VALUE|UOM) ?(\d+)")


def capacity(headers: list[str]) -> int:
    return sum(bool((m := _SLOT.fullmatch(h)) and m[1] == "LABEL") for h in headers)


def written_attributes(facts: DataFrame, key: str, slots: int) -> DataFrame:
    """(key, problem, written): each record's committed facts in the order of priority, target and source key, or why they aren't written.

    facts: key, target, source_key, priority, decision, reason, verified, value, uom. written is an array of (label, value, uom, source_key), one a slot.
    """
    summary = assembly_summary(facts, [key], slots).select(key, "problem")
    entry = F.struct("priority", "target", "source_key", "value", "uom")
    rows = facts.where("decision = 'COMMIT'").groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("f"))
    slot = lambda x: F.struct(x["target"].alias("label"), x["value"].alias("value"), F.coalesce(x["uom"], F.lit("")).alias("uom"), x["source_key"].alias("source_key"))
    none = F.array().cast("array<struct<label:string,value:string,uom:string,source_key:string>>")
    out = summary.join(rows, key, "left")
    return out.select(key, "problem", F.when(F.col("problem").isNull(), F.coalesce(F.transform("f", slot), none)).otherwise(none).alias("written"))


def _once(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """One row a key; _<prefix>_n says how many there were."""
    kept = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(f"_{prefix}_n"), *[F.any_value(c).alias(f"_{prefix}_{c}") for c in kept])


def delivery_records(rows: DataFrame, headers: list[str], normalization: DataFrame, classification: DataFrame, facts: DataFrame) -> DataFrame:
    """(row_number, problem, attributes, and a column for each header in order): empty text where nothing is assigned.

    rows: row_number and the raw fields. normalization: row_number, part, manufacturer, brand. classification:
    row_number, part, fields (map of header to value). facts: those of written_attributes, by Mfg_Part_Num as part. part is
    the number that the stage saw; where it isn't the row's own, the result belongs to another row. problem: the first of
    NORMALIZATION_GIVEN_TWICE, NORMALIZATION_OF_ANOTHER_ROW, CLASSIFICATION_GIVEN_TWICE, CLASSIFICATION_OF_ANOTHER_ROW,
    CONTESTED_TARGET, SLOT_CAPACITY. A refused record has null in every header.
    """
    raw = [f for f in PASSTHROUGH if f in rows.columns]
    df = rows.select("row_number", *raw).join(_once(normalization, "row_number", "n"), "row_number", "left").join(_once(classification, "row_number", "c"), "row_number", "left")
    df = df.join(written_attributes(facts, "part", capacity(headers)).withColumnRenamed("part", "Mfg_Part_Num"), "Mfg_Part_Num", "left")
    other = lambda c: F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col("Mfg_Part_Num"))
    problem = (
        F.when(F.col("_n_n") > 1, "NORMALIZATION_GIVEN_TWICE").when(other("_n_part"), "NORMALIZATION_OF_ANOTHER_ROW")
        .when(F.col("_c_n") > 1, "CLASSIFICATION_GIVEN_TWICE").when(other("_c_part"), "CLASSIFICATION_OF_ANOTHER_ROW").otherwise(F.col("problem"))
    )
    df = df.withColumn("problem", problem)

    def cell(header: str) -> Column:
        if m := _SLOT.fullmatch(header):
            return F.get("written", F.lit(int(m[2]) - 1))[m[1].lower()]
        found = [F.try_element_at("_c_fields", F.lit(header))]
        if header in IDENTITY:
            found.append(F.col(f"_n_{IDENTITY[header]}"))
        if header in raw:
            found.append(F.col(header))
        return F.coalesce(*found)

    cells = [F.when(F.col("problem").isNull(), F.coalesce(cell(h), F.lit(""))).alias(h) for h in headers]
    n = F.when(F.col("problem").isNull(), F.coalesce(F.size("written"), F.lit(0))).otherwise(0).cast("long")
    return df.select("row_number", "problem", n.alias("attributes"), *cells)


def provenance(facts: DataFrame, key: str, slots: int) -> DataFrame:
    """(key, slot, label, value, uom, source_key): where each written attribute came from; for a reviewer."""
    written = written_attributes(facts, key, slots)
    return written.select(key, F.posexplode("written").alias("slot", "a")).select(key, (F.col("slot") + 1).cast("long").alias("slot"), "a.*")
