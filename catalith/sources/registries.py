"""Small dimensions from files: registries in TOML, case sets in JSON, and a taxonomy of delimited tables in a ZIP."""

from __future__ import annotations

import io
import tomllib
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAPPING = "source_key string, target string, priority int, expected_kind string, policy string, required map<string,string>, target_unit string, authority string"
#: Tables of a taxonomy archive and the columns read of each.
TAXONOMY = {
    "group": ("GROUPID", "GROUPDESC"),
    "class": ("CLASSID", "GROUPID", "CLASSDESC"),
    "synonym": ("CLASSID", "SYNONYM"),
    "feature": ("FEATUREID", "FEATUREDESC", "FEATURETYPE"),
    "unit": ("UNITID", "UNITABBREV"),
    "value": ("VALUEID", "VALUEDESC"),
    "classfeature": ("MAPID", "CLASSID", "FEATUREID", "UNITID", "SORTNR"),
    "classfeaturevalue": ("MAPID", "VALUEID", "SORTNR"),
}


class RegistryError(ValueError):
    pass


def _bytes(spark: SparkSession, path: str) -> bytes:
    """A small file from any store."""
    rows = spark.read.format("binaryFile").load(path).select("content").take(1)
    if not rows:
        raise RegistryError(f"{path} is missing")
    return bytes(rows[0].content)


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Mapping rules [[rule]]; a source key given twice or a missing authority stops it."""
    data = tomllib.loads(_bytes(spark, path).decode())
    if not data.get("authority"):
        raise RegistryError("authority is missing")
    rules = data.get("rule", [])
    keys = [r["source_key"] for r in rules]
    if len(set(keys)) < len(keys):
        raise RegistryError("a source key is given twice")
    rows = [(r["source_key"], r["target"], r.get("priority", 100), r.get("expected_kind"), r.get("policy", "NONE"), r.get("required"), r.get("target_unit"), data["authority"]) for r in rules]
    return spark.createDataFrame(rows, MAPPING)


def load_domains(spark: SparkSession, path: str) -> DataFrame:
    """(domain, role, owner, licensed) from [[manufacturer]] entries and host lists; a hint may not both grant and locate."""
    data = tomllib.loads(_bytes(spark, path).decode())
    rows = []
    for entry in data.get("manufacturer", []):
        both = set(map(str.lower, entry.get("authority_hints", []))) & set(map(str.lower, entry.get("locator_hints", [])))
        if both:
            raise RegistryError(f"{entry['key']}: hint in both lists: {', '.join(sorted(both))}")
        rows += [(d.lower(), "MANUFACTURER", entry["key"], bool(entry.get("review"))) for d in entry.get("domains", [])]
    for role in ("marketplace", "distributor", "blocked"):
        rows += [(d.lower(), role.upper(), None, False) for d in data.get(role, [])]
    return spark.createDataFrame(rows, "domain string, role string, owner string, licensed boolean")


def load_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cases of a JSON case set {"cases": [...]}, a row each."""
    return spark.read.schema(f"cases array<struct<{schema}>>").json(path, multiLine=True).select(F.inline("cases"))


def load_taxonomy(spark: SparkSession, path: str, encoding: str = "utf-16") -> dict[str, DataFrame]:
    """The tables of a taxonomy ZIP (`;` between fields), and `issues`: ids that point nowhere.

    The archive is a small dictionary (a few hundred thousand rows at most) and is one file, so one
    task unpacks each table of it.
    """
    archive = spark.read.format("binaryFile").load(path).select("content")

    def table(name: str, columns: tuple[str, ...]) -> DataFrame:
        def rows(frames):
            import csv

            import pandas as pd

            for pdf in frames:
                for content in pdf["content"]:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        text = z.read(f"{name}.csv").decode(encoding).removeprefix("﻿")
                    yield pd.DataFrame([[r.get(c) or None for c in columns] for r in csv.DictReader(io.StringIO(text), delimiter=";")], columns=list(columns))

        return archive.mapInPandas(rows, ", ".join(f"{c} string" for c in columns))

    return taxonomy({name: table(name, columns) for name, columns in TAXONOMY.items()})


def taxonomy(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables, `issues` (ids that point nowhere), `class_features` in their order and `allowed_values`; what dangles is in no other."""
    out = dict(tables)
    dangling = lambda a, b, key: out[a].where(F.col(key).isNotNull()).join(out[b].select(key), key, "left_anti").select(F.lit(a).alias("table"), F.lit(b).alias("missing_in"), F.col(key).alias("id")).distinct()
    links = (("class", "group", "GROUPID"), ("synonym", "class", "CLASSID"), ("classfeature", "class", "CLASSID"), ("classfeature", "feature", "FEATUREID"), ("classfeature", "unit", "UNITID"), ("classfeaturevalue", "value", "VALUEID"), ("classfeaturevalue", "classfeature", "MAPID"))
    issues = dangling(*links[0])
    for link in links[1:]:
        issues = issues.union(dangling(*link))
    out["issues"] = issues
    out["class_features"] = (
        out["classfeature"].join(out["feature"], "FEATUREID").join(out["unit"], "UNITID", "left")
        .select("CLASSID", "FEATUREID", "FEATUREDESC", "FEATURETYPE", "UNITABBREV", F.col("SORTNR").cast("int").alias("position"), "MAPID")
    )
    out["allowed_values"] = out["classfeaturevalue"].join(out["value"], "VALUEID").join(out["class_features"].select("MAPID", "CLASSID", "FEATUREID"), "MAPID").select("CLASSID", "FEATUREID", "VALUEID", "VALUEDESC", F.col("SORTNR").cast("int").alias("position"))
    return out


def validate_values(claims: DataFrame, taxonomy: dict[str, DataFrame]) -> DataFrame:
    """claims (CLASSID, FEATUREID, value, unit) with issue: null, UNKNOWN_FEATURE, NOT_A_NUMBER, NOT_FINITE, UNIT_MISSING, UNIT_UNEXPECTED, NOT_A_BOOLEAN, NOT_IN_PICKLIST."""
    features, allowed = taxonomy["class_features"], taxonomy["allowed_values"]
    df = claims.join(features.select("CLASSID", "FEATUREID", "FEATURETYPE", "UNITABBREV"), ["CLASSID", "FEATUREID"], "left")
    picks = allowed.groupBy("CLASSID", "FEATUREID").agg(F.collect_set(F.lower("VALUEDESC")).alias("picks"))
    df = df.join(picks, ["CLASSID", "FEATUREID"], "left")
    number, kind = F.col("value").try_cast("double"), F.col("FEATURETYPE")
    issue = (
        F.when(kind.isNull(), "UNKNOWN_FEATURE")
        .when((kind == "N") & number.isNull(), "NOT_A_NUMBER")
        .when((kind == "N") & (F.isnan(number) | (F.abs(number) == float("inf"))), "NOT_FINITE")
        .when((kind == "N") & F.col("UNITABBREV").isNotNull() & F.col("unit").isNull(), "UNIT_MISSING")
        .when(F.col("unit").isNotNull() & ~F.coalesce(F.col("unit") == F.col("UNITABBREV"), F.lit(False)), "UNIT_UNEXPECTED")
        .when((kind == "L") & ~F.lower("value").isin("true", "false"), "NOT_A_BOOLEAN")
        .when((kind == "A") & F.col("picks").isNotNull() & ~F.array_contains("picks", F.lower("value")), "NOT_IN_PICKLIST")
    )
    return df.withColumn("issue", issue).drop("FEATURETYPE", "UNITABBREV", "picks")
