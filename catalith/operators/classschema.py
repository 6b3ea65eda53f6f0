"""What may be asked of a model about a class of products, as typed schemas with a fingerprint.

A class's features, their units and their allowed values are joined with the reviewed rules into one
row a feature; the nested documents of a class are put together from its features' JSON in
the order of position and id, so the same input gives the same bytes under any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions import values as V

# The version that is part of every fingerprint, and the kinds of feature types.
SCHEMA_VERSION = "etim-extraction@v1"
VALUE_KINDS = {"N": "numeric", "R": "range", "A": "alphanumeric", "L": "logical"}
CONDITION_ITEM = '{"properties":{"kind":{"type":"string"},"raw":{"type":"string"},"value":{"type":"string"}},"propertyOrdering":["kind","value","raw"],"required":["kind","value"],"type":"object"}'


def _quoted(c: Column) -> Column:
    """A JSON string; null of null."""
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("q"))), r'(?s)^\{"q":(.*)\}$', 1))


def _object(members: dict[str, Column]) -> Column:
    """A JSON object of members given as JSON, in the order of their names; those that are null are left out."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(members.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _quoted_list(items: Column) -> Column:
    return F.to_json(F.coalesce(items, F.array().cast("array<string>")))


def first_rules(rules: DataFrame) -> DataFrame:
    """One rule for each class and feature: the first by its own fields, of several under one id. A feature that two rules met would be two features of its class."""
    named = ["buyer_critical", "required", F.array_sort(F.map_entries("expected")).alias("expected"), "rationale"]
    kept = rules.groupBy("class_id", "feature_id").agg(F.min(F.struct(*named)).alias("r")).select("class_id", "feature_id", "r.*")
    return kept.withColumn("expected", F.map_from_entries("expected"))


def schema_features(features: DataFrame, allowed: DataFrame, rules: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """A row for each feature of each class with all that a schema says of it.

    features: class_id, feature_id, name, type (N, R, A, L), unit, position. allowed: class_id, feature_id, value_id,
    text, position. rules: class_id, feature_id, buyer_critical, required, expected, rationale (of load_class_rules).
    only: (class_id, feature_id), to ask for some; ids that aren't on the class are left out. A unit that isn't known is
    asked for as it is; a known one with all that it can be converted from.
    """
    if only is not None:
        features = features.join(only.select("class_id", "feature_id").distinct(), ["class_id", "feature_id"], "left_semi")
    spark = features.sparkSession
    symbols = V.units(spark).select("dimension", F.col("symbol").alias("unit")).join(V.compatible_units(spark), "dimension").select("unit", "symbols")
    picks = allowed.groupBy("class_id", "feature_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "value_id", "text"))), lambda x: F.struct(x["value_id"].alias("value_id"), x["text"].alias("text"))).alias("allowed_values"))
    df = features.join(picks, ["class_id", "feature_id"], "left").join(symbols, "unit", "left")
    if rules is not None:
        df = df.join(rules.select("class_id", "feature_id", "buyer_critical", "required", "expected", "rationale"), ["class_id", "feature_id"], "left")
    else:
        df = df.withColumns({"buyer_critical": F.lit(False), "required": F.array().cast("array<string>"), "expected": F.create_map().cast("map<string,string>"), "rationale": F.lit(None).cast("string")})
    accepted = F.coalesce("symbols", F.when(F.col("unit").isNotNull(), F.array("unit")), F.array().cast("array<string>"))
    kinds = F.create_map(*[F.lit(x) for kv in VALUE_KINDS.items() for x in kv])
    return df.select(
        "class_id", "feature_id", "name", "type", F.try_element_at(kinds, "type").alias("value_kind"), "unit", "position", accepted.alias("accepted_units"),
        F.coalesce("allowed_values", F.array().cast("array<struct<value_id:string,text:string>>")).alias("allowed_values"), F.coalesce("required", F.array().cast("array<string>")).alias("required"),
        F.array_sort(F.map_entries(F.coalesce("expected", F.create_map().cast("map<string,string>")))).alias("expected"), F.coalesce("buyer_critical", F.lit(False)).alias("buyer_critical"), "rationale",
    )


def instruction() -> Column:
    """One line on a feature: its name, its unit, and the qualifiers that it is defined at or needs."""
    fixed = F.array_join(F.transform("expected", lambda e: F.concat_ws("=", e["key"], e["value"])), ", ")
    need = F.array_join("required", ", ")
    parts = [F.col("name"), F.when(F.col("unit").isNotNull(), F.concat(F.lit("reported in "), F.col("unit"))), F.when(F.size("expected") > 0, F.concat(F.lit("defined at "), fixed)).when(F.size("required") > 0, F.concat(F.lit("record the qualifiers "), need))]
    return F.concat(F.concat_ws("; ", *parts), F.lit("."))


def feature_metadata() -> Column:
    """What a feature means, as canonical JSON."""
    text = lambda c: F.coalesce(_quoted(F.col(c)), F.lit("null"))
    pairs = lambda c, *names: _list(F.transform(c, lambda x: F.to_json(F.struct(*[x[old].alias(new) for new, old in names]))))
    return _object({
        "etim_feature_id": text("feature_id"), "name": text("name"), "etim_feature_type": text("type"), "value_kind": text("value_kind"), "unit": text("unit"), "accepted_units": _quoted_list(F.col("accepted_units")),
        "allowed_values": pairs("allowed_values", ("text", "text"), ("value_id", "value_id")), "required_condition_kinds": _quoted_list(F.col("required")), "expected_conditions": pairs("expected", ("kind", "key"), ("value", "value")),
        "buyer_critical": F.col("buyer_critical").cast("string"),
    })


def feature_schema() -> Column:
    """What a model may answer for a feature, as canonical JSON Schema: fields by type, units and picks as lists, and where it was read."""
    kind = F.col("value_kind")
    plain = lambda t: F.lit(f'{{"type":"{t}"}}')
    picks = F.transform("allowed_values", lambda v: v["text"])
    text = F.when(F.size(picks) > 0, F.concat(F.lit('{"enum":'), F.to_json(picks), F.lit(',"type":"string"}'))).otherwise(plain("string"))
    own = F.when(kind == "numeric", F.array(F.lit("number"))).when(kind == "range", F.array(F.lit("minimum"), F.lit("maximum"))).when(kind == "alphanumeric", F.array(F.lit("text"))).otherwise(F.array(F.lit("boolean")))
    has_unit = F.size("accepted_units") > 0
    required = F.concat(own, F.when(has_unit, F.array(F.lit("unit"))).otherwise(F.array().cast("array<string>")), F.array(F.lit("raw_text"), F.lit("page")))
    properties = _object({
        "number": F.when(kind == "numeric", plain("number")), "minimum": F.when(kind == "range", plain("number")), "maximum": F.when(kind == "range", plain("number")), "text": F.when(kind == "alphanumeric", text), "boolean": F.when(kind == "logical", plain("boolean")),
        "unit": F.when(has_unit, F.concat(F.lit('{"enum":'), F.to_json("accepted_units"), F.lit(',"type":"string"}'))), "raw_text": plain("string"), "page": plain("integer"), "conditions": F.lit(f'{{"items":{CONDITION_ITEM},"type":"array"}}'),
    })
    return _object({
        "type": F.lit('"object"'), "nullable": F.lit("true"), "description": _quoted(instruction()), "properties": properties, "required": F.to_json(required), "propertyOrdering": F.to_json(F.concat(required, F.array(F.lit("conditions")))),
    })


def class_schemas(features: DataFrame, classes: DataFrame, release: str = "10.0", language: str = "EN") -> DataFrame:
    """(class_id, n_features, metadata, json_schema, fingerprint) of each class that has features.

    features: rows of schema_features. classes: class_id, class_name. The fingerprint is the SHA-256 of both documents.
    """
    each = features.select("class_id", "feature_id", "position", feature_metadata().alias("meta"), feature_schema().alias("shape"))
    held = each.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("position", "feature_id", "meta", "shape"))).alias("f"))
    df = held.join(classes.select("class_id", "class_name"), "class_id", "left")
    class_id = _quoted(F.col("class_id"))
    by_id = F.array_sort(F.transform("f", lambda x: F.struct(x["feature_id"].alias("feature_id"), x["shape"].alias("shape"))))
    properties = F.concat(F.lit("{"), F.array_join(F.transform(by_id, lambda x: F.concat(_quoted(x["feature_id"]), F.lit(":"), x["shape"])), ","), F.lit("}"))
    asked = _object({"type": F.lit('"object"'), "properties": properties, "propertyOrdering": F.to_json(F.transform("f", lambda x: x["feature_id"]))})
    schema = _object({
        "type": F.lit('"object"'), "required": F.lit('["etim_class_id","features"]'), "propertyOrdering": F.lit('["etim_class_id","features"]'),
        "properties": _object({"etim_class_id": F.concat(F.lit('{"enum":['), class_id, F.lit('],"type":"string"}')), "features": asked}),
    })
    metadata = _object({
        "etim_class_id": class_id, "etim_class_name": F.coalesce(_quoted(F.col("class_name")), F.lit("null")), "etim_release": F.lit(f'"{release}"'), "etim_language": F.lit(f'"{language}"'), "schema_version": F.lit(f'"{SCHEMA_VERSION}"'),
        "features": _list(F.transform("f", lambda x: x["meta"])),
    })
    out = df.select("class_id", F.size("f").alias("n_features"), metadata.alias("metadata"), schema.alias("json_schema"))
    return out.withColumn("fingerprint", F.sha2(F.concat(F.lit('{"json_schema":'), "json_schema", F.lit(',"metadata":'), "metadata", F.lit("}")), 256))


def expected_conditions(features: DataFrame) -> DataFrame:
    """(class_id, feature_id, kind, value): the operating points that features fix of themselves."""
    return features.select("class_id", "feature_id", F.explode("expected").alias("e")).select("class_id", "feature_id", F.col("e.key").alias("kind"), F.col("e.value").alias("value"))
