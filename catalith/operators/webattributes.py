"""Attributes that a model proposes for a product's web page: bound to stored addresses, then verified against what the page says there.

The page is held as tables (of catalith.sources.artifacts): text fragments, and JSON nodes
by pointer. Proposals meet them in equi-joins, and what lies beside a value (its property's
name, unit and id, and the other properties of its product) is summed before it is joined, so
every step is linear in proposals and nodes. Each proposal gets one typed outcome, the first that
holds; nothing is repaired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions import text as T
from catalith.functions.webvalues import web_value

APPROVED = "APPROVED_MANUFACTURER"
_MEMBERS = ("@type", "name", "value", "unitText", "unitCode", "propertyID")


def text_place(element, begin, end) -> Column:
    return F.concat_ws(":", F.lit("text"), *(T.col(c).cast("string") for c in (element, begin, end)))


def json_place(block, pointer) -> Column:
    return F.concat_ws(":", F.lit("json"), T.col(block).cast("string"), T.col(pointer))


def page_place(number) -> Column:
    return F.concat_ws(":", F.lit("page"), T.col(number).cast("string"))


def addresses(id_col: str, fragments: DataFrame | None = None, nodes: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """(id_col, place, stored): whatever a locator can name, from fragments, JSON nodes and document pages (id_col, page, text) alike."""
    parts = []
    if fragments is not None:
        parts.append(fragments.select(id_col, text_place("element", "begin", "end").alias("place"), F.col("text").alias("stored")))
    if nodes is not None:
        parts.append(nodes.select(id_col, json_place("block", "pointer").alias("place"), F.col("text").alias("stored")))
    if pages is not None:
        parts.append(pages.select(id_col, page_place("page").alias("place"), F.col("text").alias("stored")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def place_of(locator: str) -> Column:
    """The place that a locator (struct: kind, element, begin, end, block, pointer, page) names; null where its fields aren't those of its kind."""
    part = lambda c: F.col(f"{locator}.{c}")
    none = lambda *cs: sum((part(c).isNotNull().cast("int") for c in cs), F.lit(0)) == 0
    whole = lambda *cs: sum((part(c).isNull().cast("int") for c in cs), F.lit(0)) == 0
    return (
        F.when((part("kind") == "HTML_TEXT") & whole("element", "begin", "end") & none("block", "pointer", "page") & (part("begin") <= part("end")), text_place(part("element"), part("begin"), part("end")))
        .when((part("kind") == "HTML_JSONLD") & whole("block", "pointer") & none("element", "begin", "end", "page"), json_place(part("block"), part("pointer")))
        .when((part("kind") == "PDF_PAGE") & whole("page") & none("element", "begin", "end", "block", "pointer"), page_place(part("page")))
    )


def property_entries(nodes: DataFrame, id_col: str) -> DataFrame:
    """JSON objects with a member value, by pointer: (id_col, block, entry, in_list, type, name, property_id, units, value).

    type and name are null unless they are strings; units are unitText and unitCode where they are strings that aren't blank.
    """
    of = lambda member, *kinds: F.max(F.when((F.col("member") == member) & (F.col("kind").isin(*kinds) if kinds else F.lit(True)), F.col("text")))
    has = F.max(F.when(F.col("member") == "value", F.lit(1)))
    found = nodes.where(F.col("member").isin(*_MEMBERS) & (F.get("holders", F.lit(0)) == "object")).groupBy(id_col, "block", F.col("parent").alias("entry"))
    rows = found.agg(
        has.alias("has_value"), F.max(F.get("holders", F.lit(1)) == "array").alias("in_list"), of("@type", "string").alias("type"), of("name", "string").alias("name"),
        of("propertyID", "string", "number", "boolean").alias("property_id"), of("unitText", "string").alias("_text"), of("unitCode", "string").alias("_code"), of("value").alias("value"),
    )
    units = F.filter(F.array(T.strip("_text"), T.strip("_code")), lambda u: u.isNotNull() & (u != ""))
    return rows.where("has_value = 1").select(id_col, "block", "entry", "in_list", "type", "name", "property_id", units.alias("units"), "value")


def identity_refusal(decision, scope, covers, target, identity_sha256, sha256) -> Column:
    """Why a page may not speak for the target: IDENTITY_NOT_EXACT, ARTIFACT_MISMATCH, or null if it may."""
    same = F.coalesce(T.canonical_mpn(covers) == T.canonical_mpn(target), F.lit(False))
    exact = F.coalesce((T.col(decision) == "EXACT") & (T.col(scope) == "EXACT_SKU"), F.lit(False)) & same
    return F.when(~exact, "IDENTITY_NOT_EXACT").when(~F.coalesce(T.col(identity_sha256) == T.col(sha256), F.lit(False)), "ARTIFACT_MISMATCH")


def _pair(value: Column, unit: Column, whole: Column) -> Column:
    """Whether whole is value, white space and unit, and nothing else."""
    gap = F.substring(whole, F.length(value) + 1, F.length(whole) - F.length(value) - F.length(unit))
    return F.startswith(whole, value) & F.endswith(whole, unit) & (F.length(whole) > F.length(value) + F.length(unit)) & F.rlike(gap, F.lit(r"(?U)^\s+$"))


def bind_proposals(proposals: DataFrame, id_col: str, concepts: DataFrame, places: DataFrame, entries: DataFrame) -> DataFrame:
    """proposals with binding (BOUND or REJECTED), code, stored and value_key.

    proposals: id_col, source_key, raw_value, raw_uom, value_kind, excerpt, locator, target. concepts: source_key,
    concept_kind, variant_name (the property name by which a value must belong to the target's variant, or null).
    A page locator is bound by its page's being there; the others by the stored text, which the excerpt must equal
    and hold the value in. code of a bound one: UNKNOWN_UOM or CANDIDATE_REQUIRES_REVIEW.
    """
    counts = proposals.groupBy(id_col, "source_key").agg(F.count(F.lit(1)).alias("_n"))
    df = proposals.join(counts, [id_col, "source_key"]).join(concepts, "source_key", "left").withColumn("_place", place_of("locator"))
    df = df.join(places.withColumnRenamed("place", "_place").withColumn("_there", F.lit(True)), [id_col, "_place"], "left")
    variant = entries.select(id_col, F.col("block").alias("_block"), F.concat("entry", F.lit("/value")).alias("_pointer"), F.lower("name").alias("_name"), T.canonical_mpn("property_id").alias("_property"))
    df = df.withColumns({"_block": F.col("locator.block"), "_pointer": F.col("locator.pointer")}).join(variant, [id_col, "_block", "_pointer"], "left")
    value, unit, kind = F.col("raw_value"), F.coalesce("raw_uom", F.lit("")), F.col("locator.kind")
    stored, no = F.coalesce("stored", F.lit("")), F.lit(False)
    holds = F.when((kind == "HTML_JSONLD") & (unit == ""), value == stored).otherwise(stored.contains(value) & ((unit == "") | F.rlike(stored, F.concat(F.lit(r"(?U)\Q"), value, F.lit(r"\E\s+\Q"), unit, F.lit(r"\E")))))
    own = F.coalesce((F.col("_name") == F.lower("variant_name")) & (F.col("_property") == T.canonical_mpn("target")), no)
    parsed = web_value("value_kind", "raw_value", "raw_uom")
    code = (
        F.when(F.col("_n") > 1, "DUPLICATE_SOURCE_KEY")
        .when(F.col("concept_kind").isNull(), "UNKNOWN_SOURCE_KEY")
        .when(~F.coalesce(F.col("value_kind") == F.col("concept_kind"), no), "VALUE_KIND_MISMATCH")
        .when(kind.isNull(), "MISSING_LOCATOR")
        .when((kind == "PDF_PAGE") & (F.coalesce("excerpt", F.lit("")) == ""), "MISSING_SOURCE_FRAGMENT")
        .when((kind == "PDF_PAGE") & F.col("_there").isNull(), "PAGE_OUT_OF_RANGE")
        .when(F.col("_there").isNull(), "LOCATOR_INVALID")
        .when((kind != "PDF_PAGE") & ~F.coalesce((F.col("excerpt") == F.col("stored")) & holds, no), "SOURCE_MISMATCH")
        .when(F.col("variant_name").isNotNull() & ~own, "SOURCE_MISMATCH")
        .when(parsed["key"].isNull(), "INVALID_VALUE")
    )
    accepted = F.when(parsed["resolution"] == "UNRESOLVED", "UNKNOWN_UOM").otherwise("CANDIDATE_REQUIRES_REVIEW")
    out = df.withColumn("_code", code)
    return out.select(*proposals.columns, F.when(F.col("_code").isNull(), "BOUND").otherwise("REJECTED").alias("binding"), F.coalesce("_code", accepted).alias("code"), "stored", F.when(F.col("_code").isNull(), parsed["key"]).alias("value_key"))


def rejection_counts(bound: DataFrame, by: list[str]) -> DataFrame:
    """(by, code, n): how proposals ended."""
    return bound.groupBy(*by, "code").agg(F.count(F.lit(1)).alias("n"))


def _contradictions(entries: DataFrame, roots: DataFrame, rules: DataFrame, pages: DataFrame, id_col: str) -> DataFrame:
    """(id_col, block, root, source_key) of products that state one attribute in more than one way, in one aggregate over their properties."""
    listed = entries.where("in_list").withColumn("root", F.regexp_extract("entry", r"^(.*)/additionalProperty/\d+$", 1)).where(F.rlike("entry", F.lit(r"/additionalProperty/\d+$")))
    aliases = rules.select("source_key", "own_id", F.explode("property_names").alias("name"))
    met = listed.join(roots, [id_col, "block", "root"]).join(aliases, "name").join(pages.select(id_col, "target"), id_col)
    met = met.where(~F.col("own_id") | F.coalesce(T.canonical_mpn("property_id") == T.canonical_mpn("target"), F.lit(False)))
    said = F.struct(F.coalesce("value", F.lit("")).alias("value"), F.col("units"))
    return met.groupBy(id_col, "block", "root", "source_key").agg((F.min(said) != F.max(said)).alias("contradicts")).where("contradicts")


def verify_web_attributes(bound: DataFrame, id_col: str, rules: DataFrame, pages: DataFrame, nodes: DataFrame, entries: DataFrame, fragments: DataFrame) -> DataFrame:
    """bound proposals with status (VERIFIED, REVIEW, UNVERIFIED), reason, source_label, source_value and source_uom.

    bound: id_col, source_key, raw_value, raw_uom, value_kind, excerpt, locator. rules: source_key, rule_kind,
    property_names (array), own_id (the property's id must be the target), text_labels (array). pages: a row for each
    id with decision, scope, covers_mpn, target, identity_sha256, sha256, authority.
    """
    no, none = F.lit(False), F.lit("")
    roots = nodes.where("is_primary").select(id_col, "block", F.col("pointer").alias("root"))
    parsed_blocks = nodes.where("pointer = ''").select(id_col, "block", F.lit(True).alias("_parsed"))
    pointer, form = F.col("locator.pointer"), r"^(.*)/additionalProperty/\d+/value$"
    df = bound.join(pages, id_col, "left").join(rules, "source_key", "left")
    df = df.withColumns({
        "block": F.col("locator.block"), "_form": F.rlike(pointer, F.lit(form)), "root": F.regexp_extract(pointer, form, 1), "entry": F.regexp_replace(pointer, "/value$", ""),
        "element": F.col("locator.element"), "begin": F.col("locator.begin"), "end": F.col("locator.end"),
    })
    df = df.join(parsed_blocks, [id_col, "block"], "left").join(roots.withColumn("_root", F.lit(True)), [id_col, "block", "root"], "left")
    df = df.join(entries, [id_col, "block", "entry"], "left")
    df = df.join(_contradictions(entries, roots, rules, pages, id_col), [id_col, "block", "root", "source_key"], "left")
    df = df.join(fragments.select(id_col, "element", "begin", "end", F.col("text").alias("_text")), [id_col, "element", "begin", "end"], "left")
    claimed, unit, units = F.col("raw_value"), F.coalesce("raw_uom", none), F.coalesce("units", F.array().cast("array<string>"))
    kind, mine = F.col("locator.kind"), web_value("value_kind", "raw_value", "raw_uom")["key"]

    stated = F.coalesce(F.get(units, F.lit(0)), none)
    whole = F.coalesce("value", none)
    split = (unit != "") & (stated == "")
    meant = F.when(split, claimed).otherwise(whole)
    meant_unit = F.when(split, unit).otherwise(stated)
    json_reason = (
        F.when(F.col("_parsed").isNull(), "LOCATOR_INVALID")
        .when(~F.coalesce(F.col("_form"), no) | F.col("_root").isNull(), "OUTSIDE_TARGET_PRODUCT")
        .when(~F.coalesce("in_list", no), "LOCATOR_INVALID")
        .when(~F.coalesce(F.col("type") == "PropertyValue", no) | F.col("name").isNull(), "MALFORMED_STRUCTURED_PROPERTY")
        .when(~F.coalesce(F.col("value") == F.col("excerpt"), no), "LOCATOR_INVALID")
        .when(F.size(F.array_distinct(units)) > 1, "MALFORMED_STRUCTURED_PROPERTY")
        .when(~F.array_contains("property_names", F.col("name")), "SOURCE_PROPERTY_NOT_AUTHORIZED")
        .when(F.col("own_id") & ~F.coalesce(T.canonical_mpn("property_id") == T.canonical_mpn("target"), no), "PROPERTY_ID_MISMATCH")
        .when(F.coalesce("contradicts", no), "CONFLICTING_PROPERTY_VALUES")
        .when((stated != "") & (unit != stated), "UOM_NOT_SUPPORTED")
        .when(split & ~_pair(claimed, unit, whole), "UOM_NOT_SUPPORTED")
        .when(~F.coalesce(web_value("value_kind", meant, meant_unit)["key"] == mine, no), "VALUE_NOT_SUPPORTED")
        .otherwise("FACT_VERIFIED")
    )
    labels = F.coalesce("text_labels", F.array().cast("array<string>"))
    colon = lambda label: F.concat(label, F.lit(":"))
    text = F.coalesce("_text", none)
    times = F.aggregate(labels, F.lit(0), lambda n, label: n + ((F.length(text) - F.length(F.replace(text, colon(label), none))) / F.length(colon(label))).cast("int"))
    begins = F.filter(labels, lambda label: F.startswith(text, colon(label)))
    label = F.get(begins, F.lit(0))
    rest = T.strip(F.substring(text, F.length(label) + 2, F.length(text)))
    text_meant = F.when(unit != "", claimed).otherwise(rest)
    text_reason = (
        F.when(~F.coalesce(F.col("_text") == F.col("excerpt"), no), "LOCATOR_INVALID")
        .when((times > 1) | (F.size(begins) > 1), "AMBIGUOUS_TEXT_FRAGMENT")
        .when(F.size(begins) != 1, "EXPECTED_LABEL_MISSING")
        .when((unit != "") & ~_pair(claimed, unit, rest), "UOM_NOT_SUPPORTED")
        .when(~F.coalesce(web_value("value_kind", text_meant, unit)["key"] == mine, no), "VALUE_NOT_SUPPORTED")
        .otherwise("FACT_VERIFIED")
    )
    refusal = identity_refusal("decision", "scope", "covers_mpn", "target", "identity_sha256", "sha256")
    reason = (
        F.when(refusal.isNotNull(), refusal)
        .when(~F.coalesce(F.col("authority") == APPROVED, no), "MANUFACTURER_AUTHORITY_REQUIRED")
        .when(F.col("rule_kind").isNull(), "UNKNOWN_SOURCE_KEY")
        .when(~F.coalesce(F.col("value_kind") == F.col("rule_kind"), no) | claimed.isNull(), "VALUE_NOT_SUPPORTED")
        .when(kind == "HTML_JSONLD", json_reason)
        .when(kind == "HTML_TEXT", text_reason)
        .otherwise("UNSUPPORTED_EVIDENCE_KIND")
    )
    out = df.withColumn("reason", reason)
    r = F.col("reason")
    status = F.when(r == "FACT_VERIFIED", "VERIFIED").when(r == "CONFLICTING_PROPERTY_VALUES", "REVIEW").otherwise("UNVERIFIED")
    seen = F.coalesce(F.col("value_kind") == F.col("rule_kind"), no) & r.isin("FACT_VERIFIED", "CONFLICTING_PROPERTY_VALUES", "UOM_NOT_SUPPORTED", "VALUE_NOT_SUPPORTED", "PROPERTY_ID_MISMATCH", "SOURCE_PROPERTY_NOT_AUTHORIZED")
    source = lambda from_json, from_text: F.when(seen & (kind == "HTML_JSONLD"), from_json).when(seen & (kind == "HTML_TEXT"), from_text)
    return out.select(
        *bound.columns, status.alias("status"), "reason", source(F.col("name"), label).alias("source_label"),
        source(F.when(r == "FACT_VERIFIED", meant).otherwise(whole), F.when(r == "FACT_VERIFIED", text_meant).otherwise(rest)).alias("source_value"),
        source(F.when(r == "FACT_VERIFIED", meant_unit).otherwise(stated), F.when(r == "FACT_VERIFIED", unit).otherwise(none)).alias("source_uom"),
    )
