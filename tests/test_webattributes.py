import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from catalith.functions.webvalues import web_value
from catalith.operators import webattributes as W
from catalith.sources import artifacts as A

PROP = lambda name, value, **k: {"@type": "PropertyValue", "name": name, "value": value} | k
PRODUCT = {
    "@type": "Product", "mpn": "X 1",
    "additionalProperty": [
        PROP("Depth", "12 in"), PROP("Height", 3.5, unitText="in"), PROP("finish", "Black", propertyID="x1"), PROP("finish", "Gold", propertyID="X2"),
        PROP("Width", "4 in"), PROP("Width", "5 in"), {"@type": "Thing", "name": "Depth", "value": "12 in"}, PROP("Both", "1", unitText="in", unitCode="INH"), PROP("Attribute", "3-Light"), "loose", {"name": "Bare"},
    ],
}
PAGES = {
    "one": [PRODUCT], "two": [PRODUCT | {"additionalProperty": {"0": PROP("Depth", "12 in")}}], "bad": ['{"@type": NaN}', PRODUCT],
    "graph": [{"@graph": [{"@type": "WebPage"}, PRODUCT], "other": PRODUCT}], "family": [PRODUCT], "stale": [PRODUCT], "dealer": [PRODUCT],
}
TEXT = ("Socket: E26", "Depth: 12 in", "Depth: 1 Depth: 2", "no label")
LOCATOR = "struct<kind:string,element:int,begin:int,end:int,block:int,pointer:string,page:int>"
RULES = [("depth", "NUMBER", ["Depth"], False, ["Depth"]), ("height", "NUMBER", ["Height"], False, []), ("width", "NUMBER", ["Width"], False, []), ("finish", "ENUM", ["finish"], True, []), ("socket", "TEXT", [], False, ["Socket"]), ("both", "NUMBER", ["Both"], False, []), ("count", "TEXT", [], False, [])]


def html(blocks):
    scripts = "".join(f'<script type="application/ld+json">{b if isinstance(b, str) else json.dumps(b)}</script>' for b in blocks)
    return f"<html><head>{scripts}</head><body>" + "".join(f"<p>{t}</p>" for t in TEXT) + "<nav>Depth: 9 in</nav></body></html>"


@pytest.fixture(scope="module")
def stored(spark):
    pages = spark.createDataFrame([(k, html(v)) for k, v in PAGES.items()], "id string, html string")
    artifacts = A.read_artifacts(pages, "id")
    nodes, fragments = A.json_nodes(artifacts, "id"), A.text_fragments(artifacts, "id")
    return artifacts, nodes, fragments, W.property_entries(nodes, "id")


def ld(pointer, block=0):
    return ("HTML_JSONLD", None, None, None, block, pointer, None)


def prop(i):
    return ld(f"/additionalProperty/{i}/value")


def line(i, blocks=1):
    begin = sum(len(t) + 1 for t in TEXT[:i])
    return ("HTML_TEXT", 3 + blocks + i, begin, begin + len(TEXT[i]), None, None, None)


VERIFY = [
    ("one", "depth", "12", "in", "NUMBER", "12 in", prop(0), "FACT_VERIFIED"),
    ("graph", "depth", "12.0", "in", "NUMBER", "12 in", ld("/@graph/1/additionalProperty/0/value"), "UOM_NOT_SUPPORTED"),
    ("graph", "depth", "12", "in", "NUMBER", "12 in", ld("/@graph/1/additionalProperty/0/value"), "FACT_VERIFIED"),
    ("graph", "depth", "12", "in", "NUMBER", "12 in", ld("/other/additionalProperty/0/value"), "OUTSIDE_TARGET_PRODUCT"),
    ("one", "height", "3.50", "in", "NUMBER", "3.5", prop(1), "FACT_VERIFIED"),
    ("one", "height", "3.5", "", "NUMBER", "3.5", prop(1), "UOM_NOT_SUPPORTED"),
    ("one", "height", "3.5", "cm", "NUMBER", "3.5", prop(1), "UOM_NOT_SUPPORTED"),
    ("one", "height", "3.6", "in", "NUMBER", "3.5", prop(1), "VALUE_NOT_SUPPORTED"),
    ("one", "finish", "black", "", "ENUM", "Black", prop(2), "FACT_VERIFIED"),
    ("one", "finish", "Gold", "", "ENUM", "Gold", prop(3), "PROPERTY_ID_MISMATCH"),
    ("one", "width", "4", "in", "NUMBER", "4 in", prop(4), "CONFLICTING_PROPERTY_VALUES"),
    ("one", "depth", "12", "in", "NUMBER", "12 in", prop(6), "MALFORMED_STRUCTURED_PROPERTY"),
    ("one", "both", "1", "in", "NUMBER", "1", prop(7), "MALFORMED_STRUCTURED_PROPERTY"),
    ("one", "count", "3-Light", "", "TEXT", "3-Light", prop(8), "SOURCE_PROPERTY_NOT_AUTHORIZED"),
    ("one", "depth", "12", "in", "NUMBER", "loose", prop(9), "LOCATOR_INVALID"),
    ("one", "depth", "12", "in", "NUMBER", "x", prop(10), "LOCATOR_INVALID"),
    ("one", "depth", "12", "in", "NUMBER", "12 in", prop(99), "LOCATOR_INVALID"),
    ("one", "depth", "12", "in", "NUMBER", "13 in", prop(0), "LOCATOR_INVALID"),
    ("one", "depth", "12", "in", "NUMBER", "12 in", ld("/additionalProperty/00/value"), "LOCATOR_INVALID"),
    ("one", "depth", "12", "in", "NUMBER", "Depth", ld("/additionalProperty/0/name"), "OUTSIDE_TARGET_PRODUCT"),
    ("one", "depth", "12", "in", "NUMBER", "12 in", ld("/additionalProperty/0/value", 5), "LOCATOR_INVALID"),
    ("two", "depth", "12", "in", "NUMBER", "12 in", prop(0), "LOCATOR_INVALID"),
    ("bad", "depth", "12", "in", "NUMBER", "12 in", prop(0), "LOCATOR_INVALID"),
    ("bad", "depth", "12", "in", "NUMBER", "12 in", ld("/additionalProperty/0/value", 1), "FACT_VERIFIED"),
    ("one", "colour", "red", "", "TEXT", "red", prop(0), "UNKNOWN_SOURCE_KEY"),
    ("one", "depth", "12", "in", "TEXT", "12 in", prop(0), "VALUE_NOT_SUPPORTED"),
    ("one", "depth", "12", "in", "NUMBER", "12 in", ("PDF_PAGE", None, None, None, None, None, 1), "UNSUPPORTED_EVIDENCE_KIND"),
    ("one", "socket", "E26", "", "TEXT", TEXT[0], line(0), "FACT_VERIFIED"),
    ("one", "socket", "E27", "", "TEXT", TEXT[0], line(0), "VALUE_NOT_SUPPORTED"),
    ("one", "depth", "12", "in", "NUMBER", TEXT[1], line(1), "FACT_VERIFIED"),
    ("one", "depth", "12", "", "NUMBER", TEXT[1], line(1), "VALUE_NOT_SUPPORTED"),
    ("one", "depth", "1", "in", "NUMBER", TEXT[1], line(1), "UOM_NOT_SUPPORTED"),
    ("one", "depth", "1", "", "NUMBER", TEXT[2], line(2), "AMBIGUOUS_TEXT_FRAGMENT"),
    ("one", "depth", "1", "", "NUMBER", TEXT[3], line(3), "EXPECTED_LABEL_MISSING"),
    ("one", "depth", "12", "in", "NUMBER", "Depth: 13 in", line(1), "LOCATOR_INVALID"),
    ("one", "depth", "12", "in", "NUMBER", TEXT[1], ("HTML_TEXT", 1, 0, 5, None, None, None), "LOCATOR_INVALID"),
    ("family", "depth", "12", "in", "NUMBER", "12 in", prop(0), "IDENTITY_NOT_EXACT"),
    ("stale", "depth", "12", "in", "NUMBER", "12 in", prop(0), "ARTIFACT_MISMATCH"),
    ("dealer", "depth", "12", "in", "NUMBER", "12 in", prop(0), "MANUFACTURER_AUTHORITY_REQUIRED"),
]


def test_every_reason_of_verification(spark, stored):
    artifacts, nodes, fragments, entries = stored
    rows = [(i, *v[:6], v[6]) for i, v in enumerate(VERIFY)]
    bound = spark.createDataFrame(rows, f"n int, id string, source_key string, raw_value string, raw_uom string, value_kind string, excerpt string, locator {LOCATOR}")
    pages = artifacts.select("id", F.when(F.col("id") == "family", "REVIEW").otherwise("EXACT").alias("decision"), F.lit("EXACT_SKU").alias("scope"), F.lit("x1").alias("covers_mpn"), F.lit("X 1").alias("target"), F.when(F.col("id") == "stale", "0").otherwise(F.col("sha256")).alias("identity_sha256"), "sha256", F.when(F.col("id") == "dealer", "KNOWN_DISTRIBUTOR").otherwise(W.APPROVED).alias("authority"))
    rules = spark.createDataFrame(RULES, "source_key string, rule_kind string, property_names array<string>, own_id boolean, text_labels array<string>")
    out = {r.n: r for r in W.verify_web_attributes(bound, "id", rules, pages, nodes, entries, fragments).collect()}
    assert [(i, out[i].reason) for i in range(len(VERIFY))] == [(i, v[7]) for i, v in enumerate(VERIFY)]
    assert {r.status for r in out.values() if r.reason == "FACT_VERIFIED"} == {"VERIFIED"} and {r.status for r in out.values() if r.reason.startswith("CONFLICT")} == {"REVIEW"}
    assert (out[0].source_label, out[0].source_value, out[0].source_uom) == ("Depth", "12", "in") and (out[29].source_label, out[29].source_value, out[29].source_uom) == ("Depth", "12", "in")


BIND = [
    ("one", "depth", "12", "in", "NUMBER", "12 in", prop(0), "CANDIDATE_REQUIRES_REVIEW"),
    ("one", "height", "3.5", "", "NUMBER", "3.5", prop(1), "CANDIDATE_REQUIRES_REVIEW"),
    ("one", "finish", "Black", "", "ENUM", "Black", prop(2), "CANDIDATE_REQUIRES_REVIEW"),
    ("graph", "finish", "Gold", "", "ENUM", "Gold", ld("/@graph/1/additionalProperty/3/value"), "SOURCE_MISMATCH"),
    ("one", "socket", "E26", "", "TEXT", TEXT[0], line(0), "CANDIDATE_REQUIRES_REVIEW"),
    ("two", "socket", "E2", "6", "TEXT", TEXT[0], line(0), "SOURCE_MISMATCH"),
    ("bad", "depth", "12", "in", "NUMBER", TEXT[1], line(1, 2), "CANDIDATE_REQUIRES_REVIEW"),
    ("stale", "depth", "12", "in", "NUMBER", "Depth: 12", line(1), "SOURCE_MISMATCH"),
    ("graph", "depth", "12", "", "NUMBER", "12 in", ld("/@graph/1/additionalProperty/0/value"), "SOURCE_MISMATCH"),
    ("graph", "height", "3.5", "", "TEXT", "3.5", ld("/x"), "VALUE_KIND_MISMATCH"),
    ("graph", "width", "4", "in", "NUMBER", "4 in", None, "MISSING_LOCATOR"),
    ("graph", "both", "1", "", "NUMBER", "1", ld("/nowhere"), "LOCATOR_INVALID"),
    ("graph", "count", "3-Light", "", "TEXT", "3-Light", ("HTML_TEXT", 1, 9, 2, None, None, None), "LOCATOR_INVALID"),
    ("graph", "socket", "E26", "", "TEXT", "", ("PDF_PAGE", None, None, None, None, None, 1), "MISSING_SOURCE_FRAGMENT"),
    ("family", "socket", "E26", "", "TEXT", "E26", ("PDF_PAGE", None, None, None, None, None, 1), "CANDIDATE_REQUIRES_REVIEW"),
    ("family", "count", "E26", "", "TEXT", "E26", ("PDF_PAGE", None, None, None, None, None, 9), "PAGE_OUT_OF_RANGE"),
    ("family", "depth", "many", "", "NUMBER", "many", ("PDF_PAGE", None, None, None, None, None, 1), "INVALID_VALUE"),
    ("family", "height", "3", "furlong", "NUMBER", "3", ("PDF_PAGE", None, None, None, None, None, 1), "UNKNOWN_UOM"),
    ("dealer", "depth", "12", "in", "NUMBER", "12 in", prop(0), "DUPLICATE_SOURCE_KEY"),
    ("dealer", "depth", "12", "in", "NUMBER", "12 in", prop(0), "DUPLICATE_SOURCE_KEY"),
    ("dealer", "hue", "red", "", "TEXT", "red", prop(0), "UNKNOWN_SOURCE_KEY"),
]


def test_every_code_of_binding(spark, stored):
    _, nodes, fragments, entries = stored
    proposals = spark.createDataFrame([(i, *b[:7], "X1") for i, b in enumerate(BIND)], f"n int, id string, source_key string, raw_value string, raw_uom string, value_kind string, excerpt string, locator {LOCATOR}, target string")
    concepts = spark.createDataFrame([(k, kind, "finish" if own else None) for k, kind, _, own, _ in RULES], "source_key string, concept_kind string, variant_name string")
    documents = spark.createDataFrame([("family", 1, "A page"), ("graph", 1, "another")], "id string, page int, text string")
    bound = W.bind_proposals(proposals, "id", concepts, W.addresses("id", fragments, nodes, documents), entries)
    out = {r.n: r for r in bound.collect()}
    assert [(i, out[i].code) for i in range(len(BIND))] == [(i, b[7]) for i, b in enumerate(BIND)]
    assert all((r.binding == "BOUND") == (r.value_key is not None) for r in out.values())
    assert sum(r.n for r in W.rejection_counts(bound, ["id"]).collect()) == len(BIND)


def test_limits_refuse_and_cut_nothing(spark):
    page = lambda body: f"<html><body>{body}</body></html>"
    rows = {
        "fine": page("<p>a</p>"), "empty": "", "null": None, "large": page("x" * 2_000), "pdf": "%PDF-1.4 <p>", "many": page("<i>" * 60), "text": page("word " * 200), "blocks": page("<script type='application/ld+json'>1</script>" * 5),
        "open": '<p>seen</p><script type="application/ld+json">{"a": 1', "bom": "﻿<p>a</p>", "nested": page("<div hidden><p>no</p></div><p aria-hidden='TRUE'>no</p><template>no</template>yes"),
    }
    df = spark.createDataFrame(list(rows.items()), "id string, html string")
    out = {r.id: r for r in A.read_artifacts(df, "id", max_bytes=1_500, elements=50, text=500, blocks=4).collect()}
    assert {k: r.status for k, r in out.items()} == {
        "fine": "PARSED", "empty": "EMPTY", "null": "EMPTY", "large": "TOO_MANY_BYTES", "pdf": "PDF_SIGNATURE", "many": "TOO_MANY_ELEMENTS", "text": "TOO_MUCH_TEXT", "blocks": "TOO_MANY_JSONLD_BLOCKS",
        "open": "PARSED", "bom": "PARSED", "nested": "PARSED",
    }
    assert all((r.content is None) == (r.status != "PARSED") for r in out.values())
    assert out["open"].content.blocks[0].error and out["open"].content.visible == "seen" and out["nested"].content.visible == "yes" and out["bom"].content.visible == "a"
    raw = spark.createDataFrame([(1, b"\xff\xfe<p>", "text/html"), (2, b"<p>x</p>", "application/pdf"), (3, b"<p>x</p>", " TEXT/html ; charset=utf-8"), (4, b"<p>x</p>", None)], "id int, html binary, kind string")
    assert [r.status for r in A.read_artifacts(raw, "id", media_type="kind").orderBy("id").collect()] == ["NOT_UTF8", "NOT_HTML", "PARSED", "NOT_HTML"]


def test_fragments_and_nodes_have_addresses(spark, stored):
    artifacts, nodes, fragments, _ = stored
    visible = artifacts.where("id = 'one'").first().content.visible
    assert all(visible[r.begin : r.end] == r.text for r in fragments.where("id = 'one'").collect())
    found = {r.pointer: r for r in nodes.where("id = 'one'").collect()}

    def at(pointer):
        v = PRODUCT
        for p in pointer.split("/")[1:]:
            v = v[int(p)] if isinstance(v, list) else v[p]
        return v

    assert len(found) == 3 + 1 + len(PRODUCT["additionalProperty"]) + sum(len(p) for p in PRODUCT["additionalProperty"] if isinstance(p, dict))
    assert all(r.text == (v if isinstance(v, str) else json.dumps(v)) for p, r in found.items() if not isinstance(v := at(p), (dict, list)))
    assert [p for p, r in found.items() if r.is_primary] == [""]
    odd = spark.createDataFrame([(1, html(['{"a~b/c": {"value": {"z": 1, "y": [true, null]}}}']))], "id int, html string")
    inner = {r.pointer: r for r in A.json_nodes(A.read_artifacts(odd, "id"), "id").collect()}
    assert inner["/a~0b~1c/value"].text == '{"y":[true,null],"z":1}' and inner["/a~0b~1c/value/y/0"].kind == "boolean" and inner["/a~0b~1c"].text is None


def test_web_values(spark):
    rows = [("NUMBER", " 012.50 ", "in"), ("NUMBER", "12.5", "inch"), ("NUMBER", ".5", ""), ("NUMBER", "-0", ""), ("NUMBER", "1e3", ""), ("NUMBER", "x", ""), ("RANGE", "1 to 2.0 in", ""), ("RANGE", "1..2", "in"), ("RANGE", "3 - 2", ""), ("RANGE", "1 to 2 in", "V"), ("ENUM", " Black ", ""), ("TEXT", "  ", ""), ("BOOLEAN", "YES", ""), ("BOOLEAN", "1", "V"), ("NUMBER", "1" * 30, ""), ("NUMBER", "0.0000000000001", ""), (None, "1", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, kind string, raw string, uom string")
    got = [r.k for r in df.select("n", web_value("kind", "raw", "uom")["key"].alias("k")).orderBy("n").collect()]
    assert got == ["NUMBER|12.5|in", "NUMBER|12.5|in", "NUMBER|0.5|", "NUMBER|0|", None, None, "RANGE|1 to 2|in", "RANGE|1 to 2|in", None, None, "ENUM|black|", None, "BOOLEAN|true|", None, None, None, None]
    assert Decimal("12.50") == Decimal("12.5")
