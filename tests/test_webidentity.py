import json

import pytest
from pyspark.sql import functions as F

from catalith.operators import webidentity as W
from catalith.sources.html import parse_pages
from tests.test_operators import one


def block(x):
    return f'<script type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>'


P = {"@type": "Product", "mpn": "M-1"}
PAGES = [
    (block(P), "EXACT_PRODUCT_MPN"), (block([P, {"@type": "Thing"}]), "EXACT_PRODUCT_MPN"), (block({"mainEntity": P, "related": {"@type": "Product", "mpn": "X"}}), "EXACT_PRODUCT_MPN"),
    (block({"mainEntity": {"@id": "#a"}, "@graph": [P | {"@id": "#a"}, {"@type": "Product", "mpn": "X"}]}), "EXACT_PRODUCT_MPN"), (block({"@graph": [P, {"@type": "Product", "mpn": "X"}]}), "CONFLICTING_PRODUCT_MPN"),
    (block({"@graph": [P, {"@type": "Product"}]}), "MULTIPLE_PRODUCTS_AMBIGUOUS"), (block({"@type": "Product", "mpn": "X", "isRelatedTo": P}), "TARGET_ONLY_IN_NONPRIMARY_PRODUCT"), (block({"@type": "Product", "mpn": "X"}), "PRODUCT_MPN_MISMATCH"),
    (block({"@type": "Product", "mpn": 5}) + "<p>M - 1</p>", "MPN_ONLY_IN_VISIBLE_TEXT"), (block("{oops"), "MALFORMED_JSONLD"), ("<title>M-1 sheet</title>", "MPN_ONLY_IN_TITLE"), ("<p>nothing</p>", "NO_PRODUCT_IDENTITY_STRUCTURE"),
    ('<link rel="canonical" href="/p/m-1">', "MPN_ONLY_IN_URL"), (block({"@type": "Product"}), "MPN_ABSENT"),
]


def test_page_identity(spark):
    rows = [(i, h, "m-1", "Acme", "ACME", "APPROVED_MANUFACTURER") for i, (h, _) in enumerate(PAGES)]
    n = len(rows)
    rows += [(n, PAGES[0][0], " ", "Acme", "ACME", "APPROVED_MANUFACTURER"), (n + 1, PAGES[0][0], "m-1", "Acme", "ACME", "UNKNOWN"), (n + 2, PAGES[0][0], "m-1", "Acme", "Other", "APPROVED_MANUFACTURER")]
    df = parse_pages(spark.createDataFrame(rows, "page_id int, html string, mpn string, brand string, publisher string, authority string"))
    got = {r.page_id: (r.reason, r.decision) for r in W.page_identity(df, "page_id").collect()}
    assert [got[i][0] for i in range(n + 3)] == [r for _, r in PAGES] + ["INVALID_TARGET_MPN", "MANUFACTURER_AUTHORITY_REQUIRED", "PUBLISHER_MISMATCH"]
    assert got[0][1] == "EXACT" and got[4][1] == "REVIEW" and got[7][1] == "WITHHOLD"


def test_pointers(spark):
    doc = {"a/b": [{"~": 1}], "": 2}
    assert W.resolve_pointer(doc, "/a~1b/0/~0") == 1 and W.resolve_pointer(doc, "") is doc and W.resolve_pointer(doc, "/") == 2
    for bad in ("a", "/a~1b/00", "/a~1b/1", "/x", "/a~1b/-"):
        with pytest.raises(KeyError):
            W.resolve_pointer(doc, bad)
    assert one(spark, W.json_at(F.lit('{"a": {"c": 1, "b": "x"}}'), F.lit("/a"))) == '{"b":"x","c":1}'


def test_timeline(spark):
    df = spark.createDataFrame([("a", "COMMIT", "EXACT_ALIAS", "REVIEW", "OVERLAPPING_FAMILY_CUES"), ("b", "COMMIT", "x", "COMMIT", "y")], "Mfg_Part_Num string, manuf_decision string, manuf_reason string, class_decision string, class_reason string")
    assert {tuple(r) for r in W.report(W.timeline(df)).collect()} == {("a", "REVIEW", "OVERLAPPING_FAMILY_CUES"), ("b", "PARTIAL", "")}
