import io
import zipfile

import pytest

from catalith.operators import catalogue as C
from catalith.sources import catalogue as S
from catalith.sources import html, registries, stores
from catalith.streaming import catalogue as stream

HEAD = "Mfg_Part_Num,Part_Desc,E1_Brand,Unilog_Brand,DIB_Brand,Part_Manuf"


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_catalogue_file(spark, tmp_path):
    p = put(tmp_path / "a.csv", "﻿" + HEAD + ',Note\r\nA1,"two\nlines",-- Unbranded --,,x,Acme (US1),hi\r\n\r\nA2,"say ""x""",-,b,b,-,\r\nA3,short\r\n')
    rows = S.read_catalogue(spark, p).collect()
    assert [r.Mfg_Part_Num for r in rows] == ["A1", "A2", "A3"]
    assert rows[0].Part_Desc == "two\nlines" and rows[1].Part_Desc == 'say "x"' and rows[0].extra == {"Note": "hi"} and rows[1].extra == {"Note": ""}
    assert [r.malformed for r in rows] == [False, False, True] and rows[2].E1_Brand == ""


@pytest.mark.parametrize("head", [HEAD + ",Part_Desc", HEAD.replace("DIB_Brand", "Other")])
def test_bad_headers(spark, tmp_path, head):
    with pytest.raises(S.HeaderError):
        S.read_catalogue(spark, put(tmp_path / "a.csv", head + "\n"))


def test_delivery_contract(spark, tmp_path):
    heads = ["sku", "name", "ATTRIBUTE_LABEL 1", "ATTRIBUTE_VALUE 1", "ATTRIBUTE_UOM 1", "ATTRIBUTE_LABEL 2", "ATTRIBUTE_VALUE 2", "ATTRIBUTE_UOM 2", "end"]
    c = S.DeliveryContract.from_file(spark, put(tmp_path / "d.csv", ",".join(heads) + "\n"))
    assert len(c.slots) == 2 and len(c.fingerprint()) == 64
    base = spark.createDataFrame([("s1", "n1"), ("s2", None)], "sku string, name string")
    facts = spark.createDataFrame([("s1", 2, "Width", "3", "mm")], "sku string, slot int, label string, value string, uom string")
    rows = {r.sku: r for r in c.assemble(base, facts, "sku").collect()}
    assert rows["s1"]["ATTRIBUTE_VALUE 2"] == "3" and rows["s1"]["ATTRIBUTE_LABEL 1"] == "" and rows["s2"]["name"] == ""
    S.write_delivery(c.assemble(base, facts, "sku"), str(tmp_path / "out"))
    assert S.conformance(S.first_record(spark, str(tmp_path / "out")), heads) == {"count": True, "missing": [], "extra": [], "first_divergence": None}
    with pytest.raises(Exception, match="more attributes"):
        c.assemble(base, facts.selectExpr("sku", "3 AS slot", "label", "value", "uom"), "sku").collect()
    for bad in (["ATTRIBUTE_LABEL 1"], [h.replace("2", "3") for h in heads]):
        with pytest.raises(S.HeaderError):
            S.DeliveryContract(bad)


def test_manufacturer_forms(spark):
    cases = {"Acme (US1)": ("NAME_WITH_CODE", "Acme", "US1"), "": ("MISSING", None, None), " - ": ("PLACEHOLDER", None, None), "-- x --": ("PLACEHOLDER", None, None), "A )B(": ("UNRESOLVED", None, None), "Acme ()": ("UNRESOLVED", None, None),
             "(C)": ("UNRESOLVED", None, None), "A (US) Tools": ("NAME_ONLY", "A (US) Tools", None), "Plain": ("NAME_ONLY", "Plain", None), "A (b) (C)": ("NAME_WITH_CODE", "A (b)", "C"), "A ((b))": ("NAME_ONLY", "A ((b))", None)}
    df = spark.createDataFrame([(k,) for k in cases], "Part_Manuf string")
    assert {r.Part_Manuf: (r.manuf_status, r.manuf_name, r.manuf_code) for r in C.parse_manufacturer(df).collect()} == cases


def test_stores(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "text string")
    stores.put_artifacts(df, path)
    stores.put_artifacts(df, path)
    have = spark.read.parquet(path)
    assert have.count() == 2
    wanted = have.select("sha").union(spark.createDataFrame([("0" * 64,)], "sha string"))
    assert sorted(r.status for r in stores.load_artifacts(spark, path, wanted).collect()) == ["MISSING", "OK", "OK"]
    records = spark.createDataFrame([("k", "old", 1), ("k", "new", 2)], "key string, response string, captured_at int")
    out = {r.key: (r.response, r.outcome) for r in stores.replay(spark.createDataFrame([("k",), ("m",)], "key string"), records).collect()}
    assert out == {"k": ("new", "HIT"), "m": (None, "MISS")}


def test_registries(spark, tmp_path):
    good = 'authority = "OFFICIAL"\n[[rule]]\nsource_key = "a"\ntarget = "T"\nrequired = {line = "1"}\n'
    assert registries.load_mapping(spark, put(tmp_path / "m.toml", good)).collect()[0].required == {"line": "1"}
    for bad in (good.replace("authority", "x"), good + good.split("\n", 1)[1]):
        with pytest.raises(registries.RegistryError):
            registries.load_mapping(spark, put(tmp_path / "bad.toml", bad))
    domains = 'blocked = ["bad.example"]\n[[manufacturer]]\nkey = "k"\nauthority_hints = ["K"]\nlocator_hints = ["kk"]\ndomains = ["K.example"]\nreview = {by = "x"}\n'
    assert {tuple(r) for r in registries.load_domains(spark, put(tmp_path / "d.toml", domains)).collect()} == {("bad.example", "BLOCKED", None, False), ("k.example", "MANUFACTURER", "k", True)}
    with pytest.raises(registries.RegistryError):
        registries.load_domains(spark, put(tmp_path / "d.toml", domains.replace('"kk"', '"k"')))
    cases = registries.load_cases(spark, put(tmp_path / "c.json", '{"cases": [{"id": "1"}, {"id": "2"}]}'), "id: string")
    assert cases.count() == 2


def test_taxonomy(spark, tmp_path):
    tables = {
        "group": "GROUPID;GROUPDESC\nG1;Group\n", "class": "CLASSID;GROUPID;CLASSDESC\nC1;G1;Class\nC2;G9;Lost\n", "synonym": "CLASSID;SYNONYM\nC1;Alias\n", "feature": "FEATUREID;FEATUREDESC;FEATURETYPE\nF1;Width;N\nF2;Colour;A\nF3;Sealed;L\n",
        "unit": "UNITID;UNITABBREV\nU1;mm\n", "value": "VALUEID;VALUEDESC\nV1;Red\n", "classfeature": "MAPID;CLASSID;FEATUREID;UNITID;SORTNR\n1;C1;F1;U1;1\n2;C1;F2;;2\n3;C1;F3;;3\n4;C1;F9;;4\n", "classfeaturevalue": "MAPID;VALUEID;SORTNR\n2;V1;1\n2;V9;2\n",
    }
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, text in tables.items():
            z.writestr(f"{name}.csv", text.encode("utf-16"))
    (tmp_path / "t.zip").write_bytes(buf.getvalue())
    tax = registries.load_taxonomy(spark, str(tmp_path / "t.zip"))
    assert {tuple(r) for r in tax["issues"].collect()} == {("class", "group", "G9"), ("classfeature", "feature", "F9"), ("classfeaturevalue", "value", "V9")}
    claims = [("F1", "3", "mm", None), ("F1", "x", "mm", "NOT_A_NUMBER"), ("F1", "NaN", "mm", "NOT_FINITE"), ("F1", "3", None, "UNIT_MISSING"), ("F1", "3", "cm", "UNIT_UNEXPECTED"), ("F2", "red", None, None), ("F2", "Blue", None, "NOT_IN_PICKLIST"), ("F3", "maybe", None, "NOT_A_BOOLEAN"), ("F9", "1", None, "UNKNOWN_FEATURE")]
    df = spark.createDataFrame([("C1", *c) for c in claims], "CLASSID string, FEATUREID string, value string, unit string, expected string")
    assert all(r.issue == r.expected for r in registries.validate_values(df, tax).collect())


def test_html(spark):
    page = '<html><head><title> A  b </title><link rel="canonical" href="/x"><meta property="og:title" content="T"><script type="application/ld+json">{"@graph": [{"@type": ["Product"], "sku": "1", "a/b": {"@type": "Product"}}]}</script><script type="application/ld+json">{"x": NaN}</script></head><body><nav>no</nav><p>Hello <b>big</b><br>world</p><div hidden>no<p>no</p></div><p aria-hidden="true">no</p>end</body></html>'
    df = html.parse_pages(spark.createDataFrame([(1, page), (2, None), (3, "<p>open <i>tags")], "page_id int, html string"))
    rows = {r.page_id: r.page for r in df.collect()}
    assert (rows[1].title, rows[1].canonical, rows[1].visible, rows[1].jsonld_errors, rows[1].meta) == ("A b", "/x", "Hello\nbig\nworld\nend", 1, {"og:title": "T"})
    assert rows[2].visible == "" and rows[3].visible == "open\ntags"
    assert sorted(r.pointer for r in html.products(df, "page_id").collect()) == ["/0/@graph/0", "/0/@graph/0/a~1b"]


def test_stream_is_as_the_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        put(folder / f"{i}.csv", HEAD + f"\nP-{i},P-{i} small widget,Brand,-- none --,brand,Acme (A{i})\n")
    cues = [("WIDGET", ("widget",))]
    q = stream.write_decisions(stream.read_stream(spark, str(folder), 1), str(tmp_path / "out"), str(tmp_path / "cp"), cues)
    q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.Mfg_Part_Num, r.family, r.brand_decision, r.manuf_code) for r in rows) == [(f"P-{i}", "WIDGET", "COMMIT", f"A{i}") for i in range(3)]


def test_pages_are_held_a_bounded_number_at_once():
    import pyarrow as pa

    from catalith.sources.artifacts import pieces

    batch = pa.RecordBatch.from_pydict({"x": [b"a" * 3, None, b"b" * 9, b"", b"c", b"d"]})
    assert [p.column("x").to_pylist() for p in pieces([batch], "x", 2, 8)] == [[b"aaa", None], [b"b" * 9], [b"", b"c"], [b"d"]]
    assert [p.num_rows for p in pieces([batch, batch.slice(0, 0)], "x", 100, 100)] == [6]


def test_parsed_pages_come_in_small_pieces_in_their_order(spark, monkeypatch):
    from catalith.sources import html

    monkeypatch.setattr(html, "AT_ONCE", 3)
    pages = spark.range(10).selectExpr("id", "IF(id = 4, NULL, concat('<p>', id, '</p>')) AS html").coalesce(1)
    assert [(r.id, r.page.visible) for r in html.parse_pages(pages).collect()] == [(i, "" if i == 4 else str(i)) for i in range(10)]
