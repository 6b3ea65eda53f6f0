"""Verification of claims against the text that is said to state them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions import text as T
from catalith.functions.values import QUANTITY, UNITS

_FACTOR = {s: (d, float(f)) for s, d, f in UNITS}
RELATIONS = {"": "EQ", "=": "EQ", "<": "LT", ">": "GT", "<=": "LE", ">=": "GE", "≤": "LE", "≥": "GE"}


def _lookup(c: Column, of: int) -> Column:
    """Dimension (0) or factor (1) of a unit symbol; null if it isn't known."""
    table = F.create_map(*[x for s, v in _FACTOR.items() for x in (F.lit(s), F.lit(v[of]))])
    return F.try_element_at(table, F.coalesce(c, F.lit("")))


def stated(c) -> Column:
    """The quantities of a text: array of struct(number, unit, relation). `a/b unit` gives both numbers the unit."""
    listed = F.regexp_replace(T.col(c), r"([0-9]+(?:\.[0-9]+)?)\s*/\s*([0-9]+(?:\.[0-9]+)?)(\s*)([A-Za-zµΩ%°][A-Za-z0-9]*)", "$1$3$4 $2$3$4")
    group = lambda i: F.regexp_extract_all(listed, F.lit(QUANTITY), F.lit(i))
    relation = F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])
    return F.transform(F.arrays_zip(group(1).alias("op"), group(2).alias("n"), group(3).alias("u")), lambda q: F.struct(F.replace(q["n"], F.lit(","), F.lit(".")).cast("double").alias("number"), F.nullif(q["u"], F.lit("")).alias("unit"), F.try_element_at(relation, q["op"]).alias("relation")))


def quantity_agrees(q: Column, number: Column, unit: Column) -> Column:
    """Whether a stated quantity is the claimed magnitude, units of one dimension converted; its relation aside."""
    both = _lookup(q["unit"], 0) == _lookup(unit, 0)
    a = F.when(unit.isNull(), q["number"]).otherwise(q["number"] * _lookup(q["unit"], 1))
    b = F.when(unit.isNull(), number).otherwise(number * _lookup(unit, 1))
    near = F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    affine = unit.isin("°C", "K") & (q["unit"] != unit)
    return F.coalesce(F.when(unit.isNull(), _lookup(q["unit"], 0).isNull()).otherwise(both & ~affine) & near, F.lit(False))


def line_verdict(line: Column, q: Column) -> Column:
    """Null if the line, which states the quantities q, states the claim (columns kind, number, unit, value), else the reason why not."""
    number, unit = F.col("number"), F.col("unit")
    agrees = lambda x: quantity_agrees(x, number, unit)
    numeric = (
        F.when(F.exists(q, lambda x: (x["relation"] == "EQ") & agrees(x)), F.lit(None))
        .when(F.exists(q, agrees), "OPERATOR_MISMATCH")
        .when((F.size(q) > 0) & unit.isNotNull() & ~F.exists(q, lambda x: F.coalesce(_lookup(x["unit"], 0) == _lookup(unit, 0), F.lit(False))), "UNIT_NOT_SUPPORTED")
        .otherwise("VALUE_NOT_SUPPORTED")
    )
    words = F.when((F.trim("value") != "") & T.contains_phrase(line, F.trim("value")), F.lit(None)).otherwise("VALUE_NOT_SUPPORTED")
    return F.when(F.col("kind") == "numeric", numeric).when(F.col("kind") == "alphanumeric", words).otherwise("UNSUPPORTED_VALUE_KIND")


def _digest(sha: Column) -> Column:
    """A well-formed digest as half as many bytes, which is what is shuffled; null for any other."""
    return F.when(F.rlike(sha, F.lit("^[0-9a-f]{64}$")), F.when(F.length(sha) == 64, F.unhex(sha)).otherwise(sha.cast("binary")))


def verify(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """(claim_id, status, failure): EXACT_SPAN, or UNVERIFIED with the first failure in order.

    claims: claim_id, sha, page, mpn, resolved_mpn, fragment, kind, number, unit, value; claim_id is their key.
    pages: sha, page, text, text_sha, covers_mpn; (sha, page) is their key. Claims meet pages by it; then only
    the lines that hold the fragment are looked at, and all of them must agree. Lines are judged
    in the claim's row, so that no text is shuffled but once, as its page; what needs no page is decided before.
    """
    pages = pages.withColumn("_key", _digest(F.col("sha")))
    has = pages.groupBy("_key").agg(F.max("covers_mpn").alias("covers"))
    texts = pages.select("_key", "page", "text", (F.sha2("text", 256) != F.col("text_sha")).alias("altered"), F.lit(True).alias("found"))
    same = T.canonical_mpn("mpn") == T.canonical_mpn("resolved_mpn")
    early = (
        F.when(F.col("resolved_mpn").isNull(), "PRODUCT_SCOPE_NOT_SUPPORTED")
        .when(~F.coalesce(same, F.lit(False)), "PRODUCT_REFERENCE_MISMATCH")
        .when(~F.rlike("sha", F.lit("^[0-9a-f]{64}$")), "ARTIFACT_MISMATCH")
    )
    open_ = F.col("early").isNull()
    df = claims.withColumn("early", early)
    # What meets no page is dealt by its id, in fewer bytes than a digest has: neither of one key nor equal to any.
    alone = F.unhex(F.md5(F.coalesce(F.col("claim_id").cast("string"), F.lit("")).cast("binary")))
    df = df.select("claim_id", "early", F.coalesce(F.when(open_, _digest(F.col("sha"))), alone).alias("_key"), *[F.when(open_, F.col(c)).alias(c) for c in ("page", "mpn", "fragment", "kind", "number", "unit", "value")])
    covered = F.col("covers").isNotNull()
    df = df.join(has, "_key", "left").withColumns({"covered": covered, "other": covered & (T.canonical_mpn("covers") != T.canonical_mpn("mpn"))}).drop("covers", "mpn")
    df = df.join(texts, ["_key", "page"], "left")
    held = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.contains(F.col("fragment")) & (F.col("fragment") != ""))
    read = F.transform(held, lambda x: F.struct(x.alias("line"), F.when(F.col("kind") == "numeric", stated(x)).alias("q")))
    unread = (
        F.when(~F.col("covered") & F.col("found").isNull(), "ARTIFACT_UNREADABLE")
        .when(F.col("other"), "PRODUCT_REFERENCE_MISMATCH")
        .when(F.col("found").isNull(), "PAGE_NOT_FOUND")
        .when(F.col("altered"), "ARTIFACT_UNREADABLE")
        .when(~F.col("covered"), "PRODUCT_SCOPE_NOT_SUPPORTED")
    )
    df = df.withColumn("early", F.coalesce("early", unread))
    df = df.select("claim_id", "early", F.when(open_, F.transform(read, lambda x: line_verdict(x["line"], x["q"]))).alias("verdicts"))
    n, n_bad = F.size("verdicts"), F.size(F.filter("verdicts", lambda v: v.isNotNull()))
    failure = F.when(~open_, F.col("early")).when(n == 0, "FRAGMENT_NOT_FOUND").when((n_bad > 0) & (n_bad < n), "AMBIGUOUS_MATCH").when(n_bad > 0, F.array_min("verdicts"))
    return df.select("claim_id", failure.alias("failure")).withColumn("status", F.when(F.col("failure").isNull(), "EXACT_SPAN").otherwise("UNVERIFIED"))


def resolve_slots(profile: DataFrame, candidates: DataFrame) -> DataFrame:
    """(record, slot_key, decision, reason, winner) of each profile slot from its candidates.

    profile: record, slot_key, label, kind, uom. candidates: record, slot_key, candidate_id, label,
    value_kind, value_uom, value_key, eligible, decision, rank (a total order). Each slot's
    candidates are only summed, so none is gathered.
    """
    c = candidates.withColumnsRenamed({"label": "c_label"})
    rows = profile.join(c, ["record", "slot_key"], "left")
    some = F.col("candidate_id").isNotNull()
    any_ = lambda x: F.coalesce(F.bool_or(some & F.coalesce(x, F.lit(False))), F.lit(False))
    valued = F.col("value_key").isNotNull()
    sums = rows.groupBy("record", "slot_key").agg(
        F.count("candidate_id").alias("n"),
        any_(F.col("c_label") != F.col("label")).alias("labels"),
        any_(valued & F.col("kind").isNotNull() & (F.col("value_kind") != F.col("kind"))).alias("kinds"),
        any_(valued & F.col("uom").isNotNull() & ~F.coalesce(F.col("value_uom") == F.col("uom"), F.lit(False))).alias("uoms"),
        F.min("value_key").alias("lo"),
        F.max("value_key").alias("hi"),
        F.count("value_key").alias("valued"),
        F.min(F.when(some & F.col("eligible"), F.struct("rank", "candidate_id"))).alias("best"),
        any_(F.col("decision").isin("REVIEW", "COMMIT")).alias("open"),
    )
    col = F.col
    reason = (
        F.when(col("n") == 0, "NO_CANDIDATE").when(col("labels"), "LABEL_MISMATCH").when(col("kinds"), "VALUE_KIND_MISMATCH").when(col("uoms"), "UOM_MISMATCH").when(col("lo") != col("hi"), "CONFLICTING_VALUES")
        .when(col("best").isNotNull(), F.when(col("valued") > 1, "DUPLICATE_AGREEMENT").otherwise("ELIGIBLE")).otherwise("NOT_ELIGIBLE")
    )
    out = sums.withColumn("reason", reason)
    r = F.col("reason")
    decision = F.when(r == "NO_CANDIDATE", "WITHHOLD").when(r.isin("ELIGIBLE", "DUPLICATE_AGREEMENT"), "COMMIT").when((r != "NOT_ELIGIBLE") | col("open"), "REVIEW").otherwise("WITHHOLD")
    return out.select("record", "slot_key", decision.alias("decision"), "reason", F.when(r.isin("ELIGIBLE", "DUPLICATE_AGREEMENT"), col("best.candidate_id")).alias("winner"))
