"""Whether a stored web page is about one product number: structured nodes first, text only as a hint."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from catalith.functions import text as T


def resolve_pointer(document, pointer: str):
    """RFC 6901; raises KeyError where it leads nowhere. Array places are plain decimal numbers."""
    if pointer and not pointer.startswith("/"):
        raise KeyError(pointer)
    for part in pointer.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(document, list):
            if not part.isdecimal() or part != str(int(part)) or int(part) >= len(document):
                raise KeyError(part)
            document = document[int(part)]
        elif isinstance(document, dict) and part in document:
            document = document[part]
        else:
            raise KeyError(part)
    return document


@F.pandas_udf(StringType())
def json_at(documents: pd.Series, pointers: pd.Series) -> pd.Series:
    """The value at a pointer as text (strings plain, the rest as JSON); null where there is none."""

    def at(d, p):
        try:
            v = resolve_pointer(json.loads(d), p)
        except (KeyError, ValueError, TypeError):
            return None
        return v if isinstance(v, str) else json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([at(d, p) for d, p in zip(documents, pointers, strict=True)])


def _is_product(node) -> bool:
    kinds = node.get("@type") if isinstance(node, dict) else None
    return "Product" in (kinds if isinstance(kinds, list) else [kinds])


def _level(value, pointer: str) -> dict[str, dict]:
    """Products at exactly this place: the value itself or, of a list, its members."""
    items = {pointer: value} if not isinstance(value, list) else {f"{pointer}/{i}": v for i, v in enumerate(value)}
    return {p: v for p, v in items.items() if _is_product(v)}


def primary_pointers(block) -> set[str]:
    """Products that the page is about: the root, else the main entity, else the graph's (those that the main entity names, if any)."""
    found = _level(block, "")
    if found or not isinstance(block, dict):
        return set(found)
    main = block.get("mainEntity")
    if embedded := _level(main, "/mainEntity"):
        return set(embedded)
    graph = _level(block.get("@graph"), "/@graph")
    named = {m.get("@id") for m in (main if isinstance(main, list) else [main]) if isinstance(m, dict) and isinstance(m.get("@id"), str)}
    chosen = {p for p, v in graph.items() if v.get("@id") in named}
    return chosen or set(graph)


def product_nodes(pages: DataFrame, id_col: str) -> DataFrame:
    """(id_col, block, pointer, is_primary, mpns) of every product node at any depth; numbers that aren't text are left out."""

    def walk(node, pointer):
        if _is_product(node):
            yield pointer, node
        items = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ()
        for k, v in items:
            yield from walk(v, f"{pointer}/{str(k).replace('~', '~0').replace('/', '~1')}")

    def nodes(frames):
        for pdf in frames:
            out = []
            for page, blocks in zip(pdf[id_col], pdf["jsonld"], strict=True):
                for b, text in enumerate(blocks if blocks is not None else []):
                    block = json.loads(text)
                    primary = primary_pointers(block)
                    for pointer, node in walk(block, ""):
                        mpn = node.get("mpn")
                        out.append((page, b, pointer, pointer in primary, [m for m in (mpn if isinstance(mpn, list) else [mpn]) if isinstance(m, str)]))
            yield pd.DataFrame(out, columns=[id_col, "block", "pointer", "is_primary", "mpns"])

    slim = pages.select(id_col, F.col("page.jsonld").alias("jsonld"))
    return slim.mapInPandas(nodes, f"{id_col} {dict(slim.dtypes)[id_col]}, block int, pointer string, is_primary boolean, mpns array<string>")


def page_identity(pages: DataFrame, id_col: str) -> DataFrame:
    """(id_col, decision, reason): EXACT only for a number on a primary product node; fails closed, the first refusal counts.

    pages: id_col, page (of parse_pages), mpn, brand, publisher, authority.
    """
    target = T.canonical_mpn("mpn")
    nodes = product_nodes(pages, id_col).withColumn("mpns", F.filter(F.transform("mpns", T.canonical_mpn), lambda x: x.isNotNull()))
    wanted = pages.select(id_col, target.alias("target"))
    p = F.col("is_primary")
    sums = nodes.join(wanted, id_col).groupBy(id_col).agg(
        F.count_if(p).alias("primary"),
        F.count_if(p & (F.size("mpns") == 0)).alias("bare"),
        F.array_distinct(F.flatten(F.collect_list(F.when(p, F.col("mpns"))))).alias("numbers"),
        F.bool_or(~p & F.coalesce(F.array_contains("mpns", F.col("target")), F.lit(False))).alias("elsewhere"),
    )
    df = pages.join(sums, id_col, "left")
    signal = lambda c: F.coalesce(F.rlike(F.col(c), T.spaced_pattern("mpn")), F.lit(False))
    visible, title, url = (signal(f"page.{c}") for c in ("visible", "title", "canonical"))
    hint = F.when(visible, "MPN_ONLY_IN_VISIBLE_TEXT").when(title, "MPN_ONLY_IN_TITLE").when(url, "MPN_ONLY_IN_URL").otherwise("MPN_ABSENT")
    elsewhere, primary, numbers = F.coalesce("elsewhere", F.lit(False)), F.coalesce("primary", F.lit(0)), F.coalesce("numbers", F.array().cast("array<string>"))
    reason = (
        F.when(target.isNull(), "INVALID_TARGET_MPN")
        .when(~F.coalesce(F.col("authority") == "APPROVED_MANUFACTURER", F.lit(False)), "MANUFACTURER_AUTHORITY_REQUIRED")
        .when(~F.coalesce(T.canonical_brand("brand") == T.canonical_brand("publisher"), F.lit(False)), "PUBLISHER_MISMATCH")
        .when(F.col("page.jsonld_errors") > 0, "MALFORMED_JSONLD")
        .when(primary == 0, F.when(elsewhere, "TARGET_ONLY_IN_NONPRIMARY_PRODUCT").when(visible | title | url, hint).otherwise("NO_PRODUCT_IDENTITY_STRUCTURE"))
        .when(F.size(numbers) > 1, "CONFLICTING_PRODUCT_MPN")
        .when((primary > 1) & (F.col("bare") > 0), "MULTIPLE_PRODUCTS_AMBIGUOUS")
        .when(F.array_contains(numbers, target), "EXACT_PRODUCT_MPN")
        .when(elsewhere, "TARGET_ONLY_IN_NONPRIMARY_PRODUCT")
        .when(F.size(numbers) > 0, "PRODUCT_MPN_MISMATCH")
        .otherwise(hint)
    )
    out = df.select(id_col, reason.alias("reason"))
    r = F.col("reason")
    return out.withColumn("decision", F.when(r == "EXACT_PRODUCT_MPN", "EXACT").when(r.isin("CONFLICTING_PRODUCT_MPN", "MULTIPLE_PRODUCTS_AMBIGUOUS"), "REVIEW").otherwise("WITHHOLD"))


STAGES = ("NORMALIZATION", "CLASSIFICATION", "DISCOVERY", "ACQUISITION", "IDENTITY", "AI_PROPOSAL", "VERIFICATION", "DELIVERY_MAPPING")


def timeline(df: DataFrame) -> DataFrame:
    """Adds timeline: eight stages of (stage, status, reason). Wants manuf_decision, manuf_reason, class_decision, class_reason; the stages after them have not run."""
    status = lambda d: F.when(F.col(d) == "COMMIT", "VERIFIED").when(F.col(d) == "REVIEW", "REVIEW").otherwise("WITHHELD")
    entry = lambda stage, s, r: F.struct(F.lit(stage).alias("stage"), s.alias("status"), r.alias("reason"))
    ran = [entry(STAGES[0], status("manuf_decision"), F.col("manuf_reason")), entry(STAGES[1], status("class_decision"), F.col("class_reason"))]
    rest = [entry(s, F.lit("NOT_RUN"), F.lit("EVIDENCE_NOT_AVAILABLE")) for s in STAGES[2:]]
    return df.withColumn("timeline", F.array(*ran, *rest))


def report(df: DataFrame) -> DataFrame:
    """mpn, state and the reason of the first stage that stopped the row, from timeline."""
    has = lambda s: F.exists("timeline", lambda t: t["status"] == s)
    state = F.when(has("BLOCKED"), "BLOCKED").when(has("WITHHELD"), "WITHHELD").when(has("REVIEW"), "REVIEW").when(has("NOT_RUN"), "PARTIAL").otherwise("VERIFIED")
    stopping: Column = F.get(F.filter("timeline", lambda t: t["status"].isin("BLOCKED", "WITHHELD", "REVIEW")), F.lit(0))
    return df.select(F.col("Mfg_Part_Num").alias("mpn"), state.alias("state"), F.coalesce(stopping["reason"], F.lit("")).alias("reason"))
