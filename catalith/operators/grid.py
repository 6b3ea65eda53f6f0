"""What the catalogue grid does with uploaded rows: map headers, validate, search, sort, page, summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.functions.text import col, strip

# What the grid takes for "no value"; not the placeholders of the catalogue files.
_EMPTY = r"(?i)^(n/?a|none|null|unknown|tbd|test|-+)$"


def normalized_header(h: str) -> str:
    return " ".join(h.lower().translate(dict.fromkeys(map(ord, "_-./"), " ")).split())


def unique_headers(headers: list[str]) -> list[str]:
    """Blank headers get a number, repeated ones a count."""
    out, seen = [], {}
    for i, h in enumerate(headers, 1):
        name = h.strip() or f"Column {i}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name} ({seen[name]})")
    return out


def detect_mapping(headers: list[str], aliases: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Field to header: for each field in turn the first unused header that is one of its aliases."""
    out: dict[str, str] = {}
    for field, names in aliases.items():
        hit = next((h for h in headers if h not in out.values() and normalized_header(h) in names), None)
        if hit is not None:
            out[field] = hit
    return out


def is_empty(c) -> Column:
    return (strip(c) == "") | F.rlike(strip(c), F.lit(_EMPTY)) | col(c).isNull()


def validated(rows: DataFrame, mpn: str, required: list[str]) -> DataFrame:
    """Adds issues and status: INVALID without a number, REVIEW with any other issue, READY."""
    key = F.upper(strip(mpn))
    same = F.count(F.lit(1)).over(Window.partitionBy(key))
    issues = F.array(F.when(is_empty(mpn), "MISSING_MPN"), F.when(~is_empty(mpn) & (same > 1), "DUPLICATE_MPN"), *[F.when(is_empty(c), F.lit(f"MISSING_{c.upper()}")) for c in required])
    out = rows.withColumn("issues", F.filter(issues, lambda x: x.isNotNull()))
    return out.withColumn("status", F.when(F.array_contains("issues", "MISSING_MPN"), "INVALID").when(F.size("issues") > 0, "REVIEW").otherwise("READY"))


def search(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower().strip()))
    return rows.where(hit)


def natural_key(c) -> Column:
    """A key that sorts a2 before a10: digits are padded to 18 places."""
    parts = F.regexp_extract_all(F.lower(col(c)), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit("^[0-9]")), F.lpad(p, 18, "0")).otherwise(p)), "")


def page(rows: DataFrame, order: list, number: int, size: int = 20) -> DataFrame:
    """One page (from 1) under a total order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def overall_state(stages: DataFrame, by: list[str], state: str) -> DataFrame:
    """The state of each run from those of its stages: the gravest counts, then PARTIAL if one has not run, else VERIFIED."""
    has = lambda s: F.bool_or(F.col(state) == s)
    flags = stages.groupBy(*by).agg(*[has(s).alias(s) for s in ("BLOCKED", "WITHHELD", "REVIEW", "NOT_RUN")])
    out = F.when(F.col("BLOCKED"), "BLOCKED").when(F.col("WITHHELD"), "WITHHELD").when(F.col("REVIEW"), "REVIEW").when(F.col("NOT_RUN"), "PARTIAL").otherwise("VERIFIED")
    return flags.select(*by, out.alias("overall"))
