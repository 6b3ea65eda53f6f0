"""Digests, canonical JSON, keys and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalith.functions.text import col

# The query parameters that are scrubbed from text.
_SECRET = r"(?i)\b(api[-_]?key|access[-_]?token|refresh[-_]?token|id[-_]?token|auth|authorization|token|key|password|secret|signature)=([^&\s\"']+)"


def sha256(c) -> Column:
    return F.sha2(col(c).cast("string"), 256)


def artifact_id(digest: Column) -> Column:
    """sha256:<digest>, null unless the digest is 64 lower-case hexadecimal digits."""
    return F.when(is_sha256(digest), F.concat(F.lit("sha256:"), digest))


def is_sha256(c) -> Column:
    return F.rlike(col(c), F.lit("^[0-9a-f]{64}$"))


def from_artifact_id(c) -> Column:
    return F.nullif(F.regexp_extract(col(c), "^sha256:([0-9a-f]{64})$", 1), F.lit(""))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON of fields in the order of their names, without spaces, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def digest(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def redact_text(c) -> Column:
    return F.regexp_replace(col(c), _SECRET, "$1=[REDACTED]")


def normalise_key(c) -> Column:
    return F.lower(F.regexp_replace(col(c), r"[-_\s.]+", ""))


def is_sensitive_key(c, exact: tuple[str, ...], markers: tuple[str, ...]) -> Column:
    key = normalise_key(c)
    hit = key.isin(*exact) if exact else F.lit(False)
    for m in markers:
        hit = hit | key.contains(m)
    return hit


def redact_map(c, exact: tuple[str, ...], markers: tuple[str, ...]) -> Column:
    """Values of sensitive keys replaced, the others scrubbed."""
    return F.transform_values(col(c), lambda k, v: F.when(is_sensitive_key(k, exact, markers), F.lit("[REDACTED]")).otherwise(redact_text(v)))


def fill_template(template: Column, base: Column, code: Column) -> Column:
    """{base} and {code} filled in; null unless the template holds both and nothing else in braces."""
    rest = F.replace(F.replace(template, F.lit("{base}"), F.lit("")), F.lit("{code}"), F.lit(""))
    sound = template.contains("{base}") & template.contains("{code}") & ~F.rlike(rest, F.lit(r"[{}]"))
    return F.when(sound, F.replace(F.replace(template, F.lit("{base}"), base), F.lit("{code}"), code))
