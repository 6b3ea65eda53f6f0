"""Values that a page states or a model proposes: parsed by their kind, compared by what they mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalith.functions.text import col, strip
from catalith.functions.values import normalize_uom

KINDS = ("TEXT", "NUMBER", "RANGE", "ENUM", "BOOLEAN")
_NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)"
_RANGE = rf"(?i)^({_NUMBER})\s*(?:to|\.\.|–|—|\s-\s)\s*({_NUMBER})(?:\s+(\S(?:.*\S)?))?$"


def decimal_key(c) -> Column:
    """A decimal spelling as plain digits: no sign of zero, no leading or trailing zeros. Null where it isn't a number or has over 38 digits."""
    text = col(c)
    plain = F.when(F.rlike(text, F.lit(rf"^{_NUMBER}$")), F.regexp_replace(F.regexp_replace(text, r"^([+-]?)\.", r"$10."), r"\.$", "").try_cast("decimal(38,12)"))
    digits = F.regexp_replace(F.regexp_replace(text, r"^[+-]?0*", ""), r"\.", "")
    fits = F.length(digits) <= 38
    shown = F.regexp_replace(F.regexp_replace(plain.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    small = F.length(F.regexp_extract(text, r"\.(\d*?)0*$", 1)) <= 12
    return F.when(plain.isNotNull() & fits & small, F.when(plain == 0, "0").otherwise(shown))


def web_value(kind, raw, uom) -> Column:
    """struct(key, uom, resolution): key is what values of this kind are compared by, null where raw isn't such a value.

    Numbers are compared as exact decimals (up to 26 digits before the point and 12 behind it), ranges by
    both ends, of which the first isn't the greater, ENUM without case; a BOOLEAN has no unit.
    A range's own unit counts where none is given, and may not contradict a given one.
    """
    k, text = col(kind), strip(raw)
    given = F.coalesce(col(uom), F.lit(""))
    part = lambda i: F.regexp_extract(text, _RANGE, i)
    lo, hi, own = part(1), part(2), part(3)
    unit = F.when((k == "RANGE") & (given == ""), own).otherwise(given)
    known = normalize_uom(unit)
    low = F.lower(text)
    ordered = decimal_key(lo).isNotNull() & decimal_key(hi).isNotNull() & (lo.try_cast("decimal(38,12)") <= hi.try_cast("decimal(38,12)")) & ((own == "") | (given == "") | (own == given))
    body = (
        F.when((k == "TEXT") & (text != ""), text)
        .when((k == "ENUM") & (text != ""), low)
        .when(k == "NUMBER", decimal_key(text))
        .when((k == "RANGE") & ordered, F.concat_ws(" to ", decimal_key(lo), decimal_key(hi)))
        .when((k == "BOOLEAN") & (given == ""), F.when(low.isin("true", "yes", "1"), "true").when(low.isin("false", "no", "0"), "false"))
    )
    return F.struct(F.when(body.isNotNull(), F.concat_ws("|", k, body, F.coalesce(known["uom"], F.lit("")))).alias("key"), known["uom"].alias("uom"), known["resolution"].alias("resolution"))
