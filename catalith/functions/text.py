"""Text, key and URL columns. White space is Unicode's throughout; Spark's trim and \\s alone are not."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Corporate forms dropped from names. The two lists are kept apart on purpose.
LEGAL_SUFFIXES = ("ag", "bv", "co", "company", "corp", "corporation", "gmbh", "inc", "incorporated", "limited", "llc", "ltd", "nv", "plc", "sa", "sas")
HINT_SUFFIXES = (*LEGAL_SUFFIXES, "us", "usa")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def collapse(c) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def case_key(c) -> Column:
    return F.lower(collapse(c))


def punctuation_key(c) -> Column:
    return F.trim(F.regexp_replace(case_key(c), "[^a-z0-9]+", " "))


def company_key(c, suffixes=LEGAL_SUFFIXES) -> Column:
    """The punctuation key without corporate forms, unless nothing else would be left."""
    tokens = F.split(punctuation_key(c), " ")
    kept = F.filter(tokens, lambda t: ~t.isin(*suffixes))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(tokens), " ")


def unspaced(c) -> Column:
    return F.upper(F.regexp_replace(col(c), r"(?U)\s", ""))


def canonical_mpn(c) -> Column:
    return F.nullif(unspaced(c), F.lit(""))


def canonical_brand(c) -> Column:
    return F.nullif(F.upper(collapse(c)), F.lit(""))


def tokens(c) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def without_prefix(words: Column, prefix: Column) -> Column:
    """words without prefix, where they begin with all of it."""
    fits = (F.size(prefix) > 0) & (F.slice(words, 1, F.greatest(F.size(prefix), F.lit(1))) == prefix)
    return F.when(fits, F.slice(words, F.size(prefix) + 1, F.greatest(F.size(words), F.lit(1)))).otherwise(words)


def has_phrase(words: Column, phrase: str) -> Column:
    """Whether the words of phrase stand in words side by side."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(f" {phrase} ")


def normalize_host(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"\.+$", ""), r"^www\.", "")


def url_host(c) -> Column:
    """Host of a URL, without user and port; empty where there is none."""
    return F.coalesce(normalize_host(F.regexp_extract(col(c), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def url_path(c) -> Column:
    return F.coalesce(F.regexp_extract(col(c), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and each domain it is in: a.b.c, b.c, c. An equi-join on these replaces a suffix comparison."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))


def line_endings(c) -> Column:
    return F.regexp_replace(col(c), "\r\n?", "\n")


def contains_reference(text, mpn) -> Column:
    """A literal that stands alone: neither a letter nor a digit beside it, in any case of letters."""
    quoted = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])\Q"), F.replace(col(mpn), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
    return F.rlike(col(text), quoted)


def contains_phrase(text, phrase) -> Column:
    """A whole phrase: beside it no letter or digit, nor any of - / _ +."""
    quoted = F.concat(F.lit(r"(?U)(?<![\p{Alnum}\-/_+])\Q"), F.replace(col(phrase), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{Alnum}\-/_+])"))
    return F.rlike(col(text), quoted)


def excerpt(text, at, around: int = 60, length=0) -> Column:
    """The text around a 1-based place."""
    first = F.greatest(F.lit(1), col(at) - around)
    return F.substring(col(text), first, col(at) + length + around - first)


def format_g(c) -> Column:
    """A number as %g writes it: six digits, plain for magnitudes from 1e-4 to 1e6, else with an exponent; no zeros at the end. Halves are rounded up."""
    x = col(c).cast("double")
    wide = F.format_string("%.5e", x)
    e = F.regexp_extract(wide, r"e([+-]\d+)$", 1).try_cast("int")
    bare = lambda text: F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    fixed = F.when(e == 5, F.format_string("%.0f", x))
    for d in range(1, 10):
        fixed = fixed.when(e == 5 - d, F.format_string(f"%.{d}f", x))
    parts = F.concat(bare(F.regexp_extract(wide, r"^(.*)e", 1)), F.regexp_extract(wide, r"(e[+-]\d+)$", 1))
    special = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(x == 0, "0")
    return F.when(special.isNotNull(), special).otherwise(F.when((e < -4) | (e > 5), parts).otherwise(bare(fixed)))


_INVISIBLE = dict.fromkeys(map(ord, "​‌‍⁠﻿"))


@F.pandas_udf(StringType())
def search_text(texts: pd.Series) -> pd.Series:
    """Compatibility form, without invisible characters, one space between words, case folded."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).translate(_INVISIBLE).split()).casefold())


def clean(c: str, bare_dash: bool = False) -> Column:
    """The usable value of a raw field: null if blank or a placeholder."""
    return F.when((strip(c) == "") | is_placeholder(c, bare_dash), F.lit(None).cast("string")).otherwise(strip(c))


def is_placeholder(c, bare_dash: bool = False) -> Column:
    hit = F.rlike(strip(c), F.lit(r"^--\s*.*?\s*--$"))
    return hit | (strip(c) == "-") if bare_dash else hit


def host_covered_by(host: Column, domain: Column) -> Column:
    h, d = normalize_host(host), normalize_host(domain)
    return (h != "") & (d != "") & ((h == d) | F.endswith(h, F.concat(F.lit("."), d)))


# Fixed value: the punctuation that separates the tokens of class names.
CLASS_PUNCTUATION = ",;/()[]{}-_+.:\\\"'"


def class_tokens(c) -> Column:
    """The distinct words of two or more characters of a class name or phrase."""
    plain = F.lower(F.translate(col(c), CLASS_PUNCTUATION, " " * len(CLASS_PUNCTUATION)))
    return F.array_distinct(F.filter(F.split(collapse(plain), " "), lambda t: F.length(t) > 1))


@F.pandas_udf(StringType())
def prepared(texts: pd.Series) -> pd.Series:
    """Compatibility form, one plain space between words, case folded; invisible characters stay."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold())


@F.pandas_udf(StringType())
def fold_case(texts: pd.Series) -> pd.Series:
    """Full case folding; lower() leaves letters like the sharp s as they are."""
    return texts.map(lambda t: None if t is None else t.casefold())


def same_without_spaces(a, b) -> Column:
    return F.regexp_replace(col(a), r"(?U)\s", "") == F.regexp_replace(col(b), r"(?U)\s", "")


def spaced_pattern(mpn) -> Column:
    """A pattern for a reference with white space anywhere between its characters."""
    quoted = F.transform(F.filter(F.split(canonical_mpn(mpn), ""), lambda x: x != ""), lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E")))
    return F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])"), F.array_join(quoted, r"\s*"), F.lit(r"(?![A-Za-z0-9])"))
