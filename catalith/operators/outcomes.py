"""What comes out of analysed rows and rule tables: grid outcomes, exports, upload checks, who may license, run totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.text import strip

# Limits of an uploaded file, and of patterns in one search corpus.
MAX_FILE_BYTES = 5 * 1024 * 1024
MAX_PATTERNS = 50
# The outcomes that a grid filters by.
OUTCOMES = ("ALL", "ANALYZED", "VERIFIED", "PARTIAL", "BLOCKED", "REVIEW", "NO_EVIDENCE")
# Analysis request fields and the catalogue columns that they come from.
REQUEST = {"mpn": "Mfg_Part_Num", "description": "Part_Desc", "e1_brand": "E1_Brand", "unilog_brand": "Unilog_Brand", "dib_brand": "DIB_Brand", "manufacturer": "Part_Manuf"}


# --- grid -----------------------------------------------------------------------
def cell_texts(df: DataFrame) -> DataFrame:
    """Every column as trimmed text: null is empty, a date or time its ISO day in the session's time zone."""
    text = lambda c, t: F.date_format(c, "yyyy-MM-dd") if t in ("date", "timestamp", "timestamp_ntz") else strip(c.cast("string"))
    return df.select(*[F.coalesce(text(F.col(f"`{c.replace('`', '``')}`"), t), F.lit("")).alias(c) for c, t in df.dtypes])


def analyze_request(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(source).alias(field) for field, source in REQUEST.items()])


def known_case(rows: DataFrame, cases: DataFrame, mpn: str) -> DataFrame:
    """Adds case, the recorded case of the row's number (trimmed, upper case), else null. cases: mpn, case; the smallest case counts."""
    own = cases.groupBy(F.upper(strip("mpn")).alias("_key")).agg(F.min("case").alias("case"))
    return rows.withColumn("_key", F.upper(strip(mpn))).join(own, "_key", "left").drop("_key")


def outcome_matches(outcome: str) -> Column:
    """Whether a row is among those of an outcome.

    Columns: analyzed, detailed (the analysis didn't fail), statuses (of the timeline's steps),
    verified, withheld (counts), discovery_status. A row without an analysis only matches ALL,
    a failed one ANALYZED and PARTIAL too.
    """
    c = F.col
    has = lambda *names: F.arrays_overlap(F.coalesce("statuses", F.array().cast("array<string>")), F.array(*map(F.lit, names)))
    some = lambda n: F.coalesce(c(n), F.lit(0)) > 0
    detailed = {
        "VERIFIED": some("verified"),
        "PARTIAL": has("NOT_RUN"),
        "BLOCKED": has("BLOCKED"),
        "REVIEW": some("withheld") | has("REVIEW", "WITHHELD"),
        "NO_EVIDENCE": (c("discovery_status") == "NOT_RUN") & ~some("verified"),
    }
    if outcome == "ALL":
        return F.lit(True)
    if outcome == "ANALYZED":
        return F.coalesce("analyzed", F.lit(False))
    hit = F.when(c("detailed"), detailed[outcome]).otherwise(outcome == "PARTIAL")
    return F.coalesce(c("analyzed") & hit, F.lit(False))


def upload_problem(name, size) -> Column:
    """Why a file isn't taken, before it is read: WRONG_FILE_TYPE, OVERSIZED_FILE or EMPTY_FILE; else null."""
    kind = F.lower(F.substring_index(name, ".", -1))
    return F.when(~F.coalesce(kind.isin("csv", "xlsx"), F.lit(False)), "WRONG_FILE_TYPE").when(F.col(size) > MAX_FILE_BYTES, "OVERSIZED_FILE").when(F.coalesce(size, F.lit(0)) == 0, "EMPTY_FILE")


# --- exports --------------------------------------------------------------------
def verified_facts(results: DataFrame) -> DataFrame:
    """A row for each verified fact. results: mpn, verified (array of struct(label, value, uom, authority, status, delivery_eligible, mapping_status))."""
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = results.select(text("mpn").alias("mpn"), F.explode("verified").alias("f"))
    delivery = F.when(F.col("f.delivery_eligible"), "AUTHORIZED").otherwise(F.col("f.mapping_status"))
    return rows.select("mpn", *[text(f"f.{c}").alias(c) for c in ("label", "value", "uom", "authority", "status")], text(delivery).alias("delivery"))


def csv_line(columns: list) -> Column:
    """A line of a delimited file, without its end: fields with a quote, comma or line break are quoted; null is empty."""
    quoted = lambda x: F.when(F.rlike(x, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    return F.concat_ws(",", *[quoted(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


# --- rule tables -----------------------------------------------------------------
def licenses(authority, reviewed) -> Column:
    """Whether an entry may license evidence: all of an OFFICIAL registry's may, of a REVIEWED one's those with a review."""
    return F.coalesce((F.col(authority) == "OFFICIAL") | ((F.col(authority) == "REVIEWED") & F.col(reviewed)), F.lit(False))


def corpus_patterns(entries: DataFrame) -> DataFrame:
    """(key, pattern): every domain of the entries that license. More than a corpus takes is an error; none is left out.

    entries: key, domains, authority, reviewed.
    """
    out = entries.where(licenses("authority", "reviewed")).select("key", F.explode("domains").alias("domain"))
    out = out.select("key", F.concat(F.col("domain"), F.lit("/*")).alias("pattern"))
    if out.limit(MAX_PATTERNS + 1).count() > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns: split the domains over several corpora")
    return out


def authoritative(rules: DataFrame, registries: DataFrame) -> DataFrame:
    """(registry, authoritative): it has rules, and all are OFFICIAL. rules: registry, authority."""
    official = F.coalesce(F.col("authority") == "OFFICIAL", F.lit(False))
    sums = rules.groupBy("registry").agg(F.bool_and(official).alias("_all"))
    return registries.select("registry").join(sums, "registry", "left").select("registry", F.coalesce("_all", F.lit(False)).alias("authoritative"))


# --- evidence ---------------------------------------------------------------------
def identity_refusal(disposition, mpn) -> Column:
    """IDENTITY_NOT_EXACT where extraction may not go on, else null."""
    return F.when(~F.coalesce((F.col(disposition) == "EXACT") & (F.col(mpn) != ""), F.lit(False)), "IDENTITY_NOT_EXACT")


def establishes_scope(scope, proves_family) -> Column:
    """Whether a span pins its value to the product: an exact number's, or a family's that itself proves the whole family."""
    return F.coalesce((F.col(scope) == "EXACT_SKU") | ((F.col(scope) == "FAMILY") & F.col(proves_family)), F.lit(False))


def is_structured(modality) -> Column:
    return F.coalesce(F.col(modality).isin("STRUCTURED_API", "SPEC_TABLE", "SPEC_LINE"), F.lit(False))


def integer_or(c, default: int) -> Column:
    """Trimmed text as a 32-bit whole number, else the default."""
    return F.coalesce(strip(c).try_cast("int"), F.lit(default))


# --- run totals ---------------------------------------------------------------------
def run_totals(rows: DataFrame) -> DataFrame:
    """One row of sums over a run's rows.

    rows: requested, executed (arrays), results, candidates (array of struct(authority, relevance,
    licensing)), attempts, successes, artifacts. A null list or count adds nothing; no rows give zeros.
    """
    size = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)), F.lit(0)).cast("long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    those = lambda test: F.coalesce(F.sum(F.coalesce(F.when(F.col("candidates").isNotNull(), F.size(F.filter("candidates", test))), F.lit(0))), F.lit(0)).cast("long")
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), size("requested").alias("queries"), size("executed").alias("provider_queries"), total("results").alias("results"), size("candidates").alias("candidates"),
        those(lambda x: x["authority"].isin("APPROVED_MANUFACTURER", "UNVERIFIED_MANUFACTURER")).alias("manufacturer_hosts"), those(lambda x: x["relevance"] == "EXACT").alias("exact"), those(lambda x: x["licensing"]).alias("licensing"),
        total("attempts").alias("fetch_attempts"), total("successes").alias("fetch_successes"), total("artifacts").alias("artifacts"),
    )
