"""Source discovery: whose site a URL is on, what it is about, in which order to try it, and what became of a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.functions import text as T

# Orders of preference.
AUTHORITIES = ("APPROVED_MANUFACTURER", "UNVERIFIED_MANUFACTURER", "OTHER_MANUFACTURER", "UNKNOWN", "KNOWN_DISTRIBUTOR", "KNOWN_MARKETPLACE", "BLOCKED")
RELEVANCES = ("EXACT", "FAMILY_ONLY", "SIBLING", "AMBIGUOUS", "ABSENT")
KINDS = ("DATASHEET", "CATALOG", "PRODUCT_PAGE", "MANUAL", "UNKNOWN")
STEM = 5


def order_of(c: str, members: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, members)), F.col(c))


def with_owner(df: DataFrame, registry: DataFrame, host: str = "host") -> DataFrame:
    """Adds role, owner, licensed of the most specific registered domain the host is in; null where none is.

    registry: (domain, role, owner, licensed), role one of MANUFACTURER, DISTRIBUTOR,
    MARKETPLACE, BLOCKED. Hosts are joined once for each distinct host, on their suffixes.
    Blocking wins over every other role, whatever the domains.
    """
    hosts = df.select(host).distinct()
    pairs = hosts.withColumn("domain", F.explode(T.host_suffixes(F.col(host)))).join(registry, "domain")
    rank = F.when(F.col("role") == "BLOCKED", 0).when(F.col("role") == "MANUFACTURER", 1).when(F.col("role") == "MARKETPLACE", 2).otherwise(3)
    best = Window.partitionBy(host).orderBy(rank, F.length("domain").desc(), "domain")
    owners = pairs.withColumn("rn", F.row_number().over(best)).where("rn = 1").select(host, "role", "owner", "licensed")
    return df.join(owners, host, "left")


def authority(hint: Column) -> Column:
    """After with_owner(): the site's standing for a manufacturer hint (null: none)."""
    return (
        F.when(F.col("host") == "", "UNKNOWN")
        .when(F.col("role") == "BLOCKED", "BLOCKED")
        .when((F.col("role") == "MANUFACTURER") & ~F.coalesce(F.col("owner") == hint, F.lit(False)), "OTHER_MANUFACTURER")
        .when((F.col("role") == "MANUFACTURER") & F.col("licensed"), "APPROVED_MANUFACTURER")
        .when(F.col("role") == "MANUFACTURER", "UNVERIFIED_MANUFACTURER")
        .when(F.col("role") == "MARKETPLACE", "KNOWN_MARKETPLACE")
        .when(F.col("role") == "DISTRIBUTOR", "KNOWN_DISTRIBUTOR")
        .otherwise("UNKNOWN")
    )


def relevance_texts(url: Column, title: Column) -> Column:
    """Title, decoded path segments, query values and fragment; never the host."""
    decode = lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    query = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    values = F.transform(query, lambda q: F.regexp_extract(q, "=(.*)", 1))
    parts = F.concat(F.split(T.url_path(url), "/"), values, F.array(F.regexp_extract(url, "#(.*)$", 1)))
    return F.concat(F.array(F.coalesce(title, F.lit(""))), F.transform(F.filter(parts, lambda x: x != ""), decode))


def prefix_length(a: Column, b: Column) -> Column:
    """Length of the shared beginning."""
    n = F.least(F.length(a), F.length(b))
    step = lambda acc, i: F.when((acc == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(acc)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)).otherwise(0)


def relevance(texts: Column, mpn: Column) -> Column:
    """EXACT, AMBIGUOUS (two siblings), SIBLING, FAMILY_ONLY or ABSENT."""
    target = T.canonical_mpn(mpn)
    words = F.array_distinct(F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(F.upper(t), F.lit("[A-Z0-9]+"), F.lit(0)))))
    others = F.filter(words, lambda w: (F.length(w) >= STEM) & (w != target))
    families = F.filter(others, lambda w: F.startswith(target, w))
    siblings = F.filter(others, lambda w: ~F.startswith(target, w) & (prefix_length(w, target) >= STEM))
    return (
        F.when(target.isNull(), "ABSENT")
        .when(F.exists(texts, lambda t: T.contains_reference(t, target)) | F.array_contains(words, target), "EXACT")
        .when(F.size(siblings) > 1, "AMBIGUOUS")
        .when(F.size(siblings) == 1, "SIBLING")
        .when(F.size(families) > 0, "FAMILY_ONLY")
        .otherwise("ABSENT")
    )


def kind(url: Column, title: Column, catalog=("catalog", "catalogue"), manual=("manual", "instruction"), datasheet=("datasheet", "data-sheet", "spec-sheet")) -> Column:
    """What a source seems to be; hints are injected, and no claim about its standing."""
    text, path = F.lower(F.concat_ws(" ", url, title)), F.lower(T.url_path(url))
    has = lambda words: F.rlike(text, F.lit("|".join(words)))
    return F.when(has(catalog), "CATALOG").when(has(manual), "MANUAL").when(has(datasheet) | F.endswith(path, F.lit(".pdf")), "DATASHEET").when(path.contains("/product"), "PRODUCT_PAGE").otherwise("UNKNOWN")


def rejections() -> Column:
    """Every reason against a candidate, authority before relevance; wants columns authority and relevance."""
    a, r = F.col("authority"), F.col("relevance")
    reasons = F.array(
        F.when(a.isin("BLOCKED", "UNKNOWN"), "DOMAIN_NOT_APPROVED").when(a == "KNOWN_MARKETPLACE", "MARKETPLACE_SOURCE").when(a == "KNOWN_DISTRIBUTOR", "DISTRIBUTOR_SOURCE").when(a == "OTHER_MANUFACTURER", "OTHER_MANUFACTURER_DOMAIN").when(a == "UNVERIFIED_MANUFACTURER", "AUTHORITY_NOT_ESTABLISHED"),
        F.when(r == "FAMILY_ONLY", "FAMILY_ONLY").when(r == "SIBLING", "SIBLING_REFERENCE").when(r == "AMBIGUOUS", "AMBIGUOUS_REFERENCE").when(r == "ABSENT", "MPN_ABSENT"),
    )
    return F.filter(reasons, lambda x: x.isNotNull())


def ranked(df: DataFrame, by: list[str], rank: str, url: str) -> DataFrame:
    """Adds position under the total order authority, relevance, kind, provider rank, URL."""
    order = [order_of("authority", AUTHORITIES), order_of("relevance", RELEVANCES), order_of("kind", KINDS), F.col(rank), F.col(url)]
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def within_budget(df: DataFrame, by: list[str], budget: int = 3) -> DataFrame:
    """Adds fetch: FETCH for the first eligible candidates in order, FETCH_BUDGET_EXHAUSTED after, NOT_ELIGIBLE."""
    eligible = ((F.col("authority") == "APPROVED_MANUFACTURER") & (F.col("relevance") == "EXACT")).cast("int")
    so_far = F.sum(eligible).over(Window.partitionBy(*by).orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("fetch", F.when(eligible == 0, "NOT_ELIGIBLE").when(so_far <= budget, "FETCH").otherwise("FETCH_BUDGET_EXHAUSTED"))


def diagnose(df: DataFrame, by: list[str]) -> DataFrame:
    """The one most useful thing to say about each search, from its candidates (authority, relevance)."""
    a, r = F.col("authority"), F.col("relevance")
    approved = a == "APPROVED_MANUFACTURER"
    flags = df.groupBy(*by).agg(
        F.bool_or(approved & (r == "EXACT")).alias("eligible"),
        F.bool_or(a == "UNVERIFIED_MANUFACTURER").alias("unverified"),
        F.bool_or(approved).alias("approved"),
        F.coalesce(F.bool_and(F.when(approved, r == "FAMILY_ONLY")), F.lit(False)).alias("family"),
        F.coalesce(F.bool_and(F.when(approved, r == "SIBLING")), F.lit(False)).alias("sibling"),
        F.bool_and(a == "KNOWN_DISTRIBUTOR").alias("distributors"),
        F.bool_and(a == "KNOWN_MARKETPLACE").alias("marketplaces"),
        F.count(F.lit(1)).alias("candidates"),
    )
    c = F.col
    outcome = (
        F.when(c("eligible"), "ELIGIBLE_NOT_ACQUIRED").when(c("unverified"), "DOMAIN_REVIEW_REQUIRED")
        .when(c("approved"), F.when(c("family"), "FAMILY_ONLY").when(c("sibling"), "SIBLING_ONLY").otherwise("NO_EXACT_MPN"))
        .when(c("distributors"), "ONLY_DISTRIBUTORS").when(c("marketplaces"), "ONLY_MARKETPLACES").otherwise("NO_MANUFACTURER_DOMAIN")
    )
    return flags.select(*by, outcome.alias("outcome"), "candidates")


def url_structure(url: Column) -> Column:
    """OK, or why a URL may not be fetched: scheme, host, or an address that isn't public.

    A host is a name with a letter in its last label, or a dotted quad of decimal numbers. Other
    spellings of an address (IPv6 in brackets, one number, octal or hexadecimal parts, fewer
    parts) are refused, for what they reach isn't told apart here.
    """
    host = T.url_host(url)
    octet = lambda i: F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int")
    a, b = octet(1), octet(2)
    quad = F.rlike(host, F.lit(r"^(?:(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])(?:\.|$)){4}$")) & ~host.endswith(".")
    last = F.regexp_extract(host, r"([^.]*)\.?$", 1)
    name = F.rlike(last, F.lit(r"[a-z]|[^\x00-\x7f]")) & ~F.rlike(last, F.lit("^0x[0-9a-f]*$")) & ~F.rlike(host, F.lit(r"[\[\]%\s]"))
    private = (a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)))
    return (
        F.when(~F.rlike(F.coalesce(url, F.lit("")), F.lit(r"(?i)^https?://")), "SCHEME_NOT_ALLOWED")
        .when(host == "", "HOST_MISSING")
        .when((host == "localhost") | F.endswith(host, F.lit(".localhost")), "LOCALHOST")
        .when(F.coalesce(private, F.lit(False)), "PRIVATE_ADDRESS")
        .when(~(quad | name), "ADDRESS_NOT_PARSED")
        .otherwise("OK")
    )
