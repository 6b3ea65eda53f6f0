"""Catalogue operators: cleaning, parsing, staged lookup, brand and manufacturer decisions, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.functions import text as T

FIELDS = ("Mfg_Part_Num", "Part_Desc", "E1_Brand", "Unilog_Brand", "DIB_Brand", "Part_Manuf")
BRANDS = ("E1_Brand", "Unilog_Brand", "DIB_Brand")


def cleaned(df: DataFrame) -> DataFrame:
    """Adds clean_<field> for the six fields; a lone dash is a placeholder in Part_Manuf only."""
    return df.withColumns({f"clean_{c}": T.clean(c, c == "Part_Manuf") for c in FIELDS})


def balanced(c: Column) -> Column:
    """Whether every parenthesis closes one that is open."""
    step = lambda acc, ch: F.struct(
        (acc["d"] + F.when(ch == "(", 1).when(ch == ")", -1).otherwise(0)).alias("d"),
        (acc["ok"] & (acc["d"] + F.when(ch == ")", -1).otherwise(0) >= 0)).alias("ok"),
    )
    marks = F.split(F.regexp_replace(c, "[^()]", ""), "")
    return F.aggregate(marks, F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), step, lambda acc: acc["ok"] & (acc["d"] == 0))


def parse_manufacturer(df: DataFrame, c: str = "Part_Manuf") -> DataFrame:
    """Adds manuf_status, manuf_name, manuf_code from `Name (CODE)`."""
    s = T.strip(F.coalesce(F.col(c), F.lit("")))
    name = T.strip(F.regexp_extract(s, r"(?s)^(.*?)\s*\(([^()]*)\)$", 1))
    code = T.strip(F.regexp_extract(s, r"(?s)^(.*?)\s*\(([^()]*)\)$", 2))
    trailing = F.rlike(s, F.lit(r"(?s)^(.*?)\s*\(([^()]*)\)$"))
    status = (
        F.when(s == "", "MISSING")
        .when(T.is_placeholder(s, True), "PLACEHOLDER")
        .when(~balanced(s), "UNRESOLVED")
        .when(~trailing, "NAME_ONLY")
        .when((name == "") | (code == ""), "UNRESOLVED")
        .otherwise("NAME_WITH_CODE")
    )
    none = F.lit(None).cast("string")
    out = df.withColumn("manuf_status", status)
    st = F.col("manuf_status")
    return out.withColumns({
        "manuf_name": F.when(st == "NAME_WITH_CODE", name).when(st == "NAME_ONLY", s).otherwise(none),
        "manuf_code": F.when(st == "NAME_WITH_CODE", code).otherwise(none),
    })


#: Stages in order: the first in which anything matches decides.
STAGES = ("EXACT", "WHITESPACE_NORMALIZED", "CASE_NORMALIZED", "PUNCTUATION_NORMALIZED", "LEGAL_SUFFIX_NORMALIZED")


def _stage_keys(c) -> list[Column]:
    return [T.col(c), T.collapse(c), T.case_key(c), T.punctuation_key(c), T.company_key(c)]


def staged_lookup(df: DataFrame, value: str, rules: DataFrame, id_col: str) -> DataFrame:
    """(id_col, stage, reason, canonical) of each row of df with a value.

    rules has canonical, alias (the canonical value itself among them) and is_alias. All
    stages are one equi-join on (stage, key); the smallest stage with a hit decides, and
    more than one canonical value in it is ambiguous, whatever later stages say.
    """
    keyed = lambda d, c, *keep: d.select(*keep, F.posexplode(F.array(*_stage_keys(c))).alias("stage", "key")).where("key IS NOT NULL AND key <> ''")
    right = keyed(rules, "alias", "canonical", "is_alias").distinct()
    hits = keyed(df, value, id_col).join(right, ["stage", "key"])
    first = hits.groupBy(id_col, "stage").agg(F.count_distinct("canonical").alias("n"), F.min("canonical").alias("canonical"), F.bool_and("is_alias").alias("by_alias"))
    best = first.withColumn("rn", F.row_number().over(Window.partitionBy(id_col).orderBy("stage"))).where("rn = 1").drop("rn")
    names = F.array(*map(F.lit, STAGES))
    reason = F.when(F.col("n") > 1, "AMBIGUOUS_ALIAS").when((F.col("stage") == 0) & F.col("by_alias"), "EXACT_ALIAS").otherwise(F.get(names, F.col("stage")))
    out = best.select(id_col, "stage", reason.alias("reason"), F.when(F.col("n") == 1, F.col("canonical")).alias("canonical"))
    missing = F.coalesce("reason", F.lit("UNKNOWN_MANUFACTURER"))
    return df.select(id_col).join(out, id_col, "left").withColumn("reason", missing)


def brand_consensus(df: DataFrame) -> DataFrame:
    """Adds brand, brand_decision, brand_reason from the cleaned brand fields; wants cleaned()."""
    usable = F.filter(F.array(*[F.col(f"clean_{c}") for c in BRANDS]), lambda x: x.isNotNull())
    keys = F.array_distinct(F.transform(usable, T.punctuation_key))
    placeholder = F.lit(False)
    for c in BRANDS:
        placeholder = placeholder | F.coalesce(T.is_placeholder(c), F.lit(False))
    n, k = F.size(usable), F.size(keys)
    reason = (
        F.when(n == 0, F.when(placeholder, "PLACEHOLDER").otherwise("MISSING_VALUE"))
        .when((n > 1) & (k == 1), "BRAND_SOURCE_CONSENSUS")
        .when(k > 1, "CONFLICTING_BRAND_SOURCES")
        .otherwise("SINGLE_BRAND_SOURCE")
    )
    decision = F.when(n == 0, "WITHHOLD").when((n > 1) & (k == 1), "COMMIT").otherwise("REVIEW")
    return df.withColumns({"brand_decision": decision, "brand_reason": reason, "brand": F.when(k == 1, F.get(usable, F.lit(0)))})


def classify(df: DataFrame, cues: list[tuple[str, tuple[str, ...]]], precedence: tuple[tuple[str, str], ...] = (), few: int = 2) -> DataFrame:
    """Adds family, class_decision, class_reason and candidates.

    cues: (family, phrases that must all occur), injected; a closed vocabulary, so it is
    an expression and not a join. precedence: (specific, general) pairs of families.
    """
    words = T.tokens(F.coalesce(F.col("Part_Desc"), F.lit("")))
    content = T.without_prefix(words, T.tokens(F.coalesce(F.col("Mfg_Part_Num"), F.lit(""))))
    by_family: dict[str, Column] = {}
    for family, phrases in cues:
        hit = F.lit(True)
        for p in phrases:
            hit = hit & T.has_phrase(F.col("_words"), p)
        by_family[family] = by_family.get(family, F.lit(False)) | hit
    df = df.withColumns({"_words": words, "_content": F.size(content)})
    df = df.withColumn("_hits", F.filter(F.array(*[F.when(c, F.lit(f)) for f, c in sorted(by_family.items())]), lambda x: x.isNotNull()))
    families, applied = F.col("_hits"), F.lit(False)
    for specific, general in precedence:
        both = F.array_contains(F.col("_hits"), specific) & F.array_contains(F.col("_hits"), general)
        families, applied = F.when(both, F.array_remove(families, general)).otherwise(families), applied | both
    df = df.withColumns({"_families": families, "_applied": applied})
    n, held = F.size("_families"), T.is_placeholder(F.coalesce(F.col("Part_Desc"), F.lit("")))
    return df.withColumns({
        "family": F.when(~held & (n == 1), F.get("_families", F.lit(0))).otherwise("UNKNOWN"),
        "class_decision": F.when(held, "WITHHOLD").when(n == 1, "COMMIT").when(n > 1, "REVIEW").otherwise("WITHHOLD"),
        "class_reason": F.when(held, "PLACEHOLDER_DESCRIPTION")
        .when(n == 1, F.when(F.col("_applied"), "SPECIFIC_FAMILY_PRECEDENCE").otherwise("STRONG_LEXICAL_CUE"))
        .when(n > 1, "OVERLAPPING_FAMILY_CUES")
        .when(F.col("_content") <= few, "INSUFFICIENT_DESCRIPTION")
        .otherwise("NO_FAMILY_CUE"),
        "candidates": F.when(held, F.lit("")).otherwise(F.array_join("_families", ",")),
    }).drop("_words", "_content", "_hits", "_families", "_applied")


def zero_filled(df: DataFrame, c: str, members: list[str]) -> DataFrame:
    """(member, n): a row for each member of a closed vocabulary, even if none has it."""
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    known = df.sparkSession.createDataFrame([(m,) for m in members], f"{c} string")
    return known.join(F.broadcast(counts.where(F.col(c).isin(members))), c, "left").select(F.col(c).alias("member"), F.coalesce("n", F.lit(0)).alias("n"))


def first_per(df: DataFrame, key: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key under a total order."""
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("position", rn).where(F.col("position") <= n)


def build_queries(df: DataFrame) -> DataFrame:
    """Adds queries: at most four search strings, repeats dropped, in order."""
    q = lambda c: F.concat(F.lit('"'), T.collapse(F.replace(F.col(c), F.lit('"'), F.lit(" "))), F.lit('"'))
    sites = F.transform(F.slice("domains", 1, 2), lambda d: F.concat(F.lit("site:"), d, F.lit(" "), q("mpn")))
    rest = F.array(F.concat_ws(" ", q("manufacturer"), q("mpn")), F.concat_ws(" ", q("mpn"), F.lit("datasheet")), F.concat_ws(" ", q("brand"), q("mpn")))
    return df.withColumn("queries", F.slice(F.array_distinct(F.filter(F.concat(sites, rest), lambda x: x.isNotNull())), 1, 4))


def manufacturer_decisions(df: DataFrame, rules: DataFrame, id_col: str, deliverable: bool = True) -> DataFrame:
    """df with manuf_decision, manuf_reason, manuf_canonical: parse, look up stage by stage, decide."""
    parsed = parse_manufacturer(df)
    found = staged_lookup(parsed.select(id_col, "manuf_name"), "manuf_name", rules, id_col).select(id_col, "stage", "reason", "canonical")
    out = parsed.join(found, id_col)
    status = F.col("manuf_status")
    reason = F.when(status == "MISSING", "MISSING_VALUE").when(status == "PLACEHOLDER", "PLACEHOLDER").when(status == "UNRESOLVED", "AMBIGUOUS_MANUFACTURER").otherwise(F.col("reason"))
    decision = F.when(status.isin("MISSING", "PLACEHOLDER", "UNRESOLVED"), "WITHHOLD").when(F.col("canonical").isNotNull() & F.lit(deliverable), "COMMIT").otherwise("REVIEW")
    return out.withColumns({"manuf_decision": decision, "manuf_reason": reason}).withColumnRenamed("canonical", "manuf_canonical").drop("stage", "reason")


def exact_examples(df: DataFrame, examples: DataFrame) -> DataFrame:
    """df with delivery COMMIT or WITHHOLD: a row equals an example in all six raw fields. examples: the fields and classpath."""
    one = examples.groupBy(*FIELDS).agg(F.min("classpath").alias("classpath"), F.count_distinct("classpath").alias("n")).where("n = 1").drop("n")
    out = df.join(one, list(FIELDS), "left")
    return out.withColumn("delivery", F.when(F.col("classpath").isNotNull(), "COMMIT").otherwise("WITHHOLD"))


def slot_profile(examples: DataFrame, record: str) -> DataFrame:
    """(slot, label, uom) that all examples share; uom only where all agree on one that isn't blank. examples: record, slot, label, uom.

    Raises in the job if the label sequences differ.
    """
    sequences = examples.where("label IS NOT NULL").groupBy(record).agg(F.array_sort(F.collect_list(F.struct("slot", "label"))).alias("seq"))
    same = sequences.agg(F.count_distinct("seq").alias("n")).select(F.assert_true(F.col("n") <= 1, F.lit("examples do not share one label sequence")).alias("ok"))
    slots_ = examples.where("label IS NOT NULL").groupBy("slot", "label").agg(F.min(F.coalesce("uom", F.lit(""))).alias("lo"), F.max(F.coalesce("uom", F.lit(""))).alias("hi"))
    out = slots_.select("slot", "label", F.when((F.col("lo") == F.col("hi")) & (F.col("lo") != ""), F.col("lo")).alias("uom"))
    return out.join(F.broadcast(same), F.col("ok").isNull()).drop("ok")
