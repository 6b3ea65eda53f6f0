"""Evidence operators: identity, verification, adjudication, conflicts, slots, and wide records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def identity(products: DataFrame, exact: DataFrame, completions: DataFrame, mappings: DataFrame, others: DataFrame) -> DataFrame:
    """products (brand, mpn, code) with disposition, exact_mpn and ignored.

    exact (brand, mpn, exact_mpn), completions (brand, mpn, key), mappings (brand, mpn, code,
    exact_mpn); others (brand, mpn) counts facts of the same number under another brand. Each
    side is summed by its key before it is joined, so a hot product number is one row.
    """
    by = ["brand", "mpn"]
    e = exact.groupBy(*by).agg(F.count_distinct("exact_mpn").alias("targets"), F.min("exact_mpn").alias("target"))
    c = completions.groupBy(*by).agg(F.count_distinct("key").alias("keys"))
    m = mappings.groupBy(*by, "code").agg(F.count_distinct("exact_mpn").alias("built"), F.min("exact_mpn").alias("full"))
    all_ = others.groupBy("mpn").agg(F.count(F.lit(1)).alias("everywhere"))
    own = others.groupBy(*by).agg(F.count(F.lit(1)).alias("here"))
    df = products.join(e, by, "left").join(c, by, "left").join(m, [*by, "code"], "left").join(all_, "mpn", "left").join(own, by, "left")
    has = lambda x: F.col(x).isNotNull()
    disposition = (
        F.when(has("targets") & has("keys"), "CONTRADICTORY")
        .when(F.col("targets") > 1, "CONTRADICTORY")
        .when(has("targets"), "EXACT")
        .when(has("keys") & (F.col("keys") == 1) & (F.col("built") == 1), "EXACT")
        .when(has("keys") & (F.col("built") > 1), "CONTRADICTORY")
        .when(has("keys"), "FAMILY_OR_INCOMPLETE")
        .otherwise("UNKNOWN")
    )
    df = df.withColumn("disposition", disposition)
    found = F.when(F.col("disposition") == "EXACT", F.coalesce("target", "full"))
    return df.select(*products.columns, "disposition", found.alias("exact_mpn"), (F.coalesce("everywhere", F.lit(0)) - F.coalesce("here", F.lit(0))).alias("ignored"))


def support_grade(verified: Column, in_scope: Column, *strengths: Column) -> Column:
    """A, B or C by how many strengths are missing (none, one, more); null without a verified span in scope."""
    missing = sum(((~F.coalesce(s, F.lit(False))).cast("int") for s in strengths), F.lit(0))
    return F.when(F.coalesce(verified & in_scope, F.lit(False)), F.when(missing == 0, "A").when(missing == 1, "B").otherwise("C"))


def adjudicate(outcomes: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds decision and reason of verified facts under mapping rules; the first refusal in order counts.

    outcomes: identity_exact, verified, source_key, kind, conditions (map), unit.
    rules: source_key, target, priority, expected_kind, policy, required (map), target_unit.
    """
    df = outcomes.join(rules, "source_key", "left")
    same = lambda a, b: F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))
    none = F.size(F.coalesce("conditions", F.create_map().cast("map<string,string>"))) == 0
    kept = F.when(F.col("policy") == "PRESERVE", F.lit(True)).when(F.col("policy") == "ENCODES", F.coalesce(same("conditions", "required"), F.lit(False))).otherwise(none)
    c = F.col
    refusal = (
        F.when(~c("identity_exact"), F.struct(F.lit("WITHHOLD").alias("d"), F.lit("IDENTITY_NOT_EXACT").alias("r")))
        .when(~c("verified"), F.struct(F.lit("WITHHOLD").alias("d"), F.lit("VERIFICATION_FAILED").alias("r")))
        .when(c("target").isNull(), F.struct(F.lit("UNMAPPED").alias("d"), F.lit("NO_MAPPING").alias("r")))
        .when(~c("kind").isin("numeric", "alphanumeric") | (c("expected_kind") != c("kind")), F.struct(F.lit("REVIEW").alias("d"), F.lit("VALUE_KIND_MISMATCH").alias("r")))
        .when(~kept, F.struct(F.lit("REVIEW").alias("d"), F.lit("CONDITION_LOSS").alias("r")))
        .when(c("target_unit").isNotNull() & ~F.coalesce(c("unit") == c("target_unit"), F.lit(False)), F.struct(F.lit("REVIEW").alias("d"), F.lit("UNIT_INCOMPATIBLE").alias("r")))
        .otherwise(F.struct(F.lit("COMMIT").alias("d"), F.lit("ELIGIBLE").alias("r")))
    )
    return df.withColumns({"decision": refusal["d"], "reason": refusal["r"]})


def resolve_conflicts(facts: DataFrame, target: list[str], point: str, value: str, order: list) -> DataFrame:
    """Adds outcome of committed facts that share a target: all reviewed if operating points or values differ, else one stays.

    Sizes and spreads are summed by target before they meet the facts (min and max tell whether
    a column differs), so a hot target costs each task one row.
    """
    stats = facts.groupBy(*target).agg(F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"_{a}_{b}") for b, c in (("p", point), ("v", value)) for a, f in (("lo", F.min), ("hi", F.max), ("has", F.count))])
    keep = facts.groupBy(*target).agg(F.min(F.struct(*order)).alias("_keep"))
    df = facts.join(stats, target).join(keep, target)
    first = F.struct(*order) == F.col("_keep")
    # A fact without a value or point doesn't agree with one that has it; min and max skip nulls, so they are counted.
    differ = lambda b: (F.col(f"_lo_{b}") != F.col(f"_hi_{b}")) | ((F.col(f"_has_{b}") > 0) & (F.col(f"_has_{b}") < F.col("_n")))
    outcome = (
        F.when(F.col("_n") == 1, "COMMIT").when(differ("p"), "MULTIPLE_OPERATING_POINTS").when(differ("v"), "CONFLICT")
        .when(first, "COMMIT").otherwise("DUPLICATE_MERGED")
    )
    return df.withColumn("outcome", outcome).drop("_n", "_lo_p", "_hi_p", "_has_p", "_lo_v", "_hi_v", "_has_v", "_keep")


def slots(facts: DataFrame, by: list[str], order: list, capacity: int) -> DataFrame:
    """Adds slot 1, 2, ... and fits; facts beyond the capacity are told apart, not cut."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return facts.withColumn("slot", n).withColumn("fits", F.col("slot") <= capacity)


def to_wide(rows: DataFrame, by: list[str], slot: str, columns: dict[str, str], capacity: int) -> DataFrame:
    """One row for each key with <name>_1 ... <name>_capacity; columns: output name to input column."""
    cells = [F.max(F.when(F.col(slot) == i, F.col(c))).alias(f"{name}_{i}") for i in range(1, capacity + 1) for name, c in columns.items()]
    return rows.where(F.col(slot).between(1, capacity)).groupBy(*by).agg(*cells)


def to_long(wide: DataFrame, by: list[str], names: list[str], capacity: int, label: str) -> DataFrame:
    """The filled slots of wide rows: by, slot, and a column for each name; empty where label is null or blank."""
    cells = F.array(*[F.struct(F.lit(i).alias("slot"), *[F.col(f"{n}_{i}").alias(n) for n in names]) for i in range(1, capacity + 1)])
    return wide.select(*by, F.inline(F.filter(cells, lambda x: F.coalesce(F.trim(x[label]) != "", F.lit(False)))))


def conflicting_kinds(a: Column, b: Column) -> Column:
    """Sorted keys that two condition maps state differently."""
    return F.array_sort(F.filter(F.array_intersect(F.map_keys(a), F.map_keys(b)), lambda k: F.lower(F.element_at(a, k)) != F.lower(F.element_at(b, k))))


def supports(mine: Column, claimed: Column) -> Column:
    """Whether every claimed condition is stated alike."""
    return F.forall(F.map_entries(claimed), lambda c: F.coalesce(F.lower(F.try_element_at(mine, c["key"])) == F.lower(c["value"]), F.lit(False)))


def gap_clusters(df: DataFrame, by: list[str], x: str, tolerance: float) -> DataFrame:
    """(by, cluster, n, mean): a new cluster where the step from the value before is above tolerance."""
    w = Window.partitionBy(*by).orderBy(x)
    step = F.coalesce((F.col(x) - F.lag(x).over(w) > tolerance).cast("int"), F.lit(0))
    marked = df.withColumn("_new", step).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"))


def merged_intervals(df: DataFrame, by: list[str], lo: str, hi: str, gap: float = 0) -> DataFrame:
    """Intervals that overlap, or lie within gap, joined: (by, lo, hi, n).

    Runs lie one after another in the order of the intervals, so the last row of a run has its sums
    from running windows over one sort, and no task holds a table of runs beside its sorted rows.
    """
    w = Window.partitionBy(*by).orderBy("_lo", "_hi")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("_lo") > reach + gap).cast("int"), F.lit(0))
    marked = df.select(*by, F.col(lo).alias("_lo"), F.col(hi).alias("_hi")).withColumn("_new", new)
    marked = marked.withColumns({"_run": F.sum("_new").over(upto), "_at": F.row_number().over(w).cast("long"), "_last": F.lead("_new", 1, 1).over(w) == 1})
    first = F.when(F.col("_new") == 1, F.struct("_at", "_lo"))
    marked = marked.withColumns({
        "_start": F.last(first, ignorenulls=True).over(upto), "_least": F.first("_lo", ignorenulls=True).over(upto),
        "_most": F.max(F.struct("_run", "_hi")).over(upto),  # a later run is the larger struct, so this is the run's own
    }).where("_last")
    start = F.col("_start")
    return marked.select(*by, F.when(start.isNull(), F.col("_least")).otherwise(start["_lo"]).alias("lo"), F.col("_most")["_hi"].alias("hi"), (F.col("_at") - F.coalesce(start["_at"], F.lit(1)) + 1).alias("n"))


def bucketed(df: DataFrame, x: str, edges: list[float]) -> DataFrame:
    """Adds bucket: the half-open range of edges that x lies in, from 0; null outside. A search in an array, so no join."""
    inside = (F.col(x) >= edges[0]) & (F.col(x) < edges[-1])
    return df.withColumn("bucket", F.when(inside, F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(x))) - 1))


def bin_rows(words: DataFrame, by: list[str], tolerance: float, xs: list[float]) -> DataFrame:
    """Words of a page as table rows: a row starts where `top` leaves the tolerance of the row's first word.

    The anchor is the first word of the row, not the word before, so the rows of a page are found
    one after another; a page is bounded. Returns by, row, column, text (column null outside xs).
    """
    import pandas as pd

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["top", "x0"], kind="stable")
        row, anchor, numbers = -1, None, []
        for top in pdf["top"]:
            if anchor is None or abs(top - anchor) > tolerance:
                row, anchor = row + 1, top
            numbers.append(row)
        mid = (pdf["x0"] + pdf["x1"]) / 2
        column = pd.cut(mid, xs, right=False, labels=False).astype("Int64")
        out = pdf.assign(row=numbers, column=column).sort_values(["row", "x0"], kind="stable")
        return out.groupby([*by, "row", "column"], dropna=False, sort=False)["text"].agg(" ".join).reset_index()

    schema = ", ".join([*(f"{c} {dict(words.dtypes)[c]}" for c in by), "row long, column long, text string"])
    return words.groupBy(*by).applyInPandas(rows, schema)


def best_member(members: DataFrame, group: list[str]) -> DataFrame:
    """The strongest member of each evidence group: smallest (verification, scope, modality, not manufacturer), then the first."""
    key = F.struct("verification_order", "scope_order", "modality_order", (~F.col("manufacturer")).alias("other"), "ordinal")
    return members.groupBy(*group).agg(F.min_by("member_id", key).alias("member_id"))


def support_factors(members: DataFrame, by: list[str]) -> DataFrame:
    """What the verified evidence of a value amounts to, and its grade. members: verified, manufacturer, establishes_scope, complete, in_scope, origin."""
    v = F.col("verified")
    out = members.groupBy(*by).agg(
        F.bool_or(v).alias("verified_span"),
        F.bool_or(v & F.col("manufacturer")).alias("manufacturer_origin"),
        F.bool_or(v & F.col("establishes_scope")).alias("scope_established"),
        F.bool_or(v & F.col("complete")).alias("conditions_complete"),
        F.bool_and(~v | F.col("in_scope")).alias("family_invariance_ok"),
        F.count_distinct(F.when(v, F.col("origin"))).alias("independent_roots"),
    )
    return out.withColumn("grade", support_grade(F.col("verified_span"), F.col("family_invariance_ok"), F.col("manufacturer_origin"), F.col("scope_established"), F.col("conditions_complete")))


def scope_binding(covers, scope, mpn) -> Column:
    """EXACT, CONTRADICTED or NOT_ESTABLISHED: whether an artifact is about a product number."""
    return F.when(F.col(covers).isNotNull() & (F.col(covers) != F.col(mpn)), "CONTRADICTED").when((F.col(scope) == "EXACT_SKU") & (F.col(covers) == F.col(mpn)), "EXACT").otherwise("NOT_ESTABLISHED")


def qualifier_status(required: Column, conditions: Column, has_rule: Column) -> Column:
    """struct(status, missing): UNKNOWN without a rule, else PARTIAL or COMPLETE with the kinds that lack."""
    missing = F.array_sort(F.array_except(required, F.map_keys(conditions)))
    return F.struct(F.when(~has_rule, "UNKNOWN").when(F.size(missing) > 0, "PARTIAL").otherwise("COMPLETE").alias("status"), F.when(has_rule, missing).alias("missing"))


def duplicate_keys(proposals: DataFrame, by: list[str]) -> DataFrame:
    """Adds rejected: DUPLICATE_SOURCE_KEY for every proposal of a key that comes more than once."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return proposals.withColumn("rejected", F.when(n > 1, "DUPLICATE_SOURCE_KEY"))


def numbered_trace(steps: Column) -> Column:
    return F.transform(steps, lambda x, i: F.struct((i + 1).alias("step"), x.alias("detail")))


def supporting_keys(own: Column, merged: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(F.array(own), F.coalesce(merged, F.array().cast("array<string>")))))


VALUE_AUTHORITIES = ("ORGANIZER_EXAMPLE", "MANUFACTURER_EVIDENCE", "HUMAN_APPROVED")


def licenses_value(e: Column) -> Column:
    """Whether one piece of evidence (artifact, locator, verified) licenses a manufacturer's value."""
    return e["artifact"].isNotNull() & e["locator"].isNotNull() & F.coalesce(e["verified"], F.lit(False))


def has_value_authority(authority: Column, evidence: Column) -> Column:
    """Known authority; a manufacturer's needs a licensing piece of evidence."""
    return authority.isin(*VALUE_AUTHORITIES) & ((authority != "MANUFACTURER_EVIDENCE") | F.exists(F.coalesce(evidence, F.array().cast("array<struct<artifact:string,locator:string,verified:boolean>>")), licenses_value))


def delivery_eligible(decision: Column, value: Column, uom_resolution: Column, authority: Column, evidence: Column) -> Column:
    """Committed, with a value, a unit that is resolved or absent, and standing."""
    return (decision == "COMMIT") & value.isNotNull() & (uom_resolution != "UNRESOLVED") & has_value_authority(authority, evidence)


def eligible_evidence(scope: Column, covers: Column, anchor: Column) -> Column:
    """Evidence about one exact product must cover the product asked for; wider scopes pass."""
    return (scope != "EXACT_SKU") | F.coalesce(covers == anchor, F.lit(False))


def value_present(text: Column, value: Column, uom: Column, structured: Column) -> Column:
    """Whether bound text states a value: structured data without a unit must equal it, else it must occur, with its unit behind it if it has one."""
    quote = lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))
    beside = F.rlike(text, F.concat(quote(value), F.lit(r"\s+"), quote(F.coalesce(uom, F.lit("")))))
    return F.when(structured & uom.isNull(), text == value).when(uom.isNull(), text.contains(value)).otherwise(text.contains(value) & beside)


def schema_ordered(rows: DataFrame, positions: DataFrame, key: str) -> DataFrame:
    """Adds place: rows in the order of a schema (key, position), unknown keys after it by name."""
    w = Window.orderBy(F.coalesce("position", F.lit(2**31 - 1)), key)
    named = rows.select(key).distinct().join(positions.select(key, "position"), key, "left").withColumn("place", F.row_number().over(w))
    return rows.join(named.select(key, "place"), key)


def preferred(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The candidate that got furthest: ACQUIRED, then ELIGIBLE, then the first in position."""
    rank = F.when(F.col("status") == "ACQUIRED", 0).when(F.col("status") == "ELIGIBLE", 1).otherwise(2)
    return candidates.groupBy(*by).agg(F.min_by("candidate_id", F.struct(rank.alias("rank"), "position")).alias("candidate_id"))
