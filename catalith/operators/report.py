"""Whole evaluation reports, set fingerprints, and constraints over whole records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions import text as T

#: Numerator and denominator columns of a report, by measure; counts that have no denominator end in _count.
RATIOS = ("identity", "false_exact", "precision", "supported", "coverage", "normalization", "citations", "critical")
COUNTS = ("missing", "failed", "critical_withheld", "critical_unknown", "citations_open")


def judgements(cases: DataFrame, predictions: DataFrame, expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """A row for each case (feature null) and for each expected attribute, with what it adds to each numerator and denominator.

    cases: case_id, split, family, disposition, exact_mpn. predictions: case_id, outcome (COMPLETED or a failure),
    disposition, mpn; at most one a case. expected: case_id, feature, applicability, buyer_critical, truth_key (null:
    no value to judge by), truth_point, truth_artifact, truth_page. predicted: case_id, feature, accepted, value_key,
    point, verified, grade, artifact, page; at most one a case and feature. A case without a prediction, or with a
    failed one, fills every denominator it has and no numerator. An inapplicable attribute is no gap, but
    accepting it is wrong; one of unknown applicability counts nowhere.
    """
    no, zero = F.lit(False), F.lit(0)
    got = predictions.select("case_id", F.col("outcome"), F.col("disposition").alias("said"), F.col("mpn").alias("said_mpn"))
    held = cases.join(got, "case_id", "left").withColumn("ran", F.coalesce(F.col("outcome") == "COMPLETED", no))
    exact = F.col("disposition") == "EXACT"
    right = F.coalesce(F.col("said") == F.col("disposition"), no) & (~exact | F.coalesce(T.canonical_mpn("said_mpn") == T.canonical_mpn("exact_mpn"), no))
    one = lambda c: F.coalesce(c, no).cast("long")
    blank = {f"{r}_{s}": zero.cast("long") for r in RATIOS for s in "nd"} | {f"{c}_count": zero.cast("long") for c in COUNTS}
    row = lambda df, extra, filled: df.select("case_id", "split", "family", *[c.alias(a) for a, c in extra.items()], *[(filled.get(k, v)).alias(k) for k, v in blank.items()])
    null = F.lit(None).cast("string")
    of_cases = row(held, {"feature": null, "grade": null}, {
        "identity_n": one(F.col("ran") & right), "identity_d": F.lit(1).cast("long"), "false_exact_n": one(F.col("ran") & ~exact & (F.col("said") == "EXACT")), "false_exact_d": one(F.col("ran") & ~exact),
        "missing_count": one(F.col("outcome").isNull()), "failed_count": one(F.col("outcome").isNotNull() & ~F.col("ran")),
    })

    df = expected.join(held.select("case_id", "split", "family", "ran"), "case_id").join(predicted, ["case_id", "feature"], "left")
    ran, accepted, critical = F.col("ran"), F.col("ran") & F.coalesce("accepted", no), F.coalesce("buyer_critical", no)
    applies, unknown, not_ = (F.col("applicability") == a for a in ("APPLICABLE", "UNKNOWN", "NOT_APPLICABLE"))
    judgeable = applies & F.col("truth_key").isNotNull()
    value_right = F.coalesce(F.col("value_key") == F.col("truth_key"), no)
    right = value_right & F.col("point").eqNullSafe(F.col("truth_point"))
    known_place = F.col("truth_artifact").isNotNull() & F.col("truth_page").isNotNull()
    place_right = F.coalesce(F.col("verified") & (F.col("artifact") == F.col("truth_artifact")) & (F.col("page") == F.col("truth_page")), no)
    critical_applies = critical & F.when(ran, applies).otherwise(~not_)
    of_attributes = row(df, {"feature": F.col("feature"), "grade": F.when(accepted & judgeable, F.coalesce("grade", F.lit("UNGRADED")))}, {
        "precision_n": one(accepted & judgeable & right), "precision_d": one(accepted & (judgeable | not_)), "supported_n": one(accepted & applies & F.coalesce("verified", no)), "supported_d": one(accepted & applies),
        "coverage_n": one(accepted & judgeable), "coverage_d": one(judgeable), "normalization_n": one(accepted & judgeable & value_right), "normalization_d": one(accepted & judgeable),
        "citations_n": one(accepted & judgeable & known_place & place_right), "citations_d": one(accepted & judgeable & known_place), "citations_open_count": one(accepted & judgeable & ~known_place),
        "critical_n": one(accepted & critical_applies), "critical_d": one(critical_applies), "critical_withheld_count": one(critical_applies & ~accepted), "critical_unknown_count": one(ran & critical & unknown),
    })
    return of_cases.unionByName(of_attributes)


def report(judged: DataFrame) -> DataFrame:
    """Sums of judgements over the whole, by split, by split and family, by split and attribute, and by split and grade, from one scan.

    level names the set: ALL, SPLIT, FAMILY, FEATURE or GRADE. Of FEATURE and GRADE, rows that have none are left out.
    """
    keys = [F.col(k) for k in ("split", "family", "feature", "grade")]
    split, family, feature, grade = keys
    sums = [F.sum(f"{r}_{s}").alias(f"{r}_{s}") for r in RATIOS for s in "nd"] + [F.sum(f"{c}_count").alias(f"{c}_count") for c in COUNTS]
    out = judged.groupingSets([[], [split], [split, family], [split, feature], [split, grade]], *keys).agg(F.grouping_id(*keys).alias("_set"), *sums)
    level = F.when(F.col("_set") == 15, "ALL").when(F.col("_set") == 7, "SPLIT").when(F.col("_set") == 3, "FAMILY").when(F.col("_set") == 5, "FEATURE").otherwise("GRADE")
    out = out.withColumn("level", level).where("NOT (level = 'FEATURE' AND feature IS NULL) AND NOT (level = 'GRADE' AND grade IS NULL)")
    return out.select("level", "split", "family", "feature", "grade", *[c for c in out.columns if c.endswith(("_n", "_d", "_count"))])


def rates(sums: DataFrame) -> DataFrame:
    """Adds a rate for each ratio of a report, null where there is nothing to divide by, and unsupported_rate and selective_risk."""
    rate = lambda r: F.try_divide(F.col(f"{r}_n").cast("double"), F.nullif(F.col(f"{r}_d").cast("double"), F.lit(0.0)))
    out = sums.withColumns({f"{r}_rate": rate(r) for r in RATIOS})
    return out.withColumns({"unsupported_rate": 1 - F.col("supported_rate"), "selective_risk": 1 - F.col("precision_rate")})


def unexpected(predictions: DataFrame, cases: DataFrame) -> DataFrame:
    """Predictions of no known case."""
    return predictions.join(cases.select("case_id"), "case_id", "left_anti").select("case_id")


# --- fingerprints of sets


def set_fingerprint(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(n, fingerprint) of a set of rows, the same under any order and partitioning.

    A tree of digests: each row's JSON is hashed, rows are dealt to 65,536 leaves by the hash of their key, a
    leaf hashes its digests in the order of key, 256 leaves make a branch and the branches the root. So a task holds the
    digests of one leaf, never of all. Rows that repeat a key follow each other by digest. An empty set has
    the digest of the empty text. columns are part of it in the given order.
    """
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    slim = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), digest.alias("d")).withColumn("leaf", F.substring(F.sha2("k", 256), 1, 4))
    joined = lambda *order: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: x["d"]), ""), 256)
    leaves = slim.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), joined("k", "d").alias("d"))
    branches = leaves.groupBy(F.substring("leaf", 1, 2).alias("branch")).agg(F.sum("n").alias("n"), joined("leaf", "d").alias("d"))
    return branches.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), joined("branch", "d").alias("fingerprint"))


# --- constraints over records


@dataclass(frozen=True)
class Constraint:
    """A rule that no attribute of a record may break: where it applies (a condition on record and attribute columns), and what breaks it."""

    name: str
    applies: Column
    broken: Column


def record_constraints() -> list[Constraint]:
    """What holds of a finished record: values are tied to the resolved product, and a value under a product that isn't resolved is proven for its whole family."""
    exact = F.coalesce(F.col("disposition") == "EXACT", F.lit(False))
    proven = F.coalesce(F.col("family_invariance") == "PROVEN", F.lit(False))
    accepted = F.coalesce("accepted", F.lit(False))
    same = F.coalesce(T.canonical_mpn("anchor_mpn") == T.canonical_mpn("mpn"), F.lit(False))
    return [
        Constraint("ANCHOR_NOT_RESOLVED_IDENTITY", exact, ~same),
        Constraint("ANCHOR_WITHOUT_EXACT_IDENTITY", ~exact, F.col("anchor_mpn").isNotNull()),
        Constraint("ACCEPTED_WITHOUT_FAMILY_PROOF", ~exact, accepted & ~proven),
        Constraint("FAMILY_PROOF_UNDER_EXACT_IDENTITY", exact, proven),
        Constraint("ACCEPTED_WITHOUT_VERIFIED_EVIDENCE", accepted, ~F.coalesce("verified", F.lit(False))),
        Constraint("ACCEPTED_NOT_APPLICABLE", accepted, F.coalesce(F.col("applicability") == "NOT_APPLICABLE", F.lit(False))),
    ]


def record_violations(records: DataFrame, attributes: DataFrame, constraints: list[Constraint] | None = None) -> DataFrame:
    """(record_id, violation, n, first_feature): every constraint that a record breaks, by how many attributes, and the first of them.

    records: record_id, disposition, mpn, class_id. attributes: record_id, feature, anchor_mpn, accepted,
    family_invariance, verified, applicability. All constraints are counted in one pass over the attributes,
    summed by record before the shuffle; then each broken one becomes a row. A class_id that isn't EC and
    six digits, and a feature given twice, count as well.
    """
    rules = constraints if constraints is not None else record_constraints()
    df = attributes.join(records.select("record_id", "disposition", "mpn"), "record_id")
    hit = [r.applies & r.broken for r in rules]
    sums = df.groupBy("record_id").agg(*[s for i, h in enumerate(hit) for s in (F.count_if(h).alias(f"n{i}"), F.min(F.when(h, F.col("feature"))).alias(f"f{i}"))])
    broken = F.filter(F.array(*[F.struct(F.lit(r.name).alias("violation"), F.col(f"n{i}").alias("n"), F.col(f"f{i}").alias("first_feature")) for i, r in enumerate(rules)]), lambda x: x["n"] > 0)
    out = sums.select("record_id", F.inline(broken))
    twice = attributes.groupBy("record_id", "feature").agg(F.count(F.lit(1)).alias("c")).where("c > 1").groupBy("record_id").agg(F.lit("FEATURE_GIVEN_TWICE").alias("violation"), F.count(F.lit(1)).alias("n"), F.min("feature").alias("first_feature"))
    classes = records.where("class_id IS NOT NULL").where(~F.rlike("class_id", F.lit(r"^EC\d{6}$"))).select("record_id", F.lit("MALFORMED_CLASS_ID").alias("violation"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("first_feature"))
    return out.unionByName(twice).unionByName(classes)
