"""Scoring: tallies with numerator and denominator, latencies, leakage and coverage. No composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tally(name: str, correct: Column, counted: Column | None = None) -> list[Column]:
    """Columns <name>_n and <name>_d."""
    counted = F.lit(True) if counted is None else counted
    return [F.count_if(counted & correct).alias(f"{name}_n"), F.count_if(counted).alias(f"{name}_d")]


def ratio(n, d) -> Column:
    return F.try_divide(F.col(n).cast("double"), F.nullif(F.col(d).cast("double"), F.lit(0.0)))


def latency(df: DataFrame, by: list[str], x: str, least: int = 5) -> DataFrame:
    """count, total, mean, and nearest-rank p50 and p95 where there are `least` samples; nulls are no samples."""
    grouped = df.where(F.col(x).isNotNull()).groupBy(*by)
    rank = lambda q: F.when(F.count(F.lit(1)) >= least, F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {x})"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), rank(0.5).alias("p50"), rank(0.95).alias("p95"))


def straddling(df: DataFrame, family: str, split: str) -> DataFrame:
    """Families found in more than one split."""
    return df.groupBy(family).agg(F.count_distinct(split).alias("splits"), F.count(F.lit(1)).alias("n")).where("splits > 1")


def by_currency(df: DataFrame, cost: str, currency: str) -> DataFrame:
    """Reported costs by currency; a cost without one is UNSPECIFIED."""
    return df.where(F.col(cost).isNotNull()).groupBy(F.coalesce(currency, F.lit("UNSPECIFIED")).alias("currency")).agg(F.sum(cost).alias("cost"), F.count(F.lit(1)).alias("n"))


def citation_status(predicted: list[str], truth: list[str]) -> Column:
    """VALID, INVALID, or NOT_EVALUATED where the truth names no place."""
    known = F.lit(True)
    same = F.lit(True)
    for p, t in zip(predicted, truth, strict=True):
        known, same = known & F.col(t).isNotNull(), same & F.coalesce(F.col(p) == F.col(t), F.lit(False))
    return F.when(~known, "NOT_EVALUATED").when(same, "VALID").otherwise("INVALID")


def group_violations(members: DataFrame, group: list[str]) -> DataFrame:
    """Evidence groups that aren't one fact: unequal keys, or a condition kind stated in two ways. members: key, conditions (map)."""
    keys = members.groupBy(*group).agg(F.count_distinct("key").alias("n")).where("n > 1").select(*group, F.lit("UNEQUAL_KEYS").alias("violation"))
    kinds = members.select(*group, F.explode("conditions").alias("kind", "stated")).groupBy(*group, "kind").agg(F.count_distinct(F.lower("stated")).alias("n")).where("n > 1")
    return keys.union(kinds.select(*group, F.concat(F.lit("CONFLICTING_"), F.upper("kind")).alias("violation")))


def text_status(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Whether documents hold text: ALL_PAGES, PARTIAL (a tenth of the pages or more) or MOSTLY_WITHOUT."""
    share = F.avg((F.length(F.trim(F.coalesce(text, F.lit("")))) > 0).cast("int"))
    return df.groupBy(*by).agg(share.alias("share")).withColumn("status", F.when(F.col("share") == 1, "ALL_PAGES").when(F.col("share") >= 0.10, "PARTIAL").otherwise("MOSTLY_WITHOUT"))


def value_comparison(a, b) -> Column:
    """BOTH_BLANK, ONE_BLANK, IDENTICAL or DIFFERENT."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank(a) & blank(b), "BOTH_BLANK").when(blank(a) | blank(b), "ONE_BLANK").when(F.col(a) == F.col(b), "IDENTICAL").otherwise("DIFFERENT")


def case_problems(cases: DataFrame) -> DataFrame:
    """(case_id, problem): repeated ids, a family in two splits, an exact identity without a number. cases: case_id, family, split, disposition, exact_mpn."""
    twice = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("case_id", F.lit("DUPLICATE_ID").alias("problem"))
    families = cases.join(straddling(cases, "family", "split").select("family"), "family", "left_semi").select("case_id", F.lit("FAMILY_IN_TWO_SPLITS").alias("problem"))
    rules = F.array(F.when((F.col("disposition") == "EXACT") & F.col("exact_mpn").isNull(), "EXACT_WITHOUT_NUMBER"), F.when((F.col("disposition") != "EXACT") & F.col("exact_mpn").isNotNull(), "NUMBER_WITHOUT_EXACT"))
    own = cases.select("case_id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("problem"))
    return twice.union(families).union(own)
