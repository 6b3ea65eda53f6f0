"""Searches by their recorded key, with what the provider says it ran; sources given by hand; and what must hold before a source is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions import text as T
from catalith.functions import values as V
from catalith.operators import discovery as D
from catalith.operators.records import effective_authority, executed_queries, search_results

APPROVED = "APPROVED_MANUFACTURER"


def search_key(query: Column, provider: Column, max_results: Column, version: Column | None = None, options: Column | None = None) -> Column:
    """The digest by which a search is recorded and replayed.

    How many results are asked for is part of it, as another number is another ranking; so are the provider's version
    and options, where it has any. What is absent is left out, so older records keep their keys.
    """
    some = None if options is None else F.when(F.size(options) > 0, F.map_from_entries(F.array_sort(F.map_entries(options))))
    fields = {"max_results": max_results.cast("int"), "options": some, "provider": provider, "query": query, "version": version}
    return F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items()) if c is not None])), 256)


def search_executions(calls: DataFrame, records: DataFrame) -> DataFrame:
    """calls (call_id, key) with outcome (HIT, MISS), payload and provider_queries: those that the provider reports, in order, each once.

    records: key, payload, captured_at; the latest of a key counts. A miss is never a live call.
    """
    last = records.groupBy("key").agg(F.max_by("payload", F.struct("captured_at", "payload")).alias("payload"))
    df = calls.join(last, "key", "left").withColumn("outcome", F.when(F.col("payload").isNull(), "MISS").otherwise("HIT"))
    ran = F.when(F.col("payload").isNotNull(), F.array_distinct(executed_queries("payload")))
    return df.withColumn("provider_queries", F.coalesce(ran, F.array().cast("array<string>")))


def execution_results(executions: DataFrame, limit: int | None = None) -> DataFrame:
    """A row for each result of each answered search."""
    return search_results(executions.where("outcome = 'HIT'"), "payload", limit=limit)


def domains_for_hint(hints: DataFrame, entries: DataFrame) -> DataFrame:
    """(hint, key, domains): the domains of the registry entry that a manufacturer's name, whatever its case, points at; null where none does.

    entries: key, hints (array), domains (array). Of several entries with a hint the first key counts.
    """
    named = entries.select("key", "domains", F.explode(F.array_distinct(F.transform("hints", lambda h: F.lower(T.collapse(h))))).alias("_h"))
    first = named.groupBy("_h").agg(F.min(F.struct("key", "domains")).alias("e"))
    df = hints.select("hint", F.lower(T.collapse("hint")).alias("_h")).join(first, "_h", "left")
    return df.select("hint", F.col("e.key").alias("key"), F.coalesce("e.domains", F.array().cast("array<string>")).alias("domains"))


def manual_plan(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """What would become of a source that a person names, without any network: a verdict for each.

    sources: source_id, url, hint (an owner of the registry), mpn. Returns source_id, authority, relevance, static_url (OK, or
    why it may not be fetched), dns_deferred (a name is still to be resolved), rejections (each once; an unsound URL last), would_attempt.
    """
    df = D.with_owner(sources.withColumn("host", T.url_host("url")), registry)
    df = df.withColumns({"authority": D.authority(F.col("hint")), "relevance": D.relevance(D.relevance_texts(F.col("url"), F.lit("")), F.col("mpn")), "static_url": D.url_structure(F.col("url"))})
    sound = F.col("static_url") == "OK"
    reasons = F.array_distinct(F.concat(D.rejections(), F.when(~sound, F.array("static_url")).otherwise(F.array().cast("array<string>"))))
    named = sound & ~F.rlike("host", F.lit(r"^[0-9.]+$"))
    go = sound & (F.col("authority") == APPROVED) & (F.col("relevance") == "EXACT")
    return df.select("source_id", "authority", "relevance", "static_url", named.alias("dns_deferred"), reasons.alias("rejections"), go.alias("would_attempt"))


def storage_refusal(authority: Column, final_authority: Column, relevance: Column, method: Column) -> Column:
    """Why a fetched source may not be stored as the manufacturer's evidence; null if it may.

    After a redirect the last host's standing counts, and how the source was found must be on record.
    """
    holds = F.coalesce((effective_authority(final_authority, authority) == APPROVED) & (authority == APPROVED) & (relevance == "EXACT"), F.lit(False))
    return F.when(~holds, "REDIRECT_AUTHORITY_LOST").when(method.isNull(), "DISCOVERY_PROVENANCE_UNDECLARED")


def context_evidence(description: str, cues: str, brands: str, manufacturer: str, brand: str) -> Column:
    """What a classification was made from, as a struct: identity is context there, never a cue.

    brands: array of brand signals of the row; brand, manufacturer: proposals of the normalisation, or null.
    """
    signals = F.coalesce(F.col(brands), F.array().cast("array<string>"))
    extra = F.when(F.col(brand).isNotNull() & (F.col(brand) != "") & ~F.array_contains(signals, F.col(brand)), F.array(brand)).otherwise(F.array().cast("array<string>"))
    words = F.array_join(T.tokens(F.coalesce(F.col(description), F.lit(""))), " ")
    return F.struct(
        F.coalesce(F.col(description), F.lit("")).alias("raw_description"), words.alias("normalized_description"), F.col(cues).alias("matched_cues"), F.lit("DETERMINISTIC_INTERNAL").alias("authority"),
        F.nullif(F.col(manufacturer), F.lit("")).alias("manufacturer_context"), F.concat(signals, extra).alias("brand_context"),
    )


def for_target(df: DataFrame, value: str, unit: str, target_unit: str, kind: str) -> DataFrame:
    """Adds target_value, target_uom and target_problem: a numeric value in the unit that its target wants, or why it can't be given so.

    Values of other kinds, and targets without a unit, pass as they are.
    """
    plain = F.col(target_unit).isNull() | ~F.coalesce(F.col(kind) == "numeric", F.lit(False))
    out = V.convert(df, value, unit, target_unit)
    done = F.col("convert_status").isin("CONVERTED", "IDENTITY")
    problem = F.when(~plain & ~done, F.concat(F.lit("cannot express "), F.coalesce(F.col(value).cast("string"), F.lit("?")), F.lit(" "), F.coalesce(F.col(unit), F.lit("without a unit")), F.lit(" in "), F.col(target_unit), F.lit(": "), F.lower(F.replace("convert_status", F.lit("_"), F.lit(" ")))))
    return out.withColumns({
        "target_value": F.when(plain, F.col(value).cast("double")).when(done, F.col("converted")), "target_uom": F.when(plain, F.col(unit)).when(done, F.col(target_unit)), "target_problem": problem,
    }).drop("converted", "convert_status")


def index_metrics(cases: DataFrame) -> DataFrame:
    """One row of totals over cases: case_id, proposals, bound, verified, withheld, mapped."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("proposals", "bound", "verified", "withheld", "mapped")]
    return cases.agg(F.count(F.lit(1)).alias("cases"), *sums, F.max("proposals").alias("deepest"))
