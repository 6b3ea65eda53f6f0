"""Queries for scoring, evidence and wide records over the driver's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.operators import evaluation as E
from catalith.operators import evidence as V
from catalith.plans.catalog import read


#: Slots of a wide record. Few, so that the tables have records that are full; what is beyond is returned as well.
CAPACITY = 12

def latency_summary(spark, sf_dir):
    out = E.latency(read(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "p50", "p95")


def _judged(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.join(read(spark, sf_dir, "labels"), "doc_id", "left").withColumn("predicted", (F.col("n_chars") > 700).cast("int"))


def ratio_tallies(spark, sf_dir):
    right = F.col("predicted") == F.col("quality")
    rows = _judged(spark, sf_dir).groupBy("lang").agg(*E.tally("accuracy", right, F.col("quality").isNotNull()), *E.tally("false_keep", F.col("predicted") == 1, F.col("quality") == 0))
    return rows.withColumns({"accuracy": F.round(E.ratio("accuracy_n", "accuracy_d"), 9), "false_keep": F.round(E.ratio("false_keep_n", "false_keep_d"), 9)})


def grade_precision(spark, sf_dir):
    grade = F.when(F.col("quality").isNull(), None).otherwise(V.support_grade(F.col("quality") == 1, F.lit(True), F.col("n_chars") > 500, F.col("lang") == "en", F.col("toxic") == 0))
    rows = _judged(spark, sf_dir).withColumn("grade", F.coalesce(grade, F.lit("UNGRADED")))
    return rows.groupBy("grade").agg(*E.tally("precision", F.coalesce(F.col("predicted") == F.col("quality"), F.lit(False))))


def unexpected_predictions(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").orderBy("doc_id")


def split_leakage(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("source", F.when(F.col("source") == "src3", 0).otherwise(F.col("doc_id") % 3).alias("split"))
    return E.straddling(rows, "source", "split")


def manifest_coverage(spark, sf_dir):
    return _judged(spark, sf_dir).agg(F.count(F.lit(1)).alias("cases"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"), F.count_distinct("quality").alias("classes"), F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def conflict_resolution(spark, sf_dir):
    facts = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("target"), (F.col("l_partkey") % 3 * (F.col("l_suppkey") % 2)).alias("point"), F.when(F.col("l_partkey") % 3 == 1, F.lit(1.0)).otherwise(F.col("l_discount")).alias("value"))
    out = V.resolve_conflicts(facts, ["target"], "point", "value", ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "target", "outcome")


def adjudicated(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    rules = spark.createDataFrame([("AIR", "T1", 1, "numeric", "PRESERVE", None, "mm"), ("RAIL", "T2", 2, None, "ENCODES", {"line": "2"}, None), ("N", "T3", 3, "alphanumeric", "NONE", None, None)], "source_key string, target string, priority int, expected_kind string, policy string, required map<string,string>, target_unit string")
    n = F.col("l_linenumber")
    rows = items.select("l_orderkey", n, (F.col("l_partkey") % 10 != 0).alias("identity_exact"), (F.col("l_suppkey") % 5 != 0).alias("verified"), F.when(n % 4 == 0, "AIR").when(n % 4 == 1, "RAIL").when(n % 4 == 2, "N").otherwise("OTHER").alias("source_key"),
                        F.when(F.col("l_partkey") % 7 == 0, "range").when(F.col("l_partkey") % 2 == 0, "numeric").otherwise("alphanumeric").alias("kind"), F.create_map(F.lit("line"), F.when(F.col("l_suppkey") % 2 == 0, "2").otherwise("3")).alias("conditions"), F.when(F.col("l_partkey") % 3 == 0, "mm").alias("unit"))
    return V.adjudicate(rows, rules).groupBy("decision", "reason").agg(F.count(F.lit(1)).alias("n"))


def attribute_unpivot_pivot(spark, sf_dir):
    """Orders of a customer as numbered slots, made wide, and long again; orders beyond the record's capacity join them, told apart."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    numbered = V.slots(orders, ["o_custkey"], ["o_orderkey"], CAPACITY)
    wide = V.to_wide(numbered.where("fits"), ["o_custkey"], "slot", {"label": "o_orderpriority", "value": "o_orderstatus"}, CAPACITY)
    long = V.to_long(wide, ["o_custkey"], ["label", "value"], CAPACITY, "label").select("o_custkey", F.col("slot").cast("long").alias("slot"), "label", "value", F.lit(True).alias("fits"))
    return long.unionByName(numbered.where("NOT fits").select("o_custkey", F.col("slot").cast("long").alias("slot"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("value"), "fits"))


def wide_record(spark, sf_dir):
    """A record for each customer; what is beyond its capacity comes back in its order."""
    orders = V.slots(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], ["o_orderkey"], CAPACITY)
    rest = F.filter(F.array_sort(F.collect_list(F.struct("slot", F.col("o_orderpriority").alias("label")))), lambda x: x["slot"] > CAPACITY)
    beyond = orders.groupBy("o_custkey").agg(F.count_if(~F.col("fits")).alias("beyond"), F.array_join(F.transform(rest, lambda x: x["label"]), "|").alias("rest"))
    return V.to_wide(orders, ["o_custkey"], "slot", {"label": "o_orderpriority"}, CAPACITY).join(beyond, "o_custkey")


def identity_disposition(spark, sf_dir):
    """Suppliers and parts as brands and numbers: facts are made from line items."""
    item = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("brand"), F.col("l_partkey").alias("mpn"), "l_orderkey", "l_linenumber")
    exact = item.where("l_orderkey % 3 = 0").select("brand", "mpn", (F.col("mpn") * 10 + F.when(F.col("l_orderkey") % 9 == 0, F.col("l_linenumber") % 2).otherwise(0)).alias("exact_mpn"))
    completions = item.where("l_orderkey % 5 = 0").select("brand", "mpn", (F.col("l_linenumber") % 2).alias("key"))
    mappings = item.where("l_orderkey % 7 = 0").select("brand", "mpn", (F.col("l_linenumber") % 3).alias("code"), (F.col("mpn") * 100 + F.col("l_linenumber")).alias("exact_mpn"))
    products = read(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("brand"), F.col("p_partkey").alias("mpn"), (F.col("p_partkey") % 3).alias("code"))
    return V.identity(products, exact, completions, mappings, item.select("brand", "mpn"))


def gap_cluster(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("x"))
    out = V.gap_clusters(events, ["user_id"], "x", 3_600_000_000 * 6)
    return out.select("user_id", F.col("cluster").cast("long").alias("cluster"), "n")


def interval_merge(spark, sf_dir):
    spans = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("a"), (F.col("l_partkey") + F.col("l_quantity")).cast("long").alias("b"))
    return V.merged_intervals(spans, ["l_suppkey"], "a", "b", 3)


def interval_bucket(spark, sf_dir):
    rows = V.bucketed(read(spark, sf_dir, "lineitem"), "l_quantity", [5.0, 10.0, 20.0, 45.0])
    return rows.groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def condition_points(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    mine = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"))
    claimed = F.create_map(F.lit("flag"), F.lit("n"), F.lit("status"), F.lit("O"))
    return items.select("l_orderkey", "l_linenumber", V.supports(mine, claimed).alias("supports"), F.array_join(V.conflicting_kinds(mine, claimed), ",").alias("conflicts"))


def pipeline_state(spark, sf_dir):
    """Where each user's run stands, by the kinds of event seen: the furthest stage counts."""
    kind = F.col("event_type")
    flags = read(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(kind == "error").alias("failed"), F.bool_or(kind == "purchase").alias("done"), F.bool_or(kind == "click").alias("begun"), F.count(F.lit(1)).alias("events"))
    state = F.when(F.col("failed"), "FAILED").when(F.col("done"), "DONE").when(F.col("begun"), "RUNNING").otherwise("NOT_RUN")
    return flags.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("users"), F.sum("events").alias("events"))


def other_brand_facts(spark, sf_dir):
    """For each brand and number: facts on the number under other brands, by sums of both instead of a theta join."""
    facts = read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("brand"), F.col("l_partkey").alias("mpn")).agg(F.count(F.lit(1)).alias("own"))
    everywhere = facts.groupBy("mpn").agg(F.sum("own").alias("all"))
    return facts.join(everywhere, "mpn").select("brand", "mpn", (F.col("all") - F.col("own")).alias("others"))


QUERIES = {f.__name__: f for f in (
    latency_summary, ratio_tallies, grade_precision, unexpected_predictions, split_leakage, manifest_coverage, conflict_resolution, adjudicated, attribute_unpivot_pivot, wide_record, identity_disposition,
    gap_cluster, interval_merge, interval_bucket, condition_points, pipeline_state, other_brand_facts,
)}

_J = "j AS (SELECT d.doc_id, source, lang, n_chars, quality, toxic, CASE WHEN n_chars > 700 THEN 1 ELSE 0 END AS predicted FROM documents d LEFT JOIN labels USING (doc_id))"
_SLOTS = "s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS slot FROM orders)"
ORACLE_SQL = {
    "latency_summary": "SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, CASE WHEN count(value) >= 5 THEN quantile_disc(value, 0.5) END AS p50, CASE WHEN count(value) >= 5 THEN quantile_disc(value, 0.95) END AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1",
    "ratio_tallies": f"WITH {_J}, t AS (SELECT lang, count(*) FILTER (quality IS NOT NULL AND predicted = quality) AS accuracy_n, count(quality) AS accuracy_d, count(*) FILTER (quality = 0 AND predicted = 1) AS false_keep_n, count(*) FILTER (quality = 0) AS false_keep_d FROM j GROUP BY 1) SELECT *, round(accuracy_n / nullif(accuracy_d, 0), 9) AS accuracy, round(false_keep_n / nullif(false_keep_d, 0), 9) AS false_keep FROM t",
    "grade_precision": f"""WITH {_J}, g AS (SELECT *, CASE WHEN quality = 1 THEN CASE (n_chars <= 500)::INT + (lang <> 'en')::INT + (toxic <> 0)::INT WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END ELSE 'UNGRADED' END AS grade FROM j)
        SELECT grade, count(*) FILTER (predicted = quality) AS precision_n, count(*) AS precision_d FROM g GROUP BY 1""",
    "unexpected_predictions": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "split_leakage": "SELECT source, count(DISTINCT doc_id % 3) AS splits, count(*) AS n FROM documents WHERE source <> 'src3' GROUP BY 1 HAVING splits > 1",
    "manifest_coverage": f"WITH {_J} SELECT count(*) AS cases, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, count(DISTINCT quality) AS classes, count(*) FILTER (quality IS NULL) AS unlabelled, count(*) FILTER (toxic = 1) AS toxic FROM j",
    "conflict_resolution": """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey AS target, l_partkey % 3 * (l_suppkey % 2) AS point, CASE WHEN l_partkey % 3 = 1 THEN 1.0 ELSE l_discount END AS value FROM lineitem),
        s AS (SELECT target, count(*) AS n, count(DISTINCT point) AS p, count(DISTINCT value) AS v FROM f GROUP BY 1)
        SELECT l_orderkey, l_linenumber, f.target, CASE WHEN n = 1 THEN 'COMMIT' WHEN p > 1 THEN 'MULTIPLE_OPERATING_POINTS' WHEN v > 1 THEN 'CONFLICT' WHEN row_number() OVER (PARTITION BY f.target ORDER BY l_orderkey, l_linenumber) = 1 THEN 'COMMIT' ELSE 'DUPLICATE_MERGED' END AS outcome FROM f JOIN s ON s.target = f.target""",
    "adjudicated": """WITH f AS (SELECT l_partkey % 10 <> 0 AS ident, l_suppkey % 5 <> 0 AS ver, l_linenumber % 4 AS k, CASE WHEN l_partkey % 7 = 0 THEN 'range' WHEN l_partkey % 2 = 0 THEN 'numeric' ELSE 'alphanumeric' END AS kind, l_suppkey % 2 = 0 AS two, l_partkey % 3 = 0 AS mm FROM lineitem),
        r AS (SELECT CASE WHEN NOT ident THEN 'IDENTITY_NOT_EXACT' WHEN NOT ver THEN 'VERIFICATION_FAILED' WHEN k = 3 THEN 'NO_MAPPING' WHEN kind = 'range' OR (k = 0 AND kind <> 'numeric') OR (k = 2 AND kind <> 'alphanumeric') THEN 'VALUE_KIND_MISMATCH'
                  WHEN k = 2 OR (k = 1 AND NOT two) THEN 'CONDITION_LOSS' WHEN k = 0 AND NOT mm THEN 'UNIT_INCOMPATIBLE' ELSE 'ELIGIBLE' END AS reason FROM f)
        SELECT CASE reason WHEN 'IDENTITY_NOT_EXACT' THEN 'WITHHOLD' WHEN 'VERIFICATION_FAILED' THEN 'WITHHOLD' WHEN 'NO_MAPPING' THEN 'UNMAPPED' WHEN 'ELIGIBLE' THEN 'COMMIT' ELSE 'REVIEW' END AS decision, reason, count(*) AS n FROM r GROUP BY 1, 2""",
    "attribute_unpivot_pivot": f"WITH {_SLOTS} SELECT o_custkey, slot, o_orderpriority AS label, o_orderstatus AS value, slot <= {CAPACITY} AS fits FROM s",
    "wide_record": f"WITH {_SLOTS} SELECT o_custkey, {', '.join(f'max(o_orderpriority) FILTER (slot = {i}) AS label_{i}' for i in range(1, CAPACITY + 1))}, count(*) FILTER (slot > {CAPACITY}) AS beyond, coalesce(string_agg(o_orderpriority, '|' ORDER BY slot) FILTER (slot > {CAPACITY}), '') AS rest FROM s GROUP BY 1",
    "identity_disposition": """WITH i AS (SELECT l_suppkey % 20 AS brand, l_partkey AS mpn, l_orderkey AS o, l_linenumber AS l FROM lineitem),
        e AS (SELECT brand, mpn, count(DISTINCT x) AS targets, min(x) AS target FROM (SELECT *, mpn * 10 + CASE WHEN o % 9 = 0 THEN l % 2 ELSE 0 END AS x FROM i WHERE o % 3 = 0) GROUP BY 1, 2),
        c AS (SELECT brand, mpn, count(DISTINCT l % 2) AS keys FROM i WHERE o % 5 = 0 GROUP BY 1, 2), m AS (SELECT brand, mpn, l % 3 AS code, count(DISTINCT l) AS built, min(mpn * 100 + l) AS "full" FROM i WHERE o % 7 = 0 GROUP BY 1, 2, 3),
        p AS (SELECT p_partkey % 20 AS brand, p_partkey AS mpn, p_partkey % 3 AS code FROM part), a AS (SELECT mpn, count(*) AS n FROM i GROUP BY 1), w AS (SELECT brand, mpn, count(*) AS n FROM i GROUP BY 1, 2),
        d AS (SELECT p.*, target, "full", CASE WHEN targets IS NOT NULL AND keys IS NOT NULL THEN 'CONTRADICTORY' WHEN targets > 1 THEN 'CONTRADICTORY' WHEN targets = 1 THEN 'EXACT' WHEN keys = 1 AND built = 1 THEN 'EXACT' WHEN keys IS NOT NULL AND built > 1 THEN 'CONTRADICTORY'
              WHEN keys IS NOT NULL THEN 'FAMILY_OR_INCOMPLETE' ELSE 'UNKNOWN' END AS disposition FROM p LEFT JOIN e USING (brand, mpn) LEFT JOIN c USING (brand, mpn) LEFT JOIN m USING (brand, mpn, code))
        SELECT d.brand, d.mpn, d.code, disposition, CASE WHEN disposition = 'EXACT' THEN coalesce(target, "full") END AS exact_mpn, coalesce(a.n, 0) - coalesce(w.n, 0) AS ignored FROM d LEFT JOIN a USING (mpn) LEFT JOIN w USING (brand, mpn)""",
    "gap_cluster": """WITH e AS (SELECT user_id, epoch_us(ts) AS x FROM events), g AS (SELECT user_id, x, CASE WHEN x - lag(x) OVER (PARTITION BY user_id ORDER BY x) > 21600000000 THEN 1 ELSE 0 END AS new FROM e),
        c AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS cluster FROM g) SELECT user_id, cluster, count(*) AS n FROM c GROUP BY 1, 2""",
    "interval_merge": """WITH s AS (SELECT l_suppkey, l_partkey AS a, (l_partkey + l_quantity)::BIGINT AS b FROM lineitem), m AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 1 ELSE 0 END AS new FROM s),
        r AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM m) SELECT l_suppkey, min(a) AS lo, max(b) AS hi, count(*) AS n FROM r GROUP BY l_suppkey, run""",
    "interval_bucket": "SELECT CASE WHEN l_quantity < 5 OR l_quantity >= 45 THEN NULL WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN 1 ELSE 2 END AS bucket, count(*) AS n FROM lineitem GROUP BY 1",
    "condition_points": "SELECT l_orderkey, l_linenumber, l_returnflag = 'N' AND l_linestatus = 'O' AS supports, concat_ws(',', CASE WHEN l_returnflag <> 'N' THEN 'flag' END, CASE WHEN l_linestatus <> 'O' THEN 'status' END) AS conflicts FROM lineitem",
    "pipeline_state": """WITH f AS (SELECT user_id, bool_or(event_type = 'error') AS failed, bool_or(event_type = 'purchase') AS done, bool_or(event_type = 'click') AS begun, count(*) AS n FROM events GROUP BY 1)
        SELECT CASE WHEN failed THEN 'FAILED' WHEN done THEN 'DONE' WHEN begun THEN 'RUNNING' ELSE 'NOT_RUN' END AS state, count(*) AS users, sum(n)::BIGINT AS events FROM f GROUP BY 1""",
    "other_brand_facts": """WITH f AS (SELECT l_suppkey % 20 AS brand, l_partkey AS mpn, count(*) AS own FROM lineitem GROUP BY 1, 2) SELECT brand, mpn, (sum(own) OVER (PARTITION BY mpn) - own)::BIGINT AS others FROM f""",
}
