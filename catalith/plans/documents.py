"""Queries over documents, benchmark, conversations, events and pages, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.functions import hashing as H
from catalith.functions import text as T
from catalith.functions import values as V
from catalith.operators import documents as D
from catalith.plans.catalog import read
from catalith.sources.html import parse_pages


def content_hash_dedup(spark, sf_dir):
    return D.by_content(read(spark, sf_dir, "documents"))


def artifact_integrity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    recorded = F.when(F.col("doc_id") % 50 == 0, F.sha2(F.concat("text", F.lit(" ")), 256)).when(F.col("doc_id") % 50 != 1, F.sha2("text", 256))
    return D.integrity(docs.withColumn("recorded", recorded), "text", "recorded").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def artifact_ids(spark, sf_dir):
    sha = F.when(F.col("doc_id") % 9 == 0, F.upper(H.sha256("text"))).otherwise(H.sha256("text"))
    return read(spark, sf_dir, "documents").select("doc_id", H.artifact_id(sha).alias("artifact_id"), H.from_artifact_id(H.artifact_id(sha)).alias("sha"))


def quote_location(spark, sf_dir):
    docs, quotes = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return D.locate_quotes(docs, quotes, "text", "quote", "doc_id", "item_id").select("doc_id", "item_id", F.col("at").cast("long").alias("at"), F.sha2("context", 256).alias("context_sha"))


def line_units(spark, sf_dir):
    rows = D.lines(read(spark, sf_dir, "documents"), "text", "doc_id")
    return rows.select("doc_id", F.col("ln").cast("long").alias("ln"), F.col("start").cast("long").alias("start"), "line")


def phrase_boundary(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", *[T.contains_phrase("text", F.lit(p)).alias(n) for p, n in (("of the", "of_the"), ("licensed", "licensed"), ("4.0", "four"))]).where("of_the OR licensed OR four")


def quantities(spark, sf_dir):
    rows = V.quantities(read(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("number"), 3).alias("largest"))


def value_parse(spark, sf_dir):
    x = F.get_json_object("props", "$.k")
    shape = F.col("event_id") % 8
    raw = (
        F.when(shape == 0, x).when(shape == 1, F.concat(F.lit(" "), x, F.lit(" "))).when(shape == 2, F.concat(x, F.lit(" mm"))).when(shape == 3, F.concat(x, F.lit(" to 50 V")))
        .when(shape == 4, "yes").when(shape == 5, "No").when(shape == 6, F.concat(x, F.lit("e1"))).otherwise("n/a")
    )
    rows = read(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return rows.select(
        "event_id",
        V.parse_integer("raw").cast("long").alias("whole"),
        V.parse_number("raw").cast("double").alias("number"),
        V.parse_boolean("raw").alias("flag"),
        V.parse_number_with_unit("raw")["unit"].alias("unit"),
        V.parse_range("raw")["lo"].alias("lo"),
        V.parse_range("raw")["hi"].alias("hi"),
    )


def redact_secrets(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(H.redact_text("text"), 256).alias("sha"), F.contains(H.redact_text("text"), F.lit("[REDACTED]")).alias("redacted"))


def sensitive_keys(spark, sf_dir):
    key = F.get(F.array(*map(F.lit, ("API-Key", "client_secret", "Set Cookie", "user", "pass.word", "tokens", "key"))), (F.col("event_id") % 7).cast("int"))
    rows = read(spark, sf_dir, "events").select("event_id", key.alias("name"))
    return rows.groupBy("name").agg(F.bool_and(H.is_sensitive_key("name", ("key", "token"), ("apikey", "clientsecret", "password", "setcookie"))).alias("sensitive"), F.count(F.lit(1)).alias("n"))


def _key():
    return H.digest({"user": F.col("user_id"), "type": F.col("event_type"), "k": F.get_json_object("props", "$.k"), "mode": F.lit(None).cast("string")})


def replay_keys(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", _key().alias("key"))


def replay_join(spark, sf_dir):
    """Requests against recorded interactions: the latest record of a key answers, a miss is told apart."""
    events = read(spark, sf_dir, "events").withColumn("key", _key())
    records = events.where("event_id % 3 <> 0").groupBy("key").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("record"))
    requests = events.where("event_id % 3 = 0").select("event_id", "key")
    return requests.join(records, "key", "left").select("event_id", "record", F.when(F.col("record").isNull(), "MISS").otherwise("HIT").alias("outcome"))


def class_search(spark, sf_dir):
    words = lambda c: F.filter(T.tokens(c), lambda t: F.length(t) > 1)
    phrases = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), words(F.concat_ws(" ", "p_name", "p_type")).alias("words"))
    queries = read(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("id"), words("p_type").alias("words"))
    return D.phrase_search(phrases, queries)


def neighbour_frame(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    near = D.neighbours(turns, ["conv_id"], "turn", F.length("text") > 300, 1)
    return near.select("conv_id", "turn", "role")


def overlapping_positions(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    at = D.all_positions(F.col("text"), "anan")
    return docs.select("doc_id", F.size(at).cast("long").alias("n"), F.array_join(at, ",").alias("places")).where("n > 0")


def html_visible_text(spark, sf_dir):
    page = parse_pages(read(spark, sf_dir, "pages")).select("page_id", "page.*")
    return page.select("page_id", "title", "canonical", F.sha2("visible", 256).alias("visible_sha"), F.length("visible").cast("long").alias("n_chars"), "fragments")


def search_text_nfkc(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.search_text(F.col("text")), 256).alias("search_sha"))


QUERIES = {f.__name__: f for f in (
    content_hash_dedup, artifact_integrity, artifact_ids, quote_location, line_units, phrase_boundary, quantities, value_parse, redact_secrets, sensitive_keys, replay_keys, replay_join, class_search,
    neighbour_frame, overlapping_positions, html_visible_text, search_text_nfkc,
)}

_EV = """WITH e AS (SELECT event_id, event_id % 8 AS shape, json_extract_string(props, '$.k') AS x FROM events),
    r AS (SELECT event_id, CASE shape WHEN 0 THEN x WHEN 1 THEN concat(' ', x, ' ') WHEN 2 THEN concat(x, ' mm') WHEN 3 THEN concat(x, ' to 50 V') WHEN 4 THEN 'yes' WHEN 5 THEN 'No' WHEN 6 THEN concat(x, 'e1') ELSE 'n/a' END AS raw, x, shape FROM e)"""
_KEY_SQL = """sha256(concat('{"k":"', json_extract_string(props, '$.k'), '","mode":null,"type":"', event_type, '","user":', user_id, '}'))"""
_WORDS = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: length(t) > 1))"
ORACLE_SQL = {
    "content_hash_dedup": "SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text",
    "artifact_integrity": "SELECT CASE WHEN doc_id % 50 = 0 THEN 'HASH_DRIFT' WHEN doc_id % 50 = 1 THEN 'MISSING_HASH' ELSE 'OK' END AS status, count(*) AS n FROM documents GROUP BY 1",
    "artifact_ids": "SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN concat('sha256:', sha256(text)) END AS artifact_id, CASE WHEN doc_id % 9 <> 0 THEN sha256(text) END AS sha FROM documents",
    "quote_location": "SELECT doc_id, item_id, instr(d.text, b.text) AS at, sha256(substr(d.text, greatest(1, instr(d.text, b.text) - 60), instr(d.text, b.text) + 60 + length(b.text) - greatest(1, instr(d.text, b.text) - 60))) AS context_sha FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "line_units": """SELECT doc_id, ln, start, line FROM (SELECT doc_id, ln - 1 AS ln, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS ln FROM documents))""",
    "phrase_boundary": """WITH p AS (SELECT doc_id, regexp_matches(concat(' ', text, ' '), '[^\\pL\\pN/_+-]of the[^\\pL\\pN/_+-]') AS of_the, regexp_matches(concat(' ', text, ' '), '[^\\pL\\pN/_+-]licensed[^\\pL\\pN/_+-]') AS licensed,
        regexp_matches(concat(' ', text, ' '), '[^\\pL\\pN/_+-]4\\.0[^\\pL\\pN/_+-]') AS four FROM documents) SELECT * FROM p WHERE of_the OR licensed OR four""",
    "quantities": r"""WITH q AS (SELECT unnest(regexp_extract_all(text, '(?:(?:<=|>=|≤|≥|<|>|=)\s*|^|[^A-Za-z0-9.,-]|^-|[^A-Za-z0-9]-)([+-]?[0-9]+(?:[.,][0-9]+)?(?:\s*(?:°[CF]|[A-Za-zµΩ%][A-Za-z0-9µΩ°/%-]*))?)', 1)) AS q FROM documents),
        s AS (SELECT replace(regexp_extract(q, '^[+-]?[0-9]+(?:[.,][0-9]+)?'), ',', '.')::DOUBLE AS number, nullif(regexp_extract(q, '^[+-]?[0-9]+(?:[.,][0-9]+)?\s*(.*)$', 1), '') AS unit FROM q)
        SELECT unit, count(*) AS n, CASE WHEN abs(max(number)) < 1e12 THEN round(max(number), 3) ELSE max(number) END AS largest FROM s GROUP BY 1""",
    "value_parse": f"""{_EV} SELECT event_id, CASE WHEN shape IN (0, 1) THEN x::BIGINT END AS whole, CASE WHEN shape IN (0, 1) THEN x::DOUBLE WHEN shape = 6 THEN x::DOUBLE * 10 END AS number,
        CASE WHEN shape = 4 OR (shape IN (0, 1) AND x = '1') THEN true WHEN shape = 5 OR (shape IN (0, 1) AND x = '0') THEN false END AS flag, CASE shape WHEN 2 THEN 'mm' WHEN 3 THEN 'to 50 V' END AS unit,
        CASE WHEN shape = 3 AND x::DOUBLE <= 50 THEN x::DOUBLE END AS lo, CASE WHEN shape = 3 AND x::DOUBLE <= 50 THEN 50.0::DOUBLE END AS hi FROM r""",
    "redact_secrets": """WITH x AS (SELECT doc_id, regexp_replace(text, '\\b(api[-_]?key|access[-_]?token|refresh[-_]?token|id[-_]?token|auth|authorization|token|key|password|secret|signature)=([^&\\s"'']+)', '\\1=[REDACTED]', 'gi') AS t FROM documents)
        SELECT doc_id, sha256(t) AS sha, contains(t, '[REDACTED]') AS redacted FROM x""",
    "sensitive_keys": "SELECT ['API-Key', 'client_secret', 'Set Cookie', 'user', 'pass.word', 'tokens', 'key'][event_id % 7 + 1] AS name, [true, true, true, false, true, false, true][event_id % 7 + 1] AS sensitive, count(*) AS n FROM events GROUP BY 1, 2",
    "replay_keys": f"SELECT event_id, {_KEY_SQL} AS key FROM events",
    "replay_join": f"""WITH e AS (SELECT *, {_KEY_SQL} AS key FROM events), r AS (SELECT key, event_id FROM e WHERE event_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1)
        SELECT e.event_id, r.event_id AS record, CASE WHEN r.event_id IS NULL THEN 'MISS' ELSE 'HIT' END AS outcome FROM e LEFT JOIN r USING (key) WHERE e.event_id % 3 = 0""",
    "class_search": f"""WITH p AS (SELECT p_partkey AS pid, {_WORDS("concat(p_name, ' ', p_type)")} AS pw FROM part), q AS (SELECT p_partkey AS qid, {_WORDS('p_type')} AS qw FROM part WHERE p_partkey % 100 = 0),
        s AS (SELECT qid, pid, len(list_intersect(pw, qw)) AS b, len(pw) AS np, len(qw) AS nq FROM p, q), t AS (SELECT qid, pid, round(b / (np + nq - b) + 0.25 * b / np, 9) AS score FROM s WHERE b > 0)
        SELECT qid AS query_id, pid AS phrase_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS position FROM t QUALIFY position <= 5""",
    "neighbour_frame": "SELECT conv_id, turn, role FROM conversations QUALIFY max(CASE WHEN length(text) > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1",
    "overlapping_positions": """WITH RECURSIVE r AS (SELECT doc_id, 0 AS k, instr(text, 'anan') AS pos, substr(text, instr(text, 'anan') + 1) AS rest FROM documents WHERE contains(text, 'anan')
        UNION ALL SELECT doc_id, k + 1, pos + instr(rest, 'anan'), substr(rest, instr(rest, 'anan') + 1) FROM r WHERE contains(rest, 'anan'))
        SELECT doc_id, count(*) AS n, string_agg(pos, ',' ORDER BY k) AS places FROM r GROUP BY doc_id""",
}
