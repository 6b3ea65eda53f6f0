"""The registered queries of the numbered operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from catalith.llm.common import table
from catalith.llm.exact_dedup import exact_dedup
from catalith.llm.impact_index import ranked_search
from catalith.llm.language_id import language_id
from catalith.llm.line_dedup import dedup_lines
from catalith.llm.mixing import mixture
from catalith.llm.ngram_join import jaccard_classes
from catalith.llm.packing import pack
from catalith.llm.pii import find_pii
from catalith.llm.quality import quality_rules
from catalith.llm.sentencepiece_lattice import encode
from catalith.llm.sharding import shard_documents
from catalith.llm.url_filter import filter_urls
from catalith.llm.whitening import whiten


def op1_sentencepiece(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"))


def op2_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op7_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op8_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_impact_search(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_mixing(spark, sf_dir):
    return mixture(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_url_filter": op2_url_filter,
    "op3_quality_rules": op3_quality_rules,
    "op4_pii": op4_pii,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_packing": op6_packing,
    "op7_sharding": op7_sharding,
    "op8_language_id": op8_language_id,
    "op9_ngram_join": op9_ngram_join,
    "op10_line_dedup": op10_line_dedup,
    "op11_whitening": op11_whitening,
    "op12_impact_search": op12_impact_search,
    "op13_mixing": op13_mixing,
}

#: Where DuckDB can say the same. It has no CRC-32, no xxhash64 and no models; those queries are tested against brute force.
ORACLE_SQL = {
    "op5_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY norm)
    """,
    "op9_ngram_join": """
        WITH RECURSIVE texts AS (
            SELECT coalesce(text, '') AS text, min(doc_id) AS rep_id, count(*) AS n_copies FROM documents GROUP BY 1
        ), worded AS (
            SELECT rep_id, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda w: w <> '') AS w FROM texts
        ), grams AS (
            SELECT DISTINCT rep_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
            FROM worded
        ), sizes AS (
            SELECT rep_id, count(*) AS n FROM grams GROUP BY 1
        ), shared AS (
            SELECT a.rep_id AS a, b.rep_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.rep_id <> b.rep_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM shared JOIN sizes x ON x.rep_id = a JOIN sizes y ON y.rep_id = b WHERE c >= 0.8 * (x.n + y.n - c)
        ), reach(rep_id, other) AS (
            SELECT rep_id, rep_id FROM texts UNION SELECT r.rep_id, l.b FROM reach r JOIN links l ON l.a = r.other
        ), classes AS (
            SELECT rep_id, min(other) AS class_id FROM reach GROUP BY 1
        ), counted AS (
            SELECT a AS rep_id, count(*) AS n FROM links GROUP BY 1
        )
        SELECT d.doc_id, t.rep_id, k.class_id, coalesce(n.n, 0) AS n_links, t.n_copies
        FROM documents d JOIN texts t ON t.text = coalesce(d.text, '') JOIN classes k USING (rep_id) LEFT JOIN counted n USING (rep_id)
    """,
    "op10_line_dedup": """
        WITH docs AS (
            SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
        ), exploded AS (
            SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS ln FROM docs
        ), summed AS (
            SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY ln) AS cum
            FROM (SELECT doc_id, line, ln, len(regexp_extract_all(line, '[^ \t-\r]+')) AS w FROM exploded)
        ), pairs AS (
            SELECT x.doc_id, x.ln AS a, y.ln AS b FROM summed x JOIN summed y ON x.doc_id = y.doc_id AND x.ln <= y.ln AND y.cum - x.cum + x.w >= 50
        ), runs AS (
            SELECT doc_id, a, min(b) AS b FROM pairs GROUP BY 1, 2 UNION SELECT doc_id, max(a), b FROM pairs GROUP BY doc_id, b
        ), worded AS (
            SELECT r.doc_id, a, b, array_to_string(lines[a:b], chr(10)) AS content FROM runs r JOIN docs USING (doc_id)
        ), placed AS (
            SELECT doc_id, a, b, first_value(doc_id) OVER f AS first_doc, first_value(a) OVER f AS first_a
            FROM worded WINDOW f AS (PARTITION BY content ORDER BY doc_id, a ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
        ), copies AS (
            SELECT doc_id, a, b FROM placed WHERE first_doc <> doc_id OR first_a + b - a < a
        ), gone AS (
            SELECT DISTINCT e.doc_id, e.ln FROM exploded e JOIN copies c ON c.doc_id = e.doc_id AND e.ln BETWEEN c.a AND c.b
        ), kept AS (
            SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.ln) AS text, count(*) AS n FROM exploded e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.ln = e.ln GROUP BY 1
        )
        SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
               coalesce(len(d.lines), 0) AS n_lines, coalesce(len(d.lines), 0) - coalesce(k.n, 0) AS n_removed
        FROM docs d LEFT JOIN kept k USING (doc_id)
    """,
    "op12_impact_search": r"""
        WITH lower AS (
            SELECT doc_id, row_number() OVER () AS d, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), worded AS (
            SELECT doc_id, d, regexp_extract_all(t, '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM lower
        ), totals AS (
            SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM worded WHERE len(w) > 0
        ), held AS (
            SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM worded) GROUP BY 1, 2
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM held, totals GROUP BY term, n_docs
        ), asked AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark
        ), scored AS (
            SELECT a.item_id, x.doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(x.w) * n_docs) // n_terms)))) AS BIGINT) AS score
            FROM asked a JOIN held h USING (term) JOIN weights USING (term) JOIN worded x USING (d), totals GROUP BY a.item_id, x.d, x.doc_id
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
    """,
    "op13_mixing": """
        WITH RECURSIVE sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS size FROM documents
        ), summed AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1
        ), weighed AS (
            SELECT source, source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM summed
        ), rounds(k, room, weight) AS (
            SELECT 0, CAST(sum(source_size) AS DOUBLE), CAST(sum(w) AS DOUBLE) FROM weighed
            UNION ALL
            SELECT r.k + 1, (SELECT sum(CASE WHEN r.room * w / r.weight > 3 * source_size THEN -2 * source_size ELSE source_size END) FROM weighed),
                   (SELECT sum(CASE WHEN r.room * w / r.weight > 3 * source_size THEN 0 ELSE w END) FROM weighed)
            FROM rounds r WHERE r.k < 50
        ), targets AS (
            SELECT source, source_size, least(3.0 * source_size, room * w / weight) AS target FROM weighed, (SELECT * FROM rounds ORDER BY k DESC LIMIT 1)
        ), laid AS (
            SELECT doc_id, s.source, size, source_size, target, least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) AS quota,
                   sum(size) OVER (PARTITION BY s.source ORDER BY md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':0')), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, source, size, source_size, target,
               CAST(CASE WHEN source_size = 0 THEN 0 ELSE quota // source_size * size + greatest(0, least(start + size, quota % source_size) - start) END AS BIGINT) AS taken
        FROM laid
    """,
}
