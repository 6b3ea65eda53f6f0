"""Queries over tables read from words and rules, with their SQL twins: each order is a page, each line item a row of words."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.operators import records as R
from catalith.operators import ruled as T
from catalith.plans.catalog import read
from catalith.plans.records import _items, _table_claims

HEADER = ("Part", "Size", "Weight", "Flag")


def _words(spark, sf_dir):
    """Words of each order's page: a header inside the rules, rows below them, a footer of one word."""
    n, at = F.col("n"), F.lit
    word = lambda column, text, dx: F.struct(text.alias("text"), at(60.0 + 100 * column + dx).alias("x0"), at(80.0 + 100 * column + dx).alias("x1"))
    cells = F.array(word(0, F.concat(F.lit("q-"), F.col("l_partkey").cast("string")), 0), word(1, F.col("l_quantity").cast("int").cast("string"), 0), word(1, F.lit("mm"), 40), word(2, n.cast("string"), 0), word(2, F.lit("kg"), 40), word(3, F.when(F.col("l_partkey") % 3 != 0, F.col("l_returnflag")), 0))
    body = _items(spark, sf_dir).select(F.col("l_orderkey").alias("page"), (F.lit(140.0) + 10 * n + F.col("l_suppkey") % 3).alias("top"), F.inline(cells)).where("text IS NOT NULL")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"))
    heads = F.array(*[word(i, F.lit(h), 0) for i, h in enumerate(HEADER)])
    head = orders.select("page", F.lit(105.0).alias("top"), F.inline(heads))
    foot = orders.select("page", F.lit(139.0 + 10 * 5).alias("top"), F.inline(F.array(word(0, F.lit("Total"), 0)))).where("page % 5 = 0")
    return body.unionByName(head).unionByName(foot).select("page", "text", "x0", "x1", "top")


def _rules(spark, sf_dir):
    xs = F.array(*[F.lit(50.0 + 100 * i) for i in range(5)], F.lit(151.0))
    return read(spark, sf_dir, "orders").where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("page"), F.explode(xs).alias("x"), F.lit(100.0).alias("top"), F.lit(130.0).alias("bottom"))


def ruled_cells(spark, sf_dir):
    out = T.ruled_tables(_words(spark, sf_dir), _rules(spark, sf_dir))
    return out.select("page", F.col("row_index").cast("long").alias("row_index"), F.col("column_index").cast("long").alias("column_index"), "is_header", "text").where("text <> ''")


def ruled_pages(spark, sf_dir):
    pages = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"))
    return T.page_tables(pages, _words(spark, sf_dir), _rules(spark, sf_dir))


def ruled_row_evidence(spark, sf_dir):
    """Claims whose product a row of a table read from words names."""
    out = R.evidence_in_rows(_table_claims(spark, sf_dir), T.ruled_rows(_words(spark, sf_dir), _rules(spark, sf_dir)))
    return out.select("claim_id", F.col("row_index").cast("long").alias("row_index"), "identity_cell", "text")


QUERIES = {f.__name__: f for f in (ruled_cells, ruled_pages, ruled_row_evidence)}

#: Rows are 10 points apart and shifted by up to 2, so each line item is a row of its own; the footer lies a point above the fifth, so it joins it or ends the table.
_ROWS = """
    items AS (
        SELECT l_orderkey AS page, l_partkey AS p, l_quantity::INT AS q, l_returnflag AS flag, 140.0 + 10 * row_number() OVER w + l_suppkey % 3 AS top, row_number() OVER w AS n
        FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)
    ), pieces AS (
        SELECT page, top, n, 'q-' || p AS part, q || ' mm' AS size, n || ' kg' AS weight, CASE WHEN p % 3 <> 0 THEN flag ELSE '' END AS flag FROM items WHERE page % 11 <> 0
        UNION ALL SELECT o_orderkey, 189.0, 0, 'Total', '', '', '' FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 11 <> 0
    ), near AS (
        SELECT *, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY top RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) > 0 AND n > 0 AS joins,
               n = 0 AND count(*) OVER (PARTITION BY page ORDER BY top RANGE BETWEEN CURRENT ROW AND 3 FOLLOWING) = 1 AND count(*) OVER (PARTITION BY page ORDER BY top RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) = 1 AS ends FROM pieces
    ), cut AS (
        SELECT *, max(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY top, n) AS ended FROM near
    ), body AS (
        SELECT page, row_number() OVER (PARTITION BY page ORDER BY top) AS row_index, false AS is_header, [CASE WHEN joins THEN 'Total ' || part ELSE part END, size, weight, flag] AS cells FROM cut WHERE ended = 0 AND n > 0
    ), grid AS (
        SELECT * FROM body UNION ALL SELECT o_orderkey, 0, true, ['Part', 'Size', 'Weight', 'Flag'] FROM orders WHERE o_orderkey % 11 <> 0
    )
"""
ORACLE_SQL = {
    "ruled_cells": f"WITH {_ROWS} SELECT page, row_index, column_index, is_header, text FROM (SELECT page, row_index, is_header, unnest(range(0, 4)) AS column_index, unnest(cells) AS text FROM grid) WHERE text <> ''",
    "ruled_pages": "SELECT o_orderkey AS page, CASE WHEN o_orderkey % 11 = 0 THEN 'NO_TABLE_STRUCTURE' ELSE 'TABLES_EXTRACTED' END AS status, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1 END::BIGINT AS tables FROM orders",
    "ruled_row_evidence": f"""
        WITH {_ROWS}, claims AS (SELECT l_orderkey || '-' || n AS claim_id, l_orderkey AS page, l_partkey AS p FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem))
        SELECT claim_id, row_index, cells[1] AS identity_cell, trim('Part Size Weight Flag ' || array_to_string(list_filter(cells, lambda c: c <> ''), ' ')) AS text FROM claims c JOIN grid g ON g.page = c.page AND g.cells[1] = 'q-' || c.p WHERE c.p % 7 <> 0 AND NOT is_header
    """,
}
