"""Queries of sections and progress, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sections as S
from ..streaming import progress as P
from .catalog import query

_SPEC = {
    "spec_version": "1",
    "sections": [
        {"section_id": "cover_page", "display_name": "widget"},
        {"section_id": "cold_store", "display_name": "Cold", "aliases": ["small"], "bands": ["top_of_page", "mid_page"]},
        {"section_id": "rods", "display_name": "Rods", "regex": ["(hot|old) rod"], "bands": ["mid_page"], "requires_emphasis_for_mid_page": False},
        {"section_id": "rings", "display_name": "Rings", "regex": ["ring$"], "bands": ["top_of_table", "top_of_page"]},
    ],
}


def _part_lines(t):
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    y = (F.col("p_partkey") % 10) / F.lit(10.0)
    return t.part.select(
        F.col("p_brand").alias("doc_id"), F.col("p_size").cast("int").alias("page"), F.col("p_partkey").cast("int").alias("ordinal"), name.alias("line"), y.alias("y"), (F.col("p_partkey") % 2 == 0).alias("layout")
    )


@query(
    "fn23_section_candidates",
    "WITH l AS (SELECT p_brand AS d, p_size AS p, p_partkey AS o, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS t, lower(p_name) AS n, p_partkey % 10 <= 2 AS top, p_partkey % 2 = 0 AS lay, p_partkey % 3 = 0 AS em FROM part), "
    "c AS (SELECT *, 'cover_page' AS s, 0 AS r, CASE WHEN n LIKE '%widget' THEN CASE WHEN top THEN 1.0 ELSE 0.7 END END AS k FROM l WHERE p = 1 AND (NOT lay OR top) "
    "UNION ALL SELECT *, 'cold_store', 1, CASE WHEN n LIKE 'cold %' THEN CASE WHEN top THEN 1.0 ELSE 0.7 END WHEN n LIKE 'small %' THEN 0.4 END FROM l WHERE NOT lay OR top OR em "
    "UNION ALL SELECT *, 'rods', 2, CASE WHEN n IN ('hot rod', 'old rod', 'cold rod') THEN CASE WHEN top THEN 0.85 ELSE 0.7 END END FROM l WHERE NOT lay OR NOT top "
    "UNION ALL SELECT *, 'rings', 3, CASE WHEN n LIKE '%ring' THEN CASE WHEN top THEN 0.85 ELSE 0.7 END END FROM l WHERE NOT lay OR top) "
    "SELECT d AS doc_id, CAST(p AS INTEGER) AS page, s AS section_id, r AS rank, CAST(k AS DOUBLE) AS confidence, CASE WHEN top THEN 'top_of_page' ELSE 'mid_page' END AS band, CAST(o AS INTEGER) AS ordinal, t AS matched_text "
    "FROM c WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY d, p, s ORDER BY k DESC, o) = 1",
)
def _(t):
    return S.section_candidates(_part_lines(t), S.sections_of(_SPEC))


@query(
    "jn6_pages_with_sections",
    "WITH s AS (SELECT l_orderkey AS d, l_linenumber AS o, l_partkey AS k, l_returnflag AS f, CAST(l_quantity AS INTEGER) AS a FROM lineitem) "
    "SELECT p.d AS doc_id, p.page, last(s.k ORDER BY s.o, s.k) AS section_id, last(s.f ORDER BY s.o, s.k) AS family FROM (SELECT o_orderkey AS d, unnest(generate_series(1, 60)) AS page FROM orders) p "
    "LEFT JOIN s ON s.d = p.d AND p.page BETWEEN s.a AND s.a + 5 GROUP BY 1, 2",
)
def _(t):
    pages = t.orders.select(F.col("o_orderkey").alias("doc_id")).repartition("doc_id").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(60).cast("long"))).alias("page"))
    start = F.col("l_quantity").cast("int")
    found = t.lineitem.select(
        F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey").alias("ordinal"), start.alias("start_page"), (start + 5).alias("end_page"), F.col("l_partkey").alias("section_id"), F.col("l_returnflag").alias("family")
    )
    return S.pages_with_sections(pages, found, ["section_id", "family"])


@query(
    "top3_section_order",
    "SELECT c_nationkey AS doc_id, c_mktsegment AS group_kind, c_name AS id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END, c_name) AS INTEGER) AS place FROM customer",
)
def _(t):
    rows = t.customer.select(F.col("c_nationkey").alias("doc_id"), F.col("c_mktsegment").alias("group_kind"), F.col("c_name").alias("id"))
    return S.in_section_order(rows, ["MACHINERY", "BUILDING"])


@query(
    "str3_throttled_progress",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id AS seq, CAST(floor(value) AS INTEGER) AS percent, event_type AS label, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL),
r AS (SELECT * FROM (WITH RECURSIVE w AS (
  SELECT key, k, epoch_us(ts) AS t0, percent AS peak, true AS passes FROM e WHERE k = 1
  UNION ALL SELECT key, k, CASE WHEN p THEN t1 ELSE t0 END, CASE WHEN p THEN greatest(peak, percent) ELSE peak END, p
  FROM (SELECT e.key, e.k, w.t0, w.peak, e.percent, epoch_us(e.ts) AS t1, e.percent = 100 OR e.percent >= w.peak + 5 OR epoch_us(e.ts) - w.t0 >= 3600000000 AS p FROM w JOIN e ON e.key = w.key AND e.k = w.k + 1))
SELECT * FROM w))
SELECT e.key, ts, seq, percent, label FROM e JOIN r ON r.key = e.key AND r.k = e.k WHERE passes""",
)
def _(t):
    percent = F.floor(F.col("value")).cast("int")
    return P.throttled(t.events.select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").cast("long").alias("seq"), percent.alias("percent"), F.col("event_type").alias("label")), 3600.0)
