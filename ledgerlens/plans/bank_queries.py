"""Queries of rule banks, page validation and orders, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X
from ..operators import rules as R
from ..sources import ingest as I
from . import bank as B
from . import dsl
from .catalog import query

_FILES = [
    ("a.json", '{"defaults": {"version": "1.0", "severity": "major"}, "rules": [{"id": "present", "scope": "same_page", "source_field": "qty"}], "categories": {"sums": {"defaults": {"scope": "page_aggregate", "aggregation": "sum"}, "rules": [{"id": "sum", "source_field": "qty", "target_field": "want", "tol_kind": "absolute", "tolerance": 30.0}, {"id": "odd", "source_field": "qty", "severity": "info", "aggregation": "median"}]}}}'),
    ("b.json", '{"id": "all", "version": "1.0", "scope": "synthesis", "parts": ["sum", "present"], "colour": "red"}'),
    ("c.json", "{"), ("d.json", '{"id": "old", "version": "1.0", "scope": "same_page", "source_field": "x", "deprecated": true, "superseded_by": "older"}'),
    ("e.json", '{"id": "all", "version": "1.0", "scope": "synthesis", "parts": ["sum", "present"]}'),
]


def _packet(t):
    doc = F.col("l_orderkey").cast("string").alias("doc_id")
    page, ordinal = F.col("l_linenumber").alias("page"), F.col("l_partkey").cast("int").alias("ordinal")
    none = F.lit(None).cast("string").alias("entity")
    lines = t.lineitem.where("l_returnflag = 'R'").select(doc, page, ordinal, F.lit("qty").alias("field"), none, F.col("l_quantity").cast("string").alias("value"))
    want = t.lineitem.select(doc).distinct().select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("ordinal"), F.lit("want").alias("field"), none, F.lit("50").alias("value"))
    return {"fields": lines.unionByName(want), "pages": t.lineitem.select(doc, page).distinct()}


@query(
    "dsl6_fixture_run",
    "WITH p AS (SELECT l_orderkey AS d, l_linenumber AS page, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS has FROM lineitem GROUP BY 1, 2) "
    "SELECT 'present' AS rule_id, CAST(d AS VARCHAR) AS doc_id, page, 'open' AS status, CASE WHEN has = 0 THEN 'open' END AS got, has = 0 AS ok FROM p",
)
def _(t):
    tables = _packet(t)
    expected = tables["pages"].select(F.lit("present").alias("rule_id"), "doc_id", "page", F.lit("open").alias("status"))
    return B.fixture_run([r for r in B.load(_FILES).rules if r.id == "present"], tables, expected)


@query(
    "rul10_reevaluated",
    "WITH l AS (SELECT l_orderkey AS d, l_linenumber AS page, l_quantity AS v FROM lineitem WHERE l_returnflag = 'R'), fixed AS (SELECT o_orderkey AS d FROM orders WHERE o_orderstatus = 'F'), "
    "g AS (SELECT d, sum(v) AS s, d IN (SELECT d FROM fixed) AS c FROM l GROUP BY 1), m AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS page FROM lineitem EXCEPT SELECT d, page FROM l), "
    "s AS (SELECT d, c, CASE WHEN abs(s - 50) <= 30 THEN 'pass' ELSE 'open' END AS a, CASE WHEN abs(s - 90) <= 30 THEN 'pass' ELSE 'open' END AS b FROM g), "
    "y AS (SELECT coalesce(s.d, x.d) AS d, coalesce(s.d, x.d) IN (SELECT d FROM fixed) AS c, CASE WHEN x.d IS NOT NULL OR s.a = 'open' THEN 'open' ELSE 'pass' END AS a, CASE WHEN x.d IS NOT NULL OR s.b = 'open' THEN 'open' ELSE 'pass' END AS b FROM s FULL JOIN (SELECT DISTINCT d FROM m) x ON x.d = s.d) "
    "SELECT rule_id, CAST(d AS VARCHAR) AS doc_id, CAST(NULL AS INTEGER) AS page, CASE WHEN c THEN b ELSE a END AS status, CASE WHEN NOT c THEN 'kept' WHEN a = b THEN 'confirmed' ELSE 'replaced' END AS change FROM (SELECT 'sum' AS rule_id, * FROM s UNION ALL SELECT 'all', * FROM y) "
    "UNION ALL SELECT 'present', CAST(d AS VARCHAR), page, 'open', 'kept' FROM m",
)
def _(t):
    tables, rules = _packet(t), B.load(_FILES).rules
    corrections = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.lit("want").alias("field"), F.lit("90").alias("value"))
    corrections = corrections.join(tables["pages"].select("doc_id").distinct(), "doc_id", "left_semi")
    return B.reevaluate(rules, tables, dsl.evaluate(rules, tables), corrections).drop("finding_id", "severity")


@query("rul6_unevaluated", "SELECT 'R' || p_partkey AS rule_id, 'unevaluated' AS status, '__rule__' AS doc_id, 1 AS page, 'rule_source' AS field, 'rule:R' || p_partkey || '@' || coalesce(nullif('1.' || p_size, '1.7'), '0.0.0') AS note FROM part")
def _(t):
    version = F.when(F.col("p_size") != 7, F.concat(F.lit("1."), F.col("p_size").cast("string")))
    rules = t.part.select(F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("rule_id"), version.alias("version"))
    return R.unevaluated(rules, F.lit("no inputs")).select("rule_id", "status", "evidence.*")


_BAD_YEAR = "len(list_filter(list_transform(regexp_extract_all(text, '\\b(\\d{1,2})[/\\-.](\\d{1,2})[/\\-.](\\d{2,4})\\b', 3), lambda y: y::INT + CASE WHEN length(y) > 2 THEN 0 WHEN y::INT < 50 THEN 2000 ELSE 1900 END), lambda y: y < 2000 OR y > 2027))"
_BAD_QTY = "len(list_filter(list_transform(regexp_extract_all(text, '(?i)(?:qty|quantity|weight|volume)[:\\s]*(-?[\\d,.]+)\\s*(?:kg|g|ml|l|mg)\\b', 1), lambda q: try_cast(replace(q, ',', '') AS DOUBLE)), lambda q: q < 0 OR q > 1000000))"


@query(
    "fn9_page_validation",
    f"SELECT id, 3 AS checked, CAST((y = 0)::INT + (q = 0)::INT + (n > 20)::INT AS INTEGER) AS passed, CAST(y + q + (n <= 20)::INT AS INTEGER) AS failures FROM (SELECT id, {_BAD_YEAR} AS y, {_BAD_QTY} AS q, length(trim(text, E' \\t\\r\\n\\f\\x0b')) AS n "
    "FROM (SELECT 'd' || doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'o' || o_orderkey, strftime(o_orderdate, '%d/%m/%y') || ' Weight: ' || CAST(o_orderkey - 500 AS VARCHAR) || ' kg' FROM orders))",
)
def _(t):
    made = F.concat(F.date_format("o_orderdate", "dd/MM/yy"), F.lit(" Weight: "), (F.col("o_orderkey") - 500).cast("string"), F.lit(" kg"))
    pages = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    pages = pages.unionByName(t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), made.alias("text")))
    v = X.validated(F.col("text"), 2026)
    return pages.select("id", v["checked"].alias("checked"), v["passed"].alias("passed"), F.size(v["failures"]).alias("failures"))


@query("top3_ranked_sections", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END, CAST(c_custkey AS VARCHAR)) AS INTEGER) AS place FROM customer")
def _(t):
    rank = S.rank(F.col("c_mktsegment"), {"BUILDING": 0, "MACHINERY": 1})
    order = Window.partitionBy("c_nationkey").orderBy(F.when(rank < 0, 2).otherwise(rank), F.col("c_custkey").cast("string"))
    return t.customer.select("c_custkey", F.row_number().over(order).alias("place"))


@query("src3_looks_like_pdf", "SELECT p_partkey, p_size % 3 = 0 OR ends_with(lower(p_name), 'e') AS pdf FROM part")
def _(t):
    kind = F.when(F.col("p_size") % 3 == 0, "Application/PDF; x=1").when(F.col("p_size") % 3 == 1, "text/plain")
    name = F.when(F.endswith(F.lower("p_name"), F.lit("e")), F.concat("p_name", F.lit(".PDF"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", I.looks_like_pdf(name, kind).alias("pdf"))


@query("rul20_text_primary", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_totalprice > 200000 THEN 'non_compliant' WHEN o_orderstatus = 'P' THEN 'uncertain' ELSE 'compliant' END AS status FROM orders")
def _(t):
    a = F.when(F.col("o_orderstatus") == "F", "non_compliant").when(F.col("o_orderstatus") == "P", "uncertain").otherwise("compliant")
    b = F.when(F.col("o_totalprice") > 200000, "non_compliant").otherwise("compliant")
    return t.orders.select("o_orderkey", S.strictly_worse(a, b).alias("status"))


@query("fn13_local_grade", "SELECT event_id, round((value / 100 + 0.9) / 2, 6)::DOUBLE AS mean, CASE WHEN (value / 100 + 0.9) / 2 >= 0.9 THEN 'excellent' WHEN (value / 100 + 0.9) / 2 >= 0.7 THEN 'good' WHEN (value / 100 + 0.9) / 2 >= 0.5 THEN 'fair' ELSE 'poor' END AS grade FROM events")
def _(t):
    g = S.quality_grade([F.col("value") / 100, F.lit(0.9)])
    return t.events.select("event_id", F.round(g["mean"], 6).alias("mean"), g["grade"].alias("grade"))
