"""Queries of ports, sidecars, trails, records and images, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..durable import fresh
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import classify as C
from ..operators import sections as S
from ..sources import audit as T
from ..sources import ingest as I
from .catalog import query


def _first_section(batch):
    """A model that picks a rule's first section, and has no answer for odd documents."""
    import json

    return [{"id": r["id"], "sections": [str(r["sections"][0]["section_id"])], "applicable": True, "reason": "first"} for r in batch if int(json.loads(r["id"])[0]) % 2 == 0]


@query(
    "jn9_rule_sections",
    "WITH s AS (SELECT DISTINCT l_orderkey AS d, l_suppkey AS i FROM lineitem), q AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS r FROM lineitem WHERE l_linenumber % 3 <> 0) "
    "SELECT q.d AS doc_id, q.r AS rule_id, CAST(s.i AS VARCHAR) AS section_id, true AS applicable, CASE WHEN q.d % 2 = 0 THEN 'first' ELSE 'no resolution; all sections' END AS reason FROM q JOIN s ON s.d = q.d AND (q.d % 2 = 1 OR s.i = (SELECT min(x.i) FROM s x WHERE x.d = q.d))",
)
def _(t):
    l = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("rule_id"), F.col("l_suppkey").alias("section_id"))
    wanted = F.when(F.col("rule_id") % 3 != 0, F.array(F.lit("any"))).otherwise(F.array().cast("array<string>"))
    rules = l.select("doc_id", "rule_id").distinct().select("doc_id", "rule_id", F.lit("text").alias("text"), wanted.alias("wanted"))
    sections = l.select("doc_id", "section_id").distinct().withColumn("name", F.lit("name"))
    return S.resolve_sections(rules, sections, _first_section)


def _by_length(batch):
    """A model that judges a page by its length, and never answers rule r3."""
    return [{"id": r["id"], "results": [{"rule_id": x["rule_id"], "status": "compliant" if len(r["text"]) % 2 == 0 else "non_compliant", "reason": x["rule"]} for x in r["rules"] if x["rule_id"] != "r3"]} for r in batch]


@query(
    "rul12_page_evaluation",
    "WITH p AS (SELECT conv_id, CAST(turn AS INTEGER) AS page, min(role) AS role, min(text) AS text FROM conversations GROUP BY 1, 2), r(agent, rule_id) AS (VALUES ('user', 'r1'), ('user', 'r2'), ('user', 'r3'), ('assistant', 'r3'), ('assistant', 'r4')) "
    "SELECT conv_id AS doc_id, page, rule_id, CASE WHEN rule_id = 'r3' THEN 'error' WHEN length(text) % 2 = 0 THEN 'compliant' ELSE 'non_compliant' END AS status, CASE WHEN rule_id = 'r3' THEN 'no answer' ELSE 'rule ' || rule_id END AS reason FROM p JOIN r ON r.agent = p.role",
)
def _(t):
    rules = t.values([(a, r, f"rule {r}") for a, r in (("user", "r1"), ("user", "r2"), ("user", "r3"), ("assistant", "r3"), ("assistant", "r4"))], "agent string, rule_id string, text string")
    pages = t.conversations.groupBy(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page")).agg(F.min("role").alias("agent"), F.min("text").alias("text"))
    return S.evaluate_pages(rules, pages, _by_length, size=2)


@query("src4_first_text", "SELECT p_partkey, p_name || ' ' || p_type AS text FROM part")
def _(t):
    content = F.concat(F.encode("p_name", "UTF-8"), F.unhex(F.lit("00FF616263E9")), F.encode("p_type", "UTF-8"))
    return t.part.select("p_partkey", I.first_text(content).alias("text"))


@query(
    "src8_labelled_fields",
    "SELECT o AS l_orderkey, field, arg_min(v, (page, n)) AS value FROM (SELECT l_orderkey AS o, CASE WHEN l_returnflag IN ('R', 'A') THEN 'batch' ELSE 'yield' END AS field, l_linenumber AS page, l_partkey * 10000000 + l_suppkey * 100 + l_quantity AS n, CAST(l_quantity AS VARCHAR) AS v FROM lineitem WHERE l_quantity > 5 AND l_tax > 0.01) GROUP BY 1, 2",
)
def _(t):
    key = F.when(F.col("l_returnflag") == "R", " Batch No").when(F.col("l_returnflag") == "A", "LOT ").otherwise("yield")
    value = F.when(F.col("l_quantity") > 5, F.col("l_quantity").cast("string")).otherwise(" ")
    kv = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("page"), (F.col("l_partkey") * 10000000 + F.col("l_suppkey") * 100 + F.col("l_quantity")).alias("ordinal"), F.when(F.col("l_tax") > 0.01, key).otherwise("unlabelled").alias("key"), value.alias("value"))
    labels = t.values([("batch no", "batch"), ("Lot", "batch"), ("yield ", "yield")], "label string, field string")
    return C.first_labelled(kv, labels, "l_orderkey")


@query("src9_ocr_sidecars", "SELECT page_id AS page, length(html) AS n FROM pages")
def _(t):
    path = fresh(t.spark, "sidecars")
    rows = t.pages.select(F.col("page_id").alias("page"), F.length("html").cast("long").alias("n"))
    T.write_ocr(rows.where("page < 0"), path, "p")
    T.write_ocr(rows, path, "p")
    return T.read_ocr(t.spark, path, "p").select("page", "n")


@query("dsl15_audit_trail", "SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS doc_id, CAST(o_orderkey % 5 AS INTEGER) AS page, o_orderpriority AS new_value, strftime(o_orderdate, '%Y-%m-%d') AS at FROM orders")
def _(t):
    trail = T.AuditTrail(t.spark, fresh(t.spark, "trail"))
    entries = t.orders.select(
        F.col("o_orderkey").cast("string").alias("doc_id"), (F.col("o_orderkey") % 5).cast("int").alias("page"), F.lit("f").alias("field_path"), F.lit(None).cast("string").alias("original_value"),
        F.col("o_orderpriority").alias("new_value"), F.lit("r").alias("reason"), F.lit("qa").alias("reviewer"), F.col("o_orderdate").alias("at"),
    )
    trail.log(entries)
    trail.log(entries.where("page = 1"))
    return trail.entries().select("doc_id", "page", "new_value", F.date_format("at", "yyyy-MM-dd").alias("at"))


@query(
    "fn7_records",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'batch_date' ELSE 'item_name' END AS key, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN o_orderstatus = 'F' THEN 'N/A' WHEN o_orderstatus = 'O' THEN '5 kg' ELSE 'tbd' END AS value, o_orderkey % 2 = 1 AND o_orderstatus <> 'O' AS is_placeholder, o_orderkey % 2 = 1 AND o_orderstatus = 'F' AS allowed FROM orders",
)
def _(t):
    even = F.col("o_orderkey") % 2 == 0
    value = F.when(even, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderstatus") == "F", "N/A").when(F.col("o_orderstatus") == "O", "5 kilograms").otherwise("tbd")
    r = X.normalised_record(F.when(even, "Batch  Date:").otherwise("Item name"), value, ["N/A", "TBD"], ["n/a"])
    return t.orders.select("o_orderkey", r["key"].alias("key"), r["value"].alias("value"), r["is_placeholder"].alias("is_placeholder"), r["allowed"].alias("allowed"))


@query("top5_confusions", "SELECT l_returnflag AS before, l_linestatus AS after, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, before, after LIMIT 4")
def _(t):
    return A.confusion_pairs(t.lineitem.select(F.col("l_returnflag").alias("before"), F.col("l_linestatus").alias("after")), 4)


@query("flt11_coloured", "SELECT p_partkey AS id, p_size % 3 <> 0 AS has_colour FROM part")
def _(t):
    rgb = F.when(F.col("p_size") % 3 == 0, F.repeat(F.lit("808182"), 50)).when(F.col("p_size") % 3 == 1, F.concat(F.repeat(F.lit("808080"), 49), F.lit("FF0000")))
    return S.coloured(t.part.select(F.col("p_partkey").alias("id"), F.unhex(rgb).alias("rgb")))
