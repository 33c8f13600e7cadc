"""Further rule, routing, enrichment and sink queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import scoring as S
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import external as E
from ..operators import joins as J
from ..operators import rules as R
from ..operators import sequences as W
from ..sources import ingest as I
from . import dsl
from .catalog import query
from .rule_queries import _SECTIONS, _sections


@query("jn5_span_pages", _SECTIONS + "SELECT s.conv_id, s.section_id, count(*) AS pages FROM s JOIN (SELECT DISTINCT conv_id, page FROM p) p ON p.conv_id = s.conv_id AND p.page BETWEEN s.a AND s.b GROUP BY 1, 2")
def _(t):
    pages, s = _sections(t)
    held = s.select("conv_id", "section_id", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    return held.join(pages.select("conv_id", "page").distinct(), ["conv_id", "page"]).groupBy("conv_id", "section_id").agg(F.count("*").alias("pages"))


@query("jn20_page_issues", "SELECT l_orderkey, l_linenumber, list_sort(list(DISTINCT l_returnflag)) AS issues FROM lineitem WHERE l_discount >= 0.09 GROUP BY 1, 2")
def _(t):
    return t.lineitem.where("l_discount >= 0.09").groupBy("l_orderkey", "l_linenumber").agg(F.array_sort(F.collect_set("l_returnflag")).alias("issues"))


@query("jn22_section_references", _SECTIONS + "SELECT conv_id, list_sort(list(DISTINCT page)) AS pages FROM (SELECT conv_id, CAST(unnest(range(a, b + 1)) AS INTEGER) AS page FROM s) GROUP BY 1")
def _(t):
    _, s = _sections(t)
    pages = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("start_page", "end_page")))))
    return s.groupBy("conv_id").agg(pages.alias("pages"))


@query("flt3_find_single", "SELECT o_custkey, any_value(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) = 1")
def _(t):
    one = t.orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.first("o_orderkey").alias("o_orderkey"))
    return one.where("n = 1").drop("n")


@query("flt7_prescreened_rules", "SELECT p_partkey, CASE WHEN p_size <= 25 THEN 'applicable' ELSE 'not_applicable' END AS status, CASE WHEN p_size <= 25 THEN NULL ELSE 1.0::DOUBLE END AS confidence FROM part")
def _(t):
    keep = t.part.where("p_size <= 25").select("p_partkey")
    out = t.part.select("p_partkey").join(keep, "p_partkey", "left_anti")
    return keep.select("p_partkey", F.lit("applicable").alias("status"), F.lit(None).cast("double").alias("confidence")).unionByName(
        out.select("p_partkey", F.lit("not_applicable").alias("status"), F.lit(1.0).alias("confidence"))
    )


@query("flt9_review_filters", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'O' AND o_totalprice > 100000 GROUP BY 1, 2")
def _(t):
    return t.orders.where("o_orderstatus <> 'O' AND o_totalprice > 100000").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("flt10_active_corrections", "SELECT event_id FROM events WHERE event_type = 'click' AND value > 10 ORDER BY event_id LIMIT 200 OFFSET 20")
def _(t):
    return t.events.where("event_type = 'click' AND value > 10").orderBy("event_id").offset(20).limit(200).select("event_id")


@query("flt12_feedback_samples", "SELECT event_id FROM events WHERE event_type = 'error'")
def _(t):
    filters = {"event_type": "error", "run": None}
    rows = t.events
    for name, value in filters.items():
        rows = rows.where(F.col(name) == value) if value is not None else rows
    return rows.select("event_id")


@query("agg23_correction_stats", "SELECT event_type AS context, count(*) AS n, count(DISTINCT user_id) AS docs FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.col("event_type").alias("context")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("docs"))


@query("agg24_telemetry", "SELECT 'role' AS dimension, role AS value, count(*) AS n FROM conversations GROUP BY 2 UNION ALL SELECT 'turn', CAST(turn AS VARCHAR), count(*) FROM conversations GROUP BY 2 UNION ALL SELECT 'all', NULL, count(*) FROM conversations")
def _(t):
    return A.grouping_counts(t.conversations, ["role", "turn"])


@query("fn26_canonical_types", "SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'vehicle' WHEN 'MACHINERY' THEN 'vehicle' WHEN 'BUILDING' THEN 'building' ELSE 'unknown' END AS kind, c_mktsegment NOT IN ('AUTOMOBILE', 'MACHINERY', 'BUILDING') AS drift FROM customer")
def _(t):
    alias = t.values([("AUTOMOBILE", "vehicle"), ("MACHINERY", "vehicle"), ("building", "building")], "variant string, canonical string")
    c = J.resolve_alias(t.customer, "c_mktsegment", alias)
    return c.select("c_custkey", F.coalesce("canonical", F.lit("unknown")).alias("kind"), F.col("canonical").isNull().alias("drift"))


@query("fn27_sole_owner", "SELECT l_orderkey, any_value(l_returnflag) AS owner FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) GROUP BY 1 HAVING count(*) = 1")
def _(t):
    owners = t.lineitem.select("l_orderkey", "l_returnflag").distinct()
    return owners.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.first("l_returnflag").alias("owner")).where("n = 1").drop("n")


@query("fn28_type_slugs", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def _(t):
    return t.part.select("p_partkey", X.slug(F.col("p_type")).alias("slug"))


@query("fn32_context_text", "SELECT conv_id, string_agg(role || ': ' || substr(text, 1, 50), chr(10) ORDER BY turn, role, text) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) WHERE n <= 3 GROUP BY 1")
def _(t):
    parts = F.slice(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), 1, 3)
    lines = F.transform(parts, lambda p: F.concat(p["role"], F.lit(": "), F.substring(p["text"], 1, 50)))
    return t.conversations.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("context"))


@query("fn35_markdown_tables", "SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def _(t):
    md = F.concat(F.lit("intro\n| s | p |\n|---|---|\n| "), "o_orderstatus", F.lit(" | "), "o_orderpriority", F.lit(" |\n\nend"))
    r = F.col("t")[0]["rows"][0]
    return t.orders.select("o_orderkey", M.markdown_tables(md).alias("t")).select("o_orderkey", r[0].alias("status"), r[1].alias("priority"))


@query("fn38_nested_pairs", "SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def _(t):
    return t.events.select("event_id", F.explode(M.json_pairs(F.col("props"))).alias("x")).select("event_id", "x.*")


@query("fn39_derived_rows", "SELECT l_orderkey, 'line' AS key, CAST(l_linenumber AS VARCHAR) AS value FROM lineitem UNION ALL SELECT l_orderkey, 'attested', 'yes' FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    l = t.lineitem
    base = l.select("l_orderkey", F.lit("line").alias("key"), F.col("l_linenumber").cast("string").alias("value"))
    return base.unionByName(l.where("l_returnflag = 'R'").select("l_orderkey", F.lit("attested").alias("key"), F.lit("yes").alias("value")))


@query("fn40_polygon_boxes", "SELECT l_orderkey, l_linenumber, l_linenumber AS page, l_quantity AS x1, l_quantity + 10 AS x2 FROM lineitem")
def _(t):
    l = t.lineitem
    q = F.col("l_quantity").cast("string")
    js = F.concat(F.lit('{"page": '), F.col("l_linenumber").cast("string"), F.lit(', "items": [{"type": "t", "polygon": ['), q, F.lit(", 0, "), (F.col("l_quantity") + 10).cast("string"), F.lit(", 5]}]}"))
    b = F.col("b")[0]
    return l.select("l_orderkey", "l_linenumber", M.json_boxes(js).alias("b")).select("l_orderkey", "l_linenumber", b["page"].alias("page"), b["x1"].alias("x1"), b["x2"].alias("x2"))


@query("fn49_export_gate", "SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'blocked' WHEN count(*) FILTER (WHERE o_orderkey % 13 = 0) > 0 THEN 'blocked-stale' ELSE 'ready' END AS gate FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(S.export_gate(F.count_if(F.col("o_orderstatus") == "P"), F.count_if(F.col("o_orderkey") % 13 == 0)).alias("gate"))


@query(
    "rul7_rule_bank",
    "WITH l AS (SELECT l_orderkey AS d, l_linenumber AS page, l_quantity AS v FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT d, CASE WHEN abs(sum(v) - 50) <= 30 THEN 'pass' ELSE 'open' END AS s FROM l GROUP BY 1), m AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS page FROM lineitem EXCEPT SELECT d, page FROM l) "
    "SELECT 'sum' AS rule_id, CAST(d AS VARCHAR) AS doc_id, CAST(NULL AS INTEGER) AS page, s AS status FROM g UNION ALL SELECT 'present', CAST(d AS VARCHAR), page, 'open' FROM m UNION ALL "
    "SELECT 'all', CAST(coalesce(g.d, x.d) AS VARCHAR), NULL, CASE WHEN x.d IS NOT NULL OR g.s = 'open' THEN 'open' ELSE 'pass' END FROM g FULL JOIN (SELECT DISTINCT d FROM m) x ON x.d = g.d",
)
def _(t):
    doc = F.col("l_orderkey").cast("string").alias("doc_id")
    page, ordinal = F.col("l_linenumber").alias("page"), F.col("l_partkey").cast("int").alias("ordinal")
    lines = t.lineitem.where("l_returnflag = 'R'").select(doc, page, ordinal, F.lit("qty").alias("field"), F.lit(None).cast("string").alias("entity"), F.col("l_quantity").cast("string").alias("value"))
    want = t.lineitem.select(doc).distinct().select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("ordinal"), F.lit("want").alias("field"), F.lit(None).cast("string").alias("entity"), F.lit("50").alias("value"))
    bank = [
        dsl.Rule("sum", "1.0", "page_aggregate", source_field="qty", target_field="want", aggregation="sum", tol_kind="absolute", tolerance=30.0),
        dsl.Rule("present", "1.0", "same_page", source_field="qty"),
        dsl.Rule("all", "1.0", "synthesis", parts=("sum", "present")),
    ]
    found = dsl.evaluate(bank, {"fields": lines.unionByName(want), "pages": t.lineitem.select(doc, page).distinct()})
    return found.select("rule_id", "doc_id", "page", "status")


@query("rul13_document_scope", "SELECT conv_id, arg_min(text, turn) AS first, arg_max(text, turn) AS last, count(*) AS pages FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2) GROUP BY 1")
def _(t):
    p = t.conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return p.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.max_by("text", "turn").alias("last"), F.count("*").alias("pages"))


@query("rul14_backfilled", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'compliant' ELSE 'error' END AS status FROM part")
def _(t):
    done = t.part.where("p_size > 25").select("p_partkey", F.lit("compliant").alias("status"))
    return E.backfill(t.part.select("p_partkey"), done, ["p_partkey"])


@query(
    "rul15_from_checks",
    "WITH c AS (SELECT o_orderkey, l_partkey * 10 + l_linenumber AS o, CASE WHEN l_returnflag = 'R' THEN 'fail' WHEN l_returnflag = 'A' THEN 'pass' END AS x FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey) SELECT o_orderkey, CASE WHEN count(o) = 0 THEN 'not_applicable' WHEN count(*) FILTER (WHERE x = 'fail') > 0 THEN 'non_compliant' WHEN count(x) = 0 THEN 'uncertain' ELSE 'compliant' END AS status, min(o) FILTER (WHERE x = 'fail') AS decided_by FROM c GROUP BY 1",
)
def _(t):
    j = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    x = F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "A", "pass")
    return E.infer_from_checks(j.select("o_orderkey", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ordinal"), x.alias("outcome")), ["o_orderkey"])


@query("rul18_discoveries", "SELECT p_partkey, round(p_size * 0.85 / 50, 6)::DOUBLE AS confidence FROM part WHERE lower(trim(p_type)) NOT IN (SELECT lower(trim(p_type)) FROM part WHERE p_size = 7 AND p_brand = 'Brand#11')")
def _(t):
    found = t.part.select("p_partkey", F.col("p_type").alias("description"), (F.col("p_size") / 50).alias("confidence"))
    return E.discoveries(found, t.part.where("p_size = 7 AND p_brand = 'Brand#11'").select(F.upper("p_type").alias("description"))).select("p_partkey", F.round("confidence", 6).alias("confidence"))


@query("src1_document_digests", "SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS size FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


@query("src2_file_issues", "SELECT page_id, CASE WHEN length(html) = 0 THEN ['EMPTY_FILE', 'UNSUPPORTED_FILE_TYPE'] WHEN contains(url, 'blog.') THEN [] ELSE ['UNSUPPORTED_FILE_TYPE'] END AS issues FROM pages")
def _(t):
    kind = F.when(F.contains("url", F.lit("blog.")), "application/pdf").otherwise("text/html")
    return t.pages.select("page_id", I.file_issues(F.col("url"), kind, F.octet_length("html"), F.lit("page")).alias("issues"))


@query(
    "src7_projected_fields",
    "SELECT user_id AS doc_id, event_id AS page, CASE event_type WHEN 'purchase' THEN 'buy' ELSE 'look' END AS field FROM events WHERE event_type IN ('purchase', 'view')",
)
def _(t):
    labels = t.values([("Purchase", "buy"), (" view ", "look")], "label string, field string")
    kv = t.events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("page"), F.lit("x").alias("role"), F.col("event_type").alias("key"), F.col("event_type").alias("value"))
    return I.project_fields(kv, labels, F.lit(False)).select("doc_id", "page", F.col("fields")[0]["field"].alias("field"))


@query("src13_split_results", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS kind FROM events")
def _(t):
    good, bad = E.split_results(t.events.select("event_id", F.when(F.col("event_type") == "error", "error").alias("error")))
    return good.select("event_id", F.lit("success").alias("kind")).unionByName(bad.select("event_id", F.lit("failure").alias("kind")))


@query("src21_nested_steps", "SELECT p_partkey, p_name, coalesce(list(l_orderkey ORDER BY l_orderkey) FILTER (WHERE l_orderkey IS NOT NULL), []) AS steps FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 48 GROUP BY 1, 2")
def _(t):
    l = t.lineitem.where("l_quantity > 48")
    j = t.part.join(l, F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.groupBy("p_partkey", "p_name").agg(F.array_sort(F.collect_list("l_orderkey")).alias("steps"))


@query("src22_critical_steps", "SELECT p_partkey, p_name FROM part WHERE p_size > 45 ORDER BY p_name, p_partkey")
def _(t):
    return t.part.where("p_size > 45").orderBy("p_name", "p_partkey").select("p_partkey", "p_name")


@query(
    "snk1_markdown_report",
    "SELECT o_custkey, '# Findings' || chr(10) || string_agg('- ' || s || ' | ' || o_orderpriority || ' | ' || o_orderstatus, chr(10) ORDER BY CASE s WHEN 'critical' THEN 0 ELSE 1 END, o_orderkey) AS markdown FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'critical' ELSE 'minor' END AS s FROM orders) GROUP BY 1",
)
def _(t):
    f = t.orders.select("o_custkey", F.when(F.col("o_orderstatus") == "F", "critical").otherwise("minor").alias("severity"), F.col("o_orderpriority").alias("rule_id"), F.col("o_orderstatus").alias("summary"), F.col("o_orderkey").alias("finding_id"))
    return I.markdown_report(f, ["o_custkey"], "Findings")


@query("snk2_next_revision", "SELECT c_custkey, coalesce(max(o_orderkey), 0) + 1 AS revision FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    j = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_custkey").agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("revision"))


@query("str5_stage_events", "SELECT user_id, list(event_type ORDER BY event_id) AS stages FROM events GROUP BY 1")
def _(t):
    x = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    return t.events.groupBy("user_id").agg(F.transform(x, lambda e: e["event_type"]).alias("stages"))


@query("dsl10_profile_checks", "SELECT DISTINCT p_type FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50)")
def _(t):
    return t.part.join(t.part.where("p_size = 50").select("p_brand"), "p_brand", "left_anti").select("p_type").distinct()


@query(
    "dsl16_segmentation_chain",
    """WITH r AS (SELECT o_custkey, o_orderkey AS ordinal, greatest(CAST(o_orderkey % 50 - 3 AS INTEGER), 1) AS a, least(CAST(o_orderkey % 50 - 3 + o_orderkey % 9 AS INTEGER), 40) AS b FROM orders), c AS (SELECT * FROM r WHERE a <= b),
x AS (SELECT o_custkey, greatest(a, coalesce(max(b) OVER (PARTITION BY o_custkey ORDER BY a, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, a)) AS a, b FROM c), y AS (SELECT * FROM x WHERE a <= b),
k AS (SELECT DISTINCT o_custkey, CAST(unnest(range(1, 41)) AS INTEGER) AS page FROM orders), m AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.o_custkey = k.o_custkey AND k.page BETWEEN y.a AND y.b)), i AS (SELECT *, page - row_number() OVER (PARTITION BY o_custkey ORDER BY page) AS g FROM m)
SELECT o_custkey, a AS start_page, b AS end_page, 'section' AS kind FROM y UNION ALL SELECT o_custkey, min(page), max(page), 'gap' FROM i GROUP BY o_custkey, g""",
)
def _(t):
    a = (F.col("o_orderkey") % 50 - 3).cast("int")
    ranges = t.orders.select("o_custkey", F.col("o_orderkey").alias("ordinal"), a.alias("start_page"), (a + F.col("o_orderkey") % 9).cast("int").alias("end_page"))
    totals = t.orders.select("o_custkey", F.lit(40).alias("total")).distinct()
    kept = W.resolve_overlaps(W.clamp(ranges, totals, ["o_custkey"]), ["o_custkey"])
    covered = kept.select("o_custkey", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    gaps = W.missing_pages(covered, totals, ["o_custkey"])
    mark = lambda df, k: df.select("o_custkey", "start_page", "end_page", F.lit(k).alias("kind"))
    return mark(kept, "section").unionByName(mark(gaps, "gap"))
