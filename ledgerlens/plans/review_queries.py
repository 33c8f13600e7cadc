"""Queries of reviews, verdicts and marks, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import marks as M
from ..operators import agents as A
from ..operators import review as R
from .catalog import query


@query(
    "jn10_rule_groups",
    "WITH r AS (SELECT l_partkey, arg_max(l_orderkey, (l_orderkey, l_linenumber)) AS o FROM lineitem GROUP BY 1), g AS (SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(CAST(l_suppkey AS VARCHAR)))), ',') AS ids FROM lineitem GROUP BY 1) "
    "SELECT ids, count(*) AS n FROM r JOIN g ON r.o = g.l_orderkey WHERE l_orderkey % 7 <> 0 GROUP BY 1",
)
def _(t):
    ids = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("section_ids"))
    l = t.lineitem.select(F.col("l_partkey").alias("rule_id"), "l_orderkey", F.struct("l_orderkey", "l_linenumber").alias("ordinal"))
    resolutions = l.join(ids, "l_orderkey").select("rule_id", "ordinal", (F.col("l_orderkey") % 7 != 0).alias("applicable"), "section_ids")
    return R.grouped_rules(l, resolutions, []).select(F.array_join("section_ids", ",").alias("ids"), F.size("rule_ids").cast("long").alias("n"))


def _even(batch):
    """An arbiter that answers for even orders only."""
    import json

    return [{"id": r["id"], "status": "uncertain", "confidence": 0.5} for r in batch if int(json.loads(r["id"])[0]) % 2 == 0]


@query(
    "rul21_arbitrated",
    "SELECT o_orderkey, CASE WHEN a = b THEN a WHEN a IS NULL OR b IS NULL THEN coalesce(a, b) WHEN o_orderkey % 2 = 0 THEN 'uncertain' WHEN 'non_compliant' IN (a, b) THEN 'non_compliant' WHEN 'uncertain' IN (a, b) THEN 'uncertain' ELSE 'error' END AS status, "
    "CAST(CASE WHEN a = b THEN least(0.25, 0.75) WHEN a IS NULL THEN 0.75 WHEN b IS NULL THEN 0.25 WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0.25 END AS DOUBLE) AS confidence, CASE WHEN a = b THEN 'agreed' WHEN a IS NULL OR b IS NULL THEN 'alone' WHEN o_orderkey % 2 = 0 THEN 'arbitrated' ELSE 'graver' END AS how "
    "FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'non_compliant' WHEN o_custkey % 3 = 0 THEN 'error' WHEN o_orderkey % 5 <> 0 THEN 'compliant' END AS a, CASE WHEN o_totalprice > 200000 THEN 'non_compliant' WHEN o_totalprice > 100000 THEN 'uncertain' ELSE 'compliant' END AS b FROM orders)",
)
def _(t):
    said = lambda status, sure: F.when(status.isNotNull(), F.struct(status.alias("status"), F.lit(sure).alias("confidence"), F.lit("").alias("reasoning")))
    a = F.when(F.col("o_orderstatus") == "F", "non_compliant").when(F.col("o_custkey") % 3 == 0, "error").when(F.col("o_orderkey") % 5 != 0, "compliant")
    b = F.when(F.col("o_totalprice") > 200000, "non_compliant").when(F.col("o_totalprice") > 100000, "uncertain").otherwise("compliant")
    return R.arbitrated(t.orders.select("o_orderkey", said(a, 0.25).alias("text"), said(b, 0.75).alias("vision")), _even, ["o_orderkey"])


@query("fn48_blocking", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN false WHEN o_orderpriority = '5-LOW' THEN false ELSE o_orderstatus = 'F' END AS blocking FROM orders")
def _(t):
    severity = F.when(F.col("o_orderstatus") == "F", "Critical").otherwise("minor")
    newer = F.when(F.col("o_orderkey") % 9 == 0, F.lit("newer"))
    return t.orders.select("o_orderkey", R.blocking(F.lit("open"), newer, F.col("o_orderpriority"), severity, {"5-LOW": False}).alias("blocking"))


@query("agg13_adjusted_score", "SELECT c_nationkey, round(CASE WHEN sum(CASE WHEN c_acctbal > 0 THEN c_custkey % 5 ELSE 0 END) > 0 THEN sum(c_acctbal * (c_custkey % 5)) FILTER (WHERE c_acctbal > 0) / sum(c_custkey % 5) FILTER (WHERE c_acctbal > 0) ELSE avg(c_acctbal) END, 1) AS review_score FROM customer GROUP BY 1")
def _(t):
    rules = F.when(F.col("c_acctbal") > 0, F.col("c_custkey") % 5).otherwise(-1)
    agents = t.customer.select("c_nationkey", F.col("c_acctbal").alias("score"), rules.alias("rules"))
    return R.review_adjusted(agents, t.customer.select("c_nationkey").distinct().withColumn("model_score", F.lit(0.0)), ["c_nationkey"]).drop("model_score")


@query(
    "dsl12_quarantine",
    "SELECT * FROM (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN 'unknown action' WHEN 'R' THEN CASE WHEN l_linenumber % 4 <> 0 THEN 'CONFIRM takes no reason_type' WHEN l_quantity > 25 THEN 'CONFIRM takes no observed_value_on_document' END "
    "ELSE CASE WHEN l_linenumber % 4 = 0 THEN 'DISMISS needs a reason_type' WHEN l_linenumber % 4 = 3 THEN 'unknown reason_type' WHEN l_linenumber % 4 = 2 AND l_quantity <= 25 THEN 'this reason_type needs observed_value_on_document' END END AS error FROM lineitem) WHERE error IS NOT NULL",
)
def _(t):
    n, flag = F.col("l_linenumber") % 4, F.col("l_returnflag")
    action = F.when(flag == "R", "CONFIRM").when(flag == "A", "DISMISS").otherwise("LATER")
    reason = F.when(n == 1, "OTHER").when(n == 2, "OCR_MISREAD").when(n == 3, "ODD")
    error = R.resolution_error(action, reason, F.when(F.col("l_quantity") > 25, "v"), F.lit(None).cast("string"))
    return R.quarantined(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), error)[1].select("l_orderkey", "l_linenumber", "error")


@query(
    "dsl13_feedback_seeds",
    """SELECT 'fbs_' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 32) AS sample_id, event_id AS resolution_id, event_id AS finding_id, user_id AS rule_id, CASE event_type WHEN 'error' THEN 'DISMISS' ELSE 'CORRECT' END AS action, CASE event_type WHEN 'error' THEN 'OTHER' END AS reason_type,
'sha256:' || sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS digest FROM events WHERE event_type IN ('error', 'purchase')""",
)
def _(t):
    kind = F.col("event_type")
    action = F.when(kind == "error", "DISMISS").when(kind == "purchase", "CORRECT").otherwise("CONFIRM")
    resolutions = t.events.select(F.col("event_id").alias("resolution_id"), F.col("event_id").alias("finding_id"), action.alias("action"), F.when(kind == "error", "OTHER").alias("reason_type"))
    findings = t.events.select(F.col("event_id").alias("finding_id"), F.col("user_id").alias("rule_id"), "user_id", "event_type")
    return R.feedback_seeds(resolutions, findings, ["user_id", "event_type"])


@query(
    "dsl14_page_decisions",
    "SELECT l_orderkey, l_linenumber, a AS action, CASE a WHEN 'approve' THEN 'approved' WHEN 'edit' THEN 'edited' ELSE 'flagged' END AS status, CASE a WHEN 'flag' THEN 'torn' END AS reason FROM (SELECT l_orderkey, l_linenumber, CASE arg_max(l_returnflag, l_partkey * 100000 + l_suppkey) WHEN 'R' THEN 'approve' WHEN 'A' THEN 'edit' ELSE 'flag' END AS a FROM lineitem GROUP BY 1, 2)",
)
def _(t):
    flag = F.col("l_returnflag")
    action = F.when(flag == "R", "approve").when(flag == "A", "edit").otherwise("flag")
    log = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("ordinal"), action.alias("action"), F.lit("torn").alias("reason"))
    return R.page_decisions(log, ["l_orderkey", "l_linenumber"])


@query(
    "fn37_marks",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 1 ELSE 0 END AS selected, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS marks, replace(o_orderpriority, ' ', '/') AS words, CAST(o_custkey AS VARCHAR) || CASE WHEN o_custkey = o_orderkey THEN '' ELSE ',' || o_orderkey END AS formulas, 'Done/' || o_orderstatus AS labels FROM orders",
)
def _(t):
    s, key = F.col("o_orderstatus"), F.col("o_orderkey").cast("string")
    boxes = F.when(s == "F", "[x]").when(s == "O", "[ ] [X]").otherwise("none")
    text = F.concat(boxes, F.lit(" $"), key, F.lit("$ $$"), F.col("o_custkey").cast("string"), F.lit("$$\n| "), s, F.lit(" [signature] |\n<!-- block_type: Signature --> Done\n<!-- block_type: Handwriting -->"), "o_orderpriority")
    marks, labels = M.selection_marks(text), F.transform(M.signature_marks(text), lambda x: x["label"])
    return t.orders.select(
        "o_orderkey", F.size(F.filter(marks, lambda m: m["state"] == "selected")).alias("selected"), F.size(marks).alias("marks"), F.array_join(M.handwritten_words(text), "/").alias("words"),
        F.array_join(F.transform(M.formulas(text), lambda x: x["value"]), ",").alias("formulas"), F.array_join(labels, "/").alias("labels"),
    )


@query(
    "fn42_signature_cells",
    "WITH c AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN '[Signature]' ELSE 'no' END AS cell, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE WHEN l_returnflag = 'R' THEN '[Signature]' ELSE 'no' END, l_partkey) AS n, count(*) OVER (PARTITION BY l_orderkey) AS rows FROM lineitem) "
    "SELECT l_orderkey, CAST(n + 1 AS INTEGER) AS \"row\", CAST(10 AS DOUBLE) AS x1, CAST(n * 10 AS DOUBLE) AS y1, CAST(20 AS DOUBLE) AS x2, CAST(n * 10 + 10 AS DOUBLE) AS y2 FROM c WHERE cell <> 'no'",
)
def _(t):
    cell = F.when(F.col("l_returnflag") == "R", "[Signature]").otherwise("no")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", cell.alias("cell"), "l_partkey"))), lambda r: F.concat(F.lit("| 1 | "), r["cell"], F.lit(" |")))
    p = t.lineitem.groupBy("l_orderkey").agg(F.concat(F.lit("| Step | Signed by |\n|---|---|\n"), F.array_join(lines, "\n")).alias("text"), F.count("*").alias("n"))
    boxes = p.select("l_orderkey", F.lit(0).alias("nth"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(20.0).alias("x2"), ((F.col("n") + 1) * 10.0).alias("y2"))
    return M.signature_cells(p.select("l_orderkey", "text"), boxes, ["signed by"], ["l_orderkey"]).select("l_orderkey", "row", "x1", "y1", "x2", "y2")


@query(
    "fn16_selection_semantics",
    "SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS selected, (o_orderstatus = 'O')::INTEGER AS unselected, array_to_string(list_filter([CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 > 1 THEN 'selected_without_checklist_headers' END, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 1 THEN 'selected_marks_without_geometry' END, "
    "CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 4 = 0 THEN 'tri_state_headers_without_selected_marks' END], lambda x: x IS NOT NULL), ',') AS reasons FROM orders",
)
def _(t):
    text = F.when(F.col("o_orderkey") % 4 == 0, "YES No N/A").when(F.col("o_orderkey") % 4 == 1, "yes").otherwise("know nothing")
    state = lambda s: F.array(F.struct(F.lit(s).alias("state")))
    marks = F.when(F.col("o_orderstatus") == "F", state("Selected")).when(F.col("o_orderstatus") == "O", state("unselected")).otherwise(F.array().cast("array<struct<state:string>>"))
    s = M.selection_summary(text, marks, F.col("o_custkey") % 2 == 0)
    return t.orders.select("o_orderkey", s["selected"].alias("selected"), s["unselected"].alias("unselected"), F.array_join(s["reasons"], ",").alias("reasons"))


@query(
    "cls4_canonical_documents",
    "SELECT c_custkey, c_mktsegment = 'BUILDING' AND count(*) FILTER (WHERE c_mktsegment = 'BUILDING') OVER (PARTITION BY c_custkey // 7) = 1 AS is_canonical FROM customer",
)
def _(t):
    docs = t.customer.select("c_custkey", F.floor(F.col("c_custkey") / 7).alias("package"), F.col("c_mktsegment").alias("role"))
    return A.canonical_documents(docs, "BUILDING", "package").select("c_custkey", "is_canonical")


@query("cls4_canonical_issues", "SELECT c_nationkey, 'DUPLICATE_CANONICAL' AS issue, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return A.canonical_issues(t.customer.select("c_nationkey", F.col("c_mktsegment").alias("role")), "BUILDING", "c_nationkey")


@query(
    "cls11_template_family",
    "WITH n AS (SELECT p_brand, lower(string_agg(p_name, ' ' ORDER BY p_partkey)) AS t FROM part WHERE p_size < 4 GROUP BY 1), b AS (SELECT DISTINCT p_brand FROM part) "
    "SELECT b.p_brand, CASE WHEN contains(p, 'hot rod') OR contains(p, 'old ring') THEN 'a' WHEN contains(p, 'brand#1') OR contains(p, 'green') THEN 'b' ELSE 'core' END AS family FROM b LEFT JOIN n ON n.p_brand = b.p_brand, LATERAL (SELECT lower(b.p_brand) || ' ' || coalesce(t, '') AS p)",
)
def _(t):
    packets = t.part.select("p_brand").distinct().withColumn("extraction_family", F.col("p_brand"))
    sections = t.part.where("p_size < 4").select("p_brand", F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("name"))
    probe = A.family_probe(packets, sections, "p_brand")
    return probe.select("p_brand", A.template_family(F.col("probe"), [("a", "hot  rod"), ("b", "Brand#1"), ("a", "old ring"), ("b", "GREEN")], "core").alias("family"))


@query(
    "rul16_chunks",
    "WITH r(rule_id, doc, sec) AS (VALUES ('x', 'F', ''), ('x', 'O', ''), ('y', 'O', 'R')), m AS (SELECT r.rule_id, l_suppkey AS doc_id, l_linestatus AS document_type, l_returnflag AS section_type, l_orderkey * 10 + l_linenumber AS page, l_partkey AS k FROM lineitem JOIN r ON doc = l_linestatus AND (sec = '' OR sec = l_returnflag)), "
    "d AS (SELECT DISTINCT rule_id, doc_id, document_type, section_type, page FROM m) SELECT rule_id, doc_id, document_type, section_type, page, section_type || CASE WHEN count(*) OVER w > 40 AND row_number() OVER (PARTITION BY rule_id, doc_id, document_type, section_type ORDER BY page) > count(*) OVER w // 2 THEN '-1' ELSE '-0' END AS chunk_id FROM d WINDOW w AS (PARTITION BY rule_id, doc_id, document_type, section_type)",
)
def _(t):
    page = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("page")
    pages = t.lineitem.select(F.col("l_suppkey").alias("doc_id"), page, F.col("l_linestatus").alias("document_type"), F.col("l_returnflag").alias("section_type")).distinct()
    rules = t.values([("x", ["F", "O"], []), ("y", ["O"], ["R"])], "rule_id string, document_types array<string>, section_types array<string>")
    return A.rule_chunks(pages, rules, 40)


@query(
    "rul17_context_pages",
    "WITH p AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM p) "
    "SELECT conv_id, string_agg('--- page ' || turn || ' ---' || chr(10) || CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE coalesce(text, '') END, chr(10) ORDER BY turn) || CASE WHEN max(n) > 2 THEN chr(10) || '[' || (max(n) - 2) || ' more pages]' ELSE '' END AS text, greatest(max(n) - 2, 0) AS dropped FROM n WHERE i <= 2 GROUP BY 1",
)
def _(t):
    p = t.conversations.groupBy("conv_id", F.col("turn").alias("page")).agg(F.min("text").alias("text"))
    return A.context_pages(p, ["conv_id"], 2, 100)


@query(
    "jn17_report_rows",
    "WITH f AS (SELECT l_orderkey AS o, l_linestatus AS agent, l_returnflag AS rule, count(DISTINCT l_partkey) AS n, max(CASE WHEN l_quantity > 40 THEN 2 WHEN l_quantity > 20 THEN 1 ELSE 0 END) AS s FROM lineitem GROUP BY 1, 2, 3), a(agent) AS (VALUES ('F'), ('O')) "
    "SELECT o_orderkey AS doc_id, a.agent, 'R' AS rule_id, CASE WHEN o_orderstatus = 'F' THEN 'non_compliant' ELSE 'compliant' END AS status, CAST(coalesce(n, 0) AS INTEGER) AS findings, CASE s WHEN 2 THEN 'critical' WHEN 1 THEN 'major' WHEN 0 THEN 'minor' END AS severity FROM orders, a LEFT JOIN f ON f.o = o_orderkey AND f.agent = a.agent AND f.rule = 'R' WHERE o_orderstatus <> 'P'",
)
def _(t):
    q = F.col("l_quantity")
    findings = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linestatus").alias("agent"), F.col("l_returnflag").alias("rule_id"), F.col("l_partkey").alias("finding_id"), F.when(q > 40, "critical").when(q > 20, "major").otherwise("minor").alias("severity"))
    status = F.when(F.col("o_orderstatus") == "F", "non_compliant").when(F.col("o_orderstatus") == "P", "not_applicable").otherwise("compliant")
    evaluations = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.lit("F"), F.lit("O"))).alias("agent"), F.lit("R").alias("rule_id"), status.alias("status"))
    return A.report_rows(evaluations, findings, ["doc_id"]).select("doc_id", "agent", "rule_id", "status", F.size("finding_ids").alias("findings"), "severity")


@query(
    "agg27_acceptance",
    "SELECT l_suppkey, array_to_string(list_filter([CASE WHEN q < 0 THEN 'A' END, CASE WHEN f > 0.1 THEN 'B' END, CASE WHEN p > 0 THEN 'C' END, CASE WHEN l > 150 THEN 'D' END], lambda x: x IS NOT NULL), '') AS gates, q >= 0 AND f <= 0.1 AND p <= 0 AND l <= 150 AS accepted, CASE WHEN q < 0 THEN 1 ELSE 0 END + CASE WHEN l > 150 THEN 1 ELSE 0 END AS reasons "
    "FROM (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') - count(*) FILTER (WHERE l_returnflag = 'R') AS q, count(*) FILTER (WHERE l_tax > 0.07) / count(*) AS f, count(*) FILTER (WHERE l_quantity = 1 AND l_discount > 0.08) AS p, max(l_orderkey) % 300 AS l FROM lineitem GROUP BY 1)",
)
def _(t):
    n = F.count_if
    m = t.lineitem.groupBy("l_suppkey").agg(
        (n(F.col("l_returnflag") == "A") - n(F.col("l_returnflag") == "R")).alias("q"), (n(F.col("l_tax") > 0.07) / F.count("*")).alias("f"), n((F.col("l_quantity") == 1) & (F.col("l_discount") > 0.08)).alias("p"), (F.max("l_orderkey") % 300).alias("l")
    )
    none = F.lit(None).cast("boolean")
    a = A.acceptance({"quality_f1_delta": F.col("q"), "latency_ms_delta": F.col("l"), "cost_usd_delta": F.lit(None), "signature_false_negative_rate": F.col("f"), "placeholder_errors": F.col("p"), "deterministic": none, "parser_surfaced": none, "selection_surfaced": none})
    return m.select("l_suppkey", F.array_join(a["gates"], "").alias("gates"), a["accepted"].alias("accepted"), F.size(A.gate_reasons(F.col("q"), F.col("l"), F.lit(None))).alias("reasons"))


@query(
    "agg27_pilot_accuracy",
    "WITH w AS (SELECT DISTINCT l_orderkey AS s, l_linenumber AS f FROM lineitem WHERE l_orderkey % 3 = 0), v(variant) AS (VALUES ('base'), ('custom')), p AS (SELECT variant, s, f, CASE WHEN variant = 'base' THEN f % 2 = 0 ELSE f % 3 > 0 END AS ok FROM w, v WHERE NOT (variant = 'base' AND s % 2 = 0) QUALIFY bool_or(ok OR f <> 3) OVER (PARTITION BY variant, s)) SELECT variant, count(*) FILTER (WHERE ok) AS \"right\", count(*) AS total, round(count(*) FILTER (WHERE ok) / count(*), 4) AS accuracy FROM p GROUP BY 1",
)
def _(t):
    w = t.lineitem.where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("s"), F.col("l_linenumber").alias("f")).distinct()
    labels = w.withColumn("value", F.concat(F.lit("Value "), F.col("f").cast("string")))
    said = w.withColumn("variant", F.explode(F.array(F.lit("base"), F.lit("custom")))).where("NOT (variant = 'base' AND s % 2 = 0)")
    ok = F.when(F.col("variant") == "base", F.col("f") % 2 == 0).otherwise(F.col("f") % 3 > 0)
    predictions = said.where(ok | (F.col("f") != 3)).withColumn("value", F.when(ok, F.concat(F.lit(" VALUE  "), F.col("f").cast("string"))).otherwise("wrong"))
    return A.accuracy(labels, predictions, ["s", "f"])
