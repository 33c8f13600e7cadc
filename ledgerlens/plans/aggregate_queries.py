"""Aggregation queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import rules as R
from ..operators import listings as L
from .catalog import query
from .rule_queries import line_findings

for _k in ("sum", "count", "min", "max", "avg"):

    @query(f"agg1_{_k}", f"SELECT l_returnflag, round(CAST({_k}(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 6) AS v FROM lineitem GROUP BY 1")
    def _(t, k=_k):
        return t.lineitem.groupBy("l_returnflag").agg(F.round(R.aggregate(k, F.col("l_quantity").cast("decimal(18,2)")).cast("double"), 6).alias("v"))


_SEV = "CASE WHEN l_tax > 0.07 THEN 'critical' WHEN l_tax > 0.05 THEN 'major' WHEN l_tax > 0.02 THEN 'minor' ELSE 'observation' END"
_SEVRANK = "CASE WHEN l_tax > 0.07 THEN 4 WHEN l_tax > 0.05 THEN 3 WHEN l_tax > 0.02 THEN 2 ELSE 0 END"
_NAMES = "['observation', 'info', 'minor', 'major', 'critical']"


@query("agg3_worst_severity", f"SELECT l_suppkey, {_NAMES}[greatest(max({_SEVRANK}), 1) + 1] AS severity FROM lineitem GROUP BY 1")
def _(t):
    return line_findings(t).groupBy("l_suppkey").agg(R.worst_severity("info").alias("severity"))


@query(
    "agg4_evidence",
    "SELECT o_custkey, list(k ORDER BY k) AS evidence FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) GROUP BY 1",
)
def _(t):
    evidence = t.orders.select("o_custkey", F.col("o_orderkey").alias("finding"), F.lit(0).alias("ordinal"), "o_orderpriority")
    given = L.first_unseen_regions(evidence, ["o_custkey"], ["o_orderpriority"])
    return given.groupBy("o_custkey").agg(F.array_sort(F.collect_list("finding")).alias("evidence"))


@query(
    "agg5_summary",
    "SELECT 'event_type' AS dimension, event_type AS value, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'half', CASE WHEN value > 50 THEN 'high' ELSE 'low' END, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'all', NULL, count(*) FROM events",
)
def _(t):
    return A.grouping_counts(t.events.withColumn("half", F.when(F.col("value") > 50, "high").otherwise("low")), ["event_type", "half"])


@query(
    "agg6_recomputed_summary",
    "SELECT 'bucket' AS dimension, CASE WHEN o_orderkey % 7 = 0 THEN 'superseded' ELSE o_orderstatus END AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'all', NULL, count(*) FROM orders",
)
def _(t):
    bucket = F.when(F.col("o_orderkey") % 7 == 0, "superseded").otherwise(F.col("o_orderstatus"))
    return A.grouping_counts(t.orders.withColumn("bucket", bucket), ["bucket", "o_orderpriority"])


_EV = """WITH e AS (SELECT l_suppkey, l_returnflag AS rule, l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS o, CASE l_linestatus WHEN 'F' THEN CASE WHEN l_quantity > 45 THEN 'non_compliant' ELSE 'compliant' END ELSE CASE WHEN l_quantity < 3 THEN 'error' WHEN l_quantity < 6 THEN 'uncertain' ELSE 'compliant' END END AS status, l_discount AS c FROM lineitem),
r AS (SELECT *, CASE status WHEN 'not_applicable' THEN 0 WHEN 'compliant' THEN 1 WHEN 'error' THEN 2 WHEN 'uncertain' THEN 3 ELSE 4 END AS k FROM e), m AS (SELECT l_suppkey, rule, max(k) AS w FROM r GROUP BY 1, 2),
a AS (SELECT r.l_suppkey, r.rule, ['not_applicable', 'compliant', 'error', 'uncertain', 'non_compliant'][any_value(w) + 1] AS status, min(c) AS confidence, min(o) AS first, count(*) AS n FROM r JOIN m ON r.l_suppkey = m.l_suppkey AND r.rule = m.rule AND r.k = m.w GROUP BY 1, 2)
"""


def _evaluations(t):
    q = F.col("l_quantity")
    status = F.when(F.col("l_linestatus") == "F", F.when(q > 45, "non_compliant").otherwise("compliant")).otherwise(F.when(q < 3, "error").when(q < 6, "uncertain").otherwise("compliant"))
    o = F.col("l_orderkey") * 100000 + F.col("l_partkey") * 10 + F.col("l_linenumber")
    return t.lineitem.select("l_suppkey", F.col("l_returnflag").alias("rule"), o.alias("ordinal"), status.alias("status"), F.col("l_discount").alias("confidence"), o.alias("reasoning"))


@query("agg7_agent_report", _EV + "SELECT l_suppkey, rule, status, confidence, first AS reasoning, n FROM a")
def _(t):
    return A.agent_report(_evaluations(t), ["l_suppkey", "rule"])


@query("agg8_compliance_score", _EV + "SELECT l_suppkey, round(CASE WHEN count(*) - count(*) FILTER (WHERE status IN ('not_applicable', 'error')) <= 0 THEN 100.0 ELSE 100.0 * count(*) FILTER (WHERE status = 'compliant') / (count(*) - count(*) FILTER (WHERE status IN ('not_applicable', 'error'))) END, 6)::DOUBLE AS score FROM e GROUP BY 1")
def _(t):
    return _evaluations(t).groupBy("l_suppkey").agg(F.round(A.compliance_score().cast("double"), 6).alias("score"))


_F9 = f"f AS (SELECT 'a' || (l_suppkey % 5) AS agent, 'r' || (l_partkey % 20) AS rule_id, l_returnflag AS description, l_linenumber AS page, {_SEVRANK} AS sev, l_discount AS confidence, l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS ordinal FROM lineitem)"


def _merged(t):
    l = t.lineitem
    sev = F.when(F.col("l_tax") > 0.07, "critical").when(F.col("l_tax") > 0.05, "major").when(F.col("l_tax") > 0.02, "minor").otherwise("observation")
    o = F.col("l_orderkey") * 100000 + F.col("l_partkey") * 10 + F.col("l_linenumber")
    return l.select(
        F.concat(F.lit("a"), (F.col("l_suppkey") % 5).cast("string")).alias("agent"), F.concat(F.lit("r"), (F.col("l_partkey") % 20).cast("string")).alias("rule_id"),
        F.col("l_returnflag").alias("description"), F.col("l_linenumber").alias("page"), sev.alias("severity"), F.col("l_discount").alias("confidence"), o.alias("ordinal"), o.alias("evidence"),
    )


for _mode, _keys in (("per_agent", "agent, rule_id, description"), ("cross_agent_collapse", "rule_id, description")):

    @query(
        f"agg9_deduplicate_{_mode}",
        f"WITH {_F9} SELECT {_keys}, list_sort(list(DISTINCT page)) AS pages, {_NAMES}[max(sev) + 1] AS severity, min(confidence) AS confidence, min(ordinal) AS evidence, list_sort(list(DISTINCT agent)) AS agents FROM f GROUP BY {_keys}",
    )
    def _(t, mode=_mode):
        return A.deduplicate(_merged(t), mode)


@query("agg10_agent_totals", f"WITH {_F9} SELECT s_suppkey, count(agent) AS n FROM supplier LEFT JOIN f ON agent = 'a' || s_suppkey GROUP BY 1")
def _(t):
    agents = t.supplier.select("s_suppkey", F.concat(F.lit("a"), "s_suppkey").alias("agent"))
    return L.resynced(agents, _merged(t)).select("s_suppkey", F.col("total_findings").alias("n"))


@query("agg11_overall_score", _EV + ", s AS (SELECT l_suppkey, count(*) AS rules, CASE WHEN count(*) FILTER (WHERE status <> 'error') = 0 THEN 100.0 ELSE 100.0 * count(*) FILTER (WHERE status = 'compliant') / count(*) FILTER (WHERE status <> 'error') END AS score FROM e GROUP BY 1) SELECT round(sum(score * rules) / sum(rules), 4)::DOUBLE AS score FROM s")
def _(t):
    s = _evaluations(t).groupBy("l_suppkey").agg(F.count("*").alias("rules"), A.compliance_score().cast("double").alias("score"))
    return A.overall_score(s).select(F.round("score", 4).alias("score"))


_HITL = "CASE l_returnflag WHEN 'R' THEN 'needs_review' WHEN 'A' THEN 'user_rejected' ELSE CASE WHEN l_linenumber = 1 THEN NULL ELSE 'auto_approved' END END"


def _hitl():
    return F.when(F.col("l_returnflag") == "R", "needs_review").when(F.col("l_returnflag") == "A", "user_rejected").when(F.col("l_linenumber") == 1, None).otherwise("auto_approved")


@query(
    "agg12_penalty_score",
    f"SELECT l_orderkey, greatest(0, 100 - coalesce(sum(CASE WHEN coalesce({_HITL}, 'unknown') NOT IN ('user_rejected', 'resolved', 'unknown') THEN CASE {_SEV} WHEN 'critical' THEN 10 WHEN 'major' THEN 5 WHEN 'minor' THEN 2 ELSE 1 END END), 0))::BIGINT AS score FROM lineitem GROUP BY 1",
)
def _(t):
    f = line_findings(t).join(t.lineitem.select("l_orderkey"), "l_orderkey", "left_semi")
    l = t.lineitem
    sev = F.when(F.col("l_tax") > 0.07, "critical").when(F.col("l_tax") > 0.05, "major").when(F.col("l_tax") > 0.02, "minor").otherwise("observation")
    return l.select("l_orderkey", sev.alias("severity"), _hitl().alias("hitl")).groupBy("l_orderkey").agg(A.penalty_score().cast("long").alias("score"))


@query("agg14_hitl_summary", f"SELECT l_suppkey, count(*) FILTER (WHERE h = 'needs_review') AS needs_review, count(*) FILTER (WHERE h = 'user_rejected') AS user_rejected, count(*) FILTER (WHERE h = 'auto_approved') AS auto_approved, count(*) FILTER (WHERE h IS NULL) AS unknown FROM (SELECT l_suppkey, {_HITL} AS h FROM lineitem) GROUP BY 1")
def _(t):
    return L.status_counts(t.lineitem.select("l_suppkey", _hitl().alias("h")), ["l_suppkey"], "h", ["needs_review", "user_rejected", "auto_approved", "unknown"])


@query(
    "agg15_consensus",
    "WITH n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2), t AS (SELECT user_id, max(n) AS top, sum(n) AS total, count(*) AS uniques FROM n GROUP BY 1), w AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS i FROM n) SELECT t.user_id, w.event_type AS winner, round(CAST(top AS DOUBLE) / total, 6) AS ratio, uniques, CAST(top AS DOUBLE) / total >= 0.5 AS agreed FROM t JOIN w ON w.user_id = t.user_id AND i = 1",
)
def _(t):
    v = t.events.select("user_id", F.col("event_type").alias("value"), F.col("event_id").alias("ordinal"))
    return A.consensus(v, ["user_id"], 0.5).withColumn("ratio", F.round("ratio", 6))


@query("agg16_conflicts", "SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS values, min(o_orderpriority) AS expected FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def _(t):
    return A.conflicts(t.orders.select("o_custkey", F.col("o_orderpriority").alias("value")), ["o_custkey"])


@query(
    "agg16_last_gap",
    "WITH l AS (SELECT user_id, arg_max(value, event_id) FILTER (WHERE event_type = 'view') AS a, arg_max(value, event_id) FILTER (WHERE event_type = 'click') AS b FROM events GROUP BY 1) SELECT user_id, a, b, round(abs(a - b) / greatest(abs(a), 1.0), 6) AS gap FROM l WHERE abs(a - b) / greatest(abs(a), 1.0) > 0.01",
)
def _(t):
    r = t.events.select("user_id", F.col("event_type").alias("field"), "value", F.col("event_id").alias("ordinal"))
    return A.last_gap(r, ["user_id"], "view", "click").withColumn("gap", F.round("gap", 6))


_RISK = "SELECT doc_id, source, s AS score, CASE WHEN s >= 70 THEN 'high' WHEN s >= 40 THEN 'medium' ELSE 'low' END AS level FROM (SELECT doc_id, source, round(least(1.0, (doc_id % 13) / 10.0) * 40 + greatest(0.0, (0.8 - (doc_id % 10) / 10.0) / 0.8) * 30 + CASE WHEN lang = 'en' THEN 15 ELSE 0 END + least(15.0, (doc_id % 4) * 7.5) + CASE WHEN n_chars >= 2000 THEN 5 ELSE 0 END, 2)::DOUBLE AS s FROM documents)"


def _page_risks(t):
    d = F.col("doc_id")
    r = S.corruption_risk(d % 13, (d % 10) / 10.0, F.col("lang") == "en", d % 4, F.floor(F.col("n_chars") / 100))
    return t.documents.select("doc_id", "source", r["score"].alias("score"), r["level"].alias("level"))


@query("agg17_corruption_risk", _RISK)
def _(t):
    return _page_risks(t)


@query(
    "agg17_packet_risk",
    f"SELECT source, max(score) AS max_score, count(*) FILTER (WHERE level = 'low') AS low, count(*) FILTER (WHERE level = 'medium') AS medium, count(*) FILTER (WHERE level = 'high') AS high, CASE WHEN count(*) FILTER (WHERE level = 'high') > 0 THEN 'needs_attention' WHEN count(*) FILTER (WHERE level = 'medium') > 0 THEN 'monitor' ELSE 'stable' END AS status FROM ({_RISK}) GROUP BY 1",
)
def _(t):
    return A.packet_risk(_page_risks(t), ["source"])


@query("agg18_field_confidence", "SELECT event_type, count(*) AS n, round(CAST(avg(CAST(value AS DECIMAL(18,6))) AS DOUBLE), 4) AS mean, count(*) FILTER (WHERE value < 65) AS low FROM events GROUP BY 1")
def _(t):
    r = t.events.select("event_type", F.col("value").alias("confidence"))
    return A.field_confidence(r, ["event_type"], 65).withColumn("mean", F.round("mean", 4))


_PAIRS = "p AS (SELECT user_id AS doc_id, lag(event_type) OVER w AS before, event_type AS after, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS ctx FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"


def _pairs(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    ctx = F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd")
    return t.events.select(F.col("user_id").alias("doc_id"), F.lag("event_type").over(w).alias("before"), F.col("event_type").alias("after"), ctx.alias("ctx")).where("before IS NOT NULL")


@query(
    "agg19_learn_corrections",
    f"WITH {_PAIRS}, g AS (SELECT ctx, before, after, count(*) AS n, count(DISTINCT doc_id) AS docs FROM p WHERE before IS NOT NULL GROUP BY 1, 2, 3), s AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY ctx, before) AS c FROM g) SELECT ctx, before, after, n, docs, round(c, 6)::DOUBLE AS confidence FROM s WHERE n >= 3 AND docs >= 2 ORDER BY n DESC, docs DESC, ctx, before, after LIMIT 500",
)
def _(t):
    return A.learn_corrections(_pairs(t)).withColumn("confidence", F.round("confidence", 6))


@query("agg20_confusion_pairs", f"WITH {_PAIRS} SELECT before, after, count(*) AS n FROM p WHERE before IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, before, after LIMIT 10")
def _(t):
    return A.confusion_pairs(_pairs(t), 10)


@query("agg21_retraining", "SELECT count(*) AS total, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 6)::DOUBLE AS critical, count(*) >= 20 AND (least(1.0, count(*) / 250.0) >= 0.08 OR avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) >= 0.03) AS retrain FROM events")
def _(t):
    log = t.events.select(F.when(F.col("event_type") == "error", "critical").otherwise("minor").alias("criticality"))
    return A.retraining(log).withColumn("critical", F.round("critical", 6))


@query("agg22_quality_dashboard", "WITH d AS (SELECT user_id, avg(value) AS c, sum(CAST(value * 2 AS DECIMAL(18,6))) AS l, count(*) AS n FROM events GROUP BY 1) SELECT round(avg(c), 4) AS mean_confidence, round(CAST(avg(l) AS DOUBLE), 4) AS mean_latency, sum(n)::BIGINT AS fields, count(*) AS docs FROM d")
def _(t):
    r = t.events.select("user_id", F.col("value").alias("confidence"), (F.col("value") * 2).alias("latency"))
    return A.quality_dashboard(r, "user_id").withColumn("mean_confidence", F.round("mean_confidence", 4)).withColumn("mean_latency", F.round("mean_latency", 4))


@query("agg25_merged_counters", "SELECT k, sum(v)::BIGINT AS n FROM (SELECT event_type AS k, event_id % 3 AS v FROM events UNION ALL SELECT 'total', 1 FROM events) GROUP BY 1")
def _(t):
    counters = F.create_map(F.col("event_type"), F.col("event_id") % 3, F.lit("total"), F.lit(1).cast("long"))
    return L.merged_counters(t.events.select(counters.alias("c")), "c").withColumnRenamed("name", "k")


_GP = """WITH g AS (SELECT doc_id, 'quality' AS field, CAST(quality AS VARCHAR) AS gold FROM labels UNION ALL SELECT doc_id, 'toxic', CASE WHEN toxic = 1 THEN '1' END FROM labels),
p AS (SELECT doc_id, 'quality' AS field, CASE WHEN n_chars > 800 THEN '1' ELSE '0' END AS pred FROM documents UNION ALL SELECT doc_id, 'toxic', CASE WHEN contains(text, 'worthless') THEN '1' END FROM documents),
o AS (SELECT g.field, CASE WHEN coalesce(trim(gold), '') = '' AND coalesce(trim(pred), '') = '' THEN 'tn' WHEN coalesce(trim(pred), '') = '' THEN 'fn' WHEN gold = pred THEN 'tp' ELSE 'wrong' END AS outcome FROM g LEFT JOIN p ON p.doc_id = g.doc_id AND p.field = g.field),
x AS (SELECT p.field, 'extra' AS outcome FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = p.doc_id AND g.field = p.field)), a AS (SELECT * FROM o UNION ALL SELECT * FROM x)
"""


def _outcomes(t):
    lab, doc = t.labels, t.documents
    rows = lambda df, q, x: df.select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("field"), q.alias("value")), F.struct(F.lit("toxic").alias("field"), x.alias("value")))).alias("s")).select("doc_id", "s.*")
    gold = rows(lab, F.col("quality").cast("string"), F.when(F.col("toxic") == 1, "1"))
    pred = rows(doc, F.when(F.col("n_chars") > 800, "1").otherwise("0"), F.when(F.contains("text", F.lit("worthless")), "1"))
    return J.gold_and_predictions(gold, pred, ["doc_id", "field"])


@query("jn18_outcomes", _GP + "SELECT field, outcome, count(*) AS n FROM a GROUP BY 1, 2")
def _(t):
    return _outcomes(t).groupBy("field", "outcome").agg(F.count("*").alias("n"))


@query(
    "agg26_precision_recall",
    _GP + ", c AS (SELECT field, count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'wrong') AS fp, count(*) FILTER (WHERE outcome IN ('fn', 'wrong')) AS fn FROM a GROUP BY ROLLUP (field)), d AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS r FROM c) SELECT field, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM d",
)
def _(t):
    r = A.precision_recall(_outcomes(t), ["field"])
    return r.select("field", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "agg28_document_quality",
    "SELECT doc_id, round(s, 6)::DOUBLE AS severity, CASE WHEN s >= 0.6 THEN 'block' WHEN s >= 0.3 THEN 'warn' ELSE 'ok' END AS verdict FROM (SELECT doc_id, CASE WHEN n_chars < 200 THEN 0.35 ELSE 0 END + CASE WHEN contains(text, '###') THEN 0.25 ELSE 0 END + CASE WHEN contains(text, '!!') THEN 0.25 ELSE 0 END + CASE WHEN contains(text, ' | ') THEN 0.15 ELSE 0 END AS s FROM documents)",
)
def _(t):
    d = t.documents.select("doc_id", (F.col("n_chars") < 200).alias("a"), *[F.contains("text", F.lit(x)).alias(n) for n, x in (("b", "###"), ("c", "!!"), ("d", " | "))])
    q = A.document_quality([("a", 0.35), ("b", 0.25), ("c", 0.25), ("d", 0.15)])
    return d.select("doc_id", F.round(q["severity"], 6).alias("severity"), q["verdict"].alias("verdict"))


@query("agg29_route_by_confidence", "SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'review' WHEN min(o_totalprice) / 100000 < 0.6 THEN 'review' ELSE 'auto' END AS route FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    scores = t.orders.select(F.col("o_custkey").alias("c_custkey"), (F.col("o_totalprice") / 100000).alias("score"))
    return L.routed(t.customer.select("c_custkey"), scores, "c_custkey")


@query("agg30_review_progress", "SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type <> 'view') AS reviewed, count(*) FILTER (WHERE event_type = 'view') AS remaining, count(*) FILTER (WHERE event_type = 'error') AS corrections FROM events GROUP BY 1")
def _(t):
    e = F.col("event_type")
    return L.review_progress(t.events.select("user_id", F.when(e == "view", "pending").otherwise("done").alias("status"), (e == "error").alias("corrected")), ["user_id"])


@query(
    "agg31_page_status",
    "WITH d AS (SELECT l_orderkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS c, CASE l_returnflag WHEN 'R' THEN 'flagged' WHEN 'A' THEN 'edited' ELSE 'approved' END AS s FROM lineitem) SELECT l_orderkey, coalesce(max(s) FILTER (WHERE c IS NULL), CASE WHEN bool_or(c IS NOT NULL AND s = 'flagged') THEN 'flagged' WHEN count(*) FILTER (WHERE c IS NOT NULL AND s IN ('approved', 'edited')) = count(c) AND count(*) FILTER (WHERE c IS NOT NULL AND s IN ('approved', 'edited')) >= 3 THEN 'approved' ELSE 'needs_review' END) AS status FROM d GROUP BY 1",
)
def _(t):
    s = F.when(F.col("l_returnflag") == "R", "flagged").when(F.col("l_returnflag") == "A", "edited").otherwise("approved")
    d = t.lineitem.select("l_orderkey", F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("component"), s.alias("decision"), F.lit(3).alias("expected"))
    return A.page_status(d, ["l_orderkey"])


@query("agg32_document_state", "SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'locked' WHEN bool_or(event_type = 'purchase') THEN 'decided' WHEN bool_or(event_type = 'signup') THEN 'processed' ELSE 'uploaded' END AS state FROM events GROUP BY 1")
def _(t):
    e = F.col("event_type")
    mark = F.when(e == "error", "locked").when(e == "purchase", "decided").when(e == "signup", "processed")
    return L.document_states(t.events.select("user_id", mark.alias("mark")), "user_id")


@query("agg33_histogram", "SELECT event_type, CASE WHEN value <= 10 THEN '10.0' WHEN value <= 50 THEN '50.0' WHEN value <= 90 THEN '90.0' ELSE '+Inf' END AS le, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return A.histogram(t.events, ["event_type"], "value", [10.0, 50.0, 90.0])


@query("agg34_signature_evidence", "SELECT l_orderkey, l_linenumber, s AS score, s >= 0.55 AS signed FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END * 0.45::DOUBLE + CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END * 0.35::DOUBLE + CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END * 0.20::DOUBLE AS s FROM lineitem)")
def _(t):
    one = lambda c: F.when(c, 1).otherwise(0)
    e = S.signature_evidence(one(F.col("l_returnflag") == "R"), one(F.col("l_linestatus") == "F"), one(F.col("l_quantity") > 25))
    return t.lineitem.select("l_orderkey", "l_linenumber", e["score"].alias("score"), e["signed"].alias("signed"))


@query("agg35_progress", "SELECT o_orderpriority, round(avg(CASE o_orderstatus WHEN 'F' THEN 100.0 WHEN 'P' THEN 50 ELSE 0 END), 6)::DOUBLE AS percent, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY 1")
def _(t):
    p = F.when(F.col("o_orderstatus") == "F", 100.0).when(F.col("o_orderstatus") == "P", 50.0).otherwise(0.0)
    return L.progress(t.orders.select("o_orderpriority", p.alias("percent")), ["o_orderpriority"])


@query("agg36_used_checks", "SELECT l_returnflag, list_sort(list(DISTINCT l_linenumber)) AS checks FROM lineitem GROUP BY 1")
def _(t):
    return L.used_checks(t.lineitem, ["l_returnflag"], "l_linenumber")


@query(
    "jn16_pending_and_gate",
    "WITH f AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS blocking FROM orders), r AS (SELECT o_orderkey, 'CONFIRM' AS a, o_orderkey % 11 = 0 AS stale FROM orders WHERE o_orderkey % 2 = 0), j AS (SELECT o_custkey, count(*) FILTER (WHERE blocking AND a IS NULL) AS pending, count(*) FILTER (WHERE coalesce(stale, false)) AS stale FROM f LEFT JOIN r ON r.o_orderkey = f.o_orderkey GROUP BY 1) SELECT *, CASE WHEN pending > 0 THEN 'blocked' WHEN stale > 0 THEN 'blocked-stale' ELSE 'ready' END AS gate FROM j",
)
def _(t):
    f = t.orders.select("o_custkey", F.col("o_orderkey").alias("finding_id"), (F.col("o_orderstatus") == "F").alias("blocking"))
    r = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("finding_id"), F.lit("CONFIRM").alias("action"), (F.col("o_orderkey") % 11 == 0).alias("stale"))
    return A.pending(f, r, ["o_custkey"])


@query("dsl9_rule_batches", "SELECT p_partkey, p_brand, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 15 AS BIGINT) AS batch FROM part")
def _(t):
    return L.batches(t.part.select("p_partkey", "p_brand"), "p_brand", "p_partkey")


@query(
    "agg6_review_summary",
    "WITH o AS (SELECT o_custkey % 20 AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'superseded' ELSE o_orderstatus END AS s, o_orderpriority AS p FROM orders) SELECT k, 'status' AS what, s AS value, count(*) AS n FROM o GROUP BY ALL UNION ALL SELECT k, 'severity', p, count(*) FROM o GROUP BY ALL",
)
def _(t):
    newer = F.when(F.col("o_orderkey") % 7 == 0, F.lit("newer"))
    findings = t.orders.select((F.col("o_custkey") % 20).alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("severity"), newer.alias("superseded_by"))
    return L.recomputed_summary(findings, ["k"])
