"""Scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X
from ..operators import rules as R
from .catalog import query


@query("fn1_normalise_name", "SELECT p_partkey, lower(trim(regexp_replace(replace(replace(p_name, '#', ' '), '-', ' '), '\\s+', ' ', 'g'))) AS name, trim(regexp_replace(replace(replace(p_brand, '#', ' '), '-', ' '), '\\s+', ' ', 'g')) AS brand FROM part")
def _(t):
    return t.part.select("p_partkey", X.normalise_name(F.col("p_name"), True, "#-").alias("name"), X.normalise_name(F.col("p_brand"), False, "#-").alias("brand"))


@query("fn2_slug", "SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM documents")
def _(t):
    return t.documents.select("doc_id", X.slug(F.col("text")).alias("slug"))


@query("fn3_dates", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS a, strftime(o_orderdate, '%d/%m/%Y') AS b, CAST(NULL AS VARCHAR) AS c FROM orders")
def _(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", X.normalise_date(F.date_format(d, "d-M-yyyy")).alias("a"), X.normalise_date(F.date_format(d, "yyyy-MM-dd")).alias("b"), X.normalise_date(F.col("o_orderstatus")).alias("c"))


@query("fn4_identifiers", "SELECT c_custkey, regexp_replace(upper(trim(regexp_replace(replace(c_name, '#', ' - '), '\\s+', ' ', 'g'))), '\\s*([-/])\\s*', '\\1', 'g') AS id FROM customer")
def _(t):
    return t.customer.select("c_custkey", X.normalise_identifier(F.replace("c_name", F.lit("#"), F.lit(" - "))).alias("id"))


@query(
    "fn5_field_values",
    "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS value, ['date'] AS reasons FROM orders",
)
def _(t):
    v = X.normalise_field(F.lit("order_date"), F.date_format("o_orderdate", "yyyy-M-d"))
    return t.orders.select("o_orderkey", v["value"].alias("value"), v["reasons"].alias("reasons"))


@query("fn6_placeholders", "SELECT o_orderkey, lower(trim(o_orderstatus)) IN ('', 'p', 'n/a') AS is_placeholder, lower(trim(o_orderstatus)) = 'p' AS allowed FROM orders")
def _(t):
    p = X.placeholder(F.col("o_orderstatus"), ["P", "n/a"], ["p"])
    return t.orders.select("o_orderkey", p["is_placeholder"].alias("is_placeholder"), p["allowed"].alias("allowed"))


@query("fn8_numbers", "SELECT c_custkey, CAST(regexp_replace(c_name, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS n FROM customer WHERE regexp_matches(regexp_replace(c_name, '[^0-9.\\-]', '', 'g'), '^[0-9]+$')")
def _(t):
    return t.customer.select("c_custkey", X.to_number(F.col("c_name")).alias("n")).where("n IS NOT NULL")


@query("fn10_composite_confidence", "SELECT event_id, round(coalesce(value / 100, 0.5) * 0.30 + coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 100 END, 0.5) * 0.25 + coalesce(CASE WHEN event_id % 6 = 0 THEN NULL ELSE (event_id % 6) / 5.0 END, 0.5) * 0.15 + 0.8 * 0.30, 6)::DOUBLE AS c FROM events")
def _(t):
    v = F.col("value") / 100
    c = S.composite_confidence(v, F.when(F.col("event_id") % 5 != 0, v), (F.col("event_id") % 6).cast("double"), F.lit(None))
    return t.events.select("event_id", F.round(c, 6).alias("c"))


@query("fn11_confidence_class", "SELECT event_id, CASE WHEN value / 100 >= 0.9 THEN 'high' WHEN value / 100 >= 0.7 THEN 'medium' ELSE 'low' END AS class FROM events")
def _(t):
    return t.events.select("event_id", S.confidence_class(F.col("value") / 100).alias("class"))


@query("fn12_page_confidence", "SELECT user_id, round(coalesce(avg(value / 100), 0.5) * 0.5 + coalesce(min(value / 100), 0.5) * 0.2 + 0.5 * 0.3, 6)::DOUBLE AS c FROM events GROUP BY 1")
def _(t):
    v = F.col("value") / 100
    return t.events.groupBy("user_id").agg(F.round(S.cloud_confidence(F.avg(v), F.min(v), F.lit(None).cast("double")), 6).alias("c"))


@query("fn14_quality_grade", "SELECT l_orderkey, l_linenumber, CASE WHEN m >= 0.9 THEN 'excellent' WHEN m >= 0.7 THEN 'good' WHEN m >= 0.5 THEN 'fair' ELSE 'poor' END AS grade FROM (SELECT l_orderkey, l_linenumber, (l_quantity / 50 + l_discount * 10 + l_tax * 10 + 1) / 4 AS m FROM lineitem)")
def _(t):
    g = S.quality_grade([F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10, F.lit(1)])
    return t.lineitem.select("l_orderkey", "l_linenumber", g["grade"].alias("grade"))


@query("fn15_calibrated", """SELECT event_id, round(greatest(0.0, least(1.0, value / 100 - least(1.0, (event_id % 13) / 10.0) * 0.2 - CASE WHEN event_type = 'view' AND event_id % 2 = 1 THEN 0.35 ELSE 0 END
 - CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 0.15 ELSE 0 END - least(0.2, (event_id % 4) * 0.07))), 4)::DOUBLE AS c, CASE WHEN event_id % 3 = 0 THEN 'critical' ELSE 'major' END AS criticality FROM events WHERE value > 0""")
def _(t):
    e, field = F.col("event_id"), F.when(F.col("event_id") % 3 == 0, "yes_no_na_1").otherwise("batch_no")
    c = S.calibrated(F.col("value") / 100, e % 13, F.col("event_type") == "view", e % 2 == 0, F.col("event_type") == "click", field, e % 4)
    return t.events.where("value > 0").select("event_id", c["value"].alias("c"), S.field_criticality(field, ["yes_no_na_1"]).alias("criticality"))


_REPAIRS = [("marks", r"(###|%%%|\$\$\$|&&&|\*\*\*)", ""), ("shout", "!!", "!"), ("bars", r" \| ", " ")]
_SAN = "regexp_replace(regexp_replace(regexp_replace(text, '(###|%%%|\\$\\$\\$|&&&|\\*\\*\\*)', '', 'g'), '!!', '!', 'g'), ' \\| ', ' ', 'g')"


@query(
    "fn17_sanitise",
    f"SELECT doc_id, md5({_SAN}) AS text, list_filter([CASE WHEN regexp_matches(text, '(###|%%%|\\$\\$\\$|&&&|\\*\\*\\*)') THEN 'marks' END, CASE WHEN contains(regexp_replace(text, '(###|%%%|\\$\\$\\$|&&&|\\*\\*\\*)', '', 'g'), '!!') THEN 'shout' END, CASE WHEN contains(text, ' | ') THEN 'bars' END], lambda x: x IS NOT NULL) AS tags FROM documents",
)
def _(t):
    s = X.sanitise(F.col("text"), _REPAIRS)
    return t.documents.select("doc_id", F.md5(s["text"]).alias("text"), s["tags"].alias("tags"))


@query("fn18_repair_severity", "SELECT doc_id, CAST(s AS INTEGER) AS score, CASE WHEN s >= 40 THEN 'high' WHEN s >= 18 THEN 'medium' WHEN s > 0 THEN 'low' ELSE 'none' END AS level FROM (SELECT doc_id, least(100, CASE WHEN contains(text, '###') THEN 40 ELSE 0 END + CASE WHEN contains(text, '!!') THEN 18 ELSE 0 END + CASE WHEN contains(text, ' | ') THEN 8 ELSE 0 END) AS s FROM documents)")
def _(t):
    tags = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(x)), x) for x in ("###", "!!", " | ")]))
    s = X.repair_severity(tags, ["###"], ["!!"])
    return t.documents.select("doc_id", s["score"].alias("score"), s["level"].alias("level"))


@query(
    "fn19_edit_criticality",
    "SELECT a.item_id, CASE WHEN levenshtein(x, y) <= 2 THEN 'minor' ELSE 'major' END AS c, levenshtein(x, y)::INTEGER AS d FROM (SELECT item_id, trim(regexp_replace(text, '[^ -~]', '', 'g')) AS x FROM benchmark) a JOIN (SELECT item_id - 1 AS item_id, trim(regexp_replace(text, '[^ -~]', '', 'g')) AS y FROM benchmark) b ON a.item_id = b.item_id",
)
def _(t):
    a = t.benchmark.select("item_id", F.regexp_replace("text", "[^ -~]", "").alias("x"))
    b = t.benchmark.select((F.col("item_id") - 1).alias("item_id"), F.regexp_replace("text", "[^ -~]", "").alias("y"))
    j = a.join(b, "item_id")
    return j.select("item_id", X.edit_criticality(F.col("x"), F.col("y")).alias("c"), F.levenshtein(F.trim("x"), F.trim("y")).alias("d"))


@query("fn21_literal_corrections", "SELECT doc_id, md5(replace(replace(text, 'the', 'THE'), 'is', 'IS')) AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.replace_literals(F.col("text"), [("is", "IS"), ("the", "THE")])["text"]).alias("text"))


@query("fn22_lines", "SELECT doc_id, CAST(count(*) FILTER (WHERE regexp_matches(line, '^\\s{0,3}#{1,6}\\s')) AS BIGINT) AS headings, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def _(t):
    l = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("k", X.line_kind(F.col("line")))
    return l.groupBy("doc_id").agg(F.count_if(F.col("k.heading")).alias("headings"), F.count("*").alias("lines"))


@query("fn24_page_counters", "SELECT o_orderkey, (o_orderkey % 9 + 1)::INTEGER AS x, (o_orderkey % 9 + 3)::INTEGER AS y, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence FROM orders")
def _(t):
    k = F.col("o_orderkey")
    text = F.concat(F.when(k % 2 == 0, "Record, Page ").otherwise("sheet "), (k % 9 + 1).cast("string"), F.lit(" of "), (k % 9 + 3).cast("string"))
    p = X.page_of(text)
    return t.orders.select("o_orderkey", p["x"].alias("x"), p["y"].alias("y"), p["confidence"].alias("confidence"))


@query("fn29_status_bucket", "SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'needs_attention' WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'compliant' WHEN o_orderstatus = 'F' THEN 'action_required' ELSE 'needs_attention' END AS bucket FROM orders")
def _(t):
    s = F.when(F.col("o_orderstatus") == "F", " Non_Compliant").when(F.col("o_orderstatus") == "P", "uncertain").otherwise("not_applicable")
    s = F.when(F.col("o_orderpriority") == "5-LOW", "error").otherwise(s)
    h = F.when(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"), "user_approved").otherwise("needs_review")
    return t.orders.select("o_orderkey", S.status_bucket(s, h).alias("bucket"))


@query("fn30_hitl_status", "SELECT event_id, CASE WHEN value / 100 >= 0.8 THEN 'auto_approved' ELSE 'needs_review' END AS s FROM events")
def _(t):
    return t.events.select("event_id", S.hitl_status(F.col("value") / 100).alias("s"))


@query("fn31_evidence_text", "SELECT conv_id, string_agg(CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END, '; ' ORDER BY turn, text) AS evidence FROM conversations GROUP BY 1")
def _(t):
    x = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(x, lambda r: X.shorten(r["text"], 60)), "; ").alias("evidence"))


@query("fn33_running_cost", "SELECT doc_id, length(text) // 4 AS tokens, sum(length(text) // 4) OVER (PARTITION BY source ORDER BY doc_id) <= 5000 AS within FROM documents")
def _(t):
    n = F.floor(F.length("text") / 4)
    return t.documents.select("doc_id", n.alias("tokens"), (F.sum(n).over(Window.partitionBy("source").orderBy("doc_id")) <= 5000).alias("within"))


@query("fn34_cell_kind", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'filler' WHEN event_id % 4 = 1 THEN 'date' WHEN event_id % 4 = 2 THEN 'empty' ELSE 'text' END AS kind FROM events")
def _(t):
    k = F.col("event_id") % 4
    v = F.when(k == 0, "**N/A**").when(k == 1, "12/03/2024").when(k == 2, " _ ").otherwise(F.col("event_type"))
    return t.events.select("event_id", X.cell_kind(v).alias("kind"))


@query("fn38_json_pairs", "SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def _(t):
    kv = F.from_json("props", "map<string,bigint>")
    return t.events.select("event_id", F.explode(kv).alias("key", "value")).where("NOT startswith(key, '_')")


@query("fn41_box_overlap", "SELECT l_orderkey, l_linenumber, round(CASE WHEN u > 0 THEN i / u ELSE 0 END, 6) AS iou FROM (SELECT *, 100.0 + 100.0 - i AS u FROM (SELECT l_orderkey, l_linenumber, (greatest(0.0, least(10.0, l_quantity + 10) - greatest(0.0, l_quantity)) * greatest(0.0, least(10.0, l_linenumber + 10.0) - greatest(0.0, l_linenumber)))::DOUBLE AS i FROM lineitem))")
def _(t):
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    a = [F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0)]
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(S.iou(a, [q, n, q + 10, n + 10]), 6).alias("iou"))


@query("fn44_cleanup", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'))) AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.cleanup(F.col("text"))).alias("text"))


@query("fn46_digests", "SELECT o_orderkey, sha256(concat_ws(chr(31), o_orderkey, o_orderstatus, o_orderpriority)) AS digest FROM orders")
def _(t):
    return t.orders.select("o_orderkey", R.finding_id(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("digest"))


@query("fn47_snapshot_hash", "SELECT o_custkey, sha256(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1")
def _(t):
    x = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    return t.orders.groupBy("o_custkey").agg(F.sha2(F.array_join(F.transform(x, lambda r: F.concat_ws(":", r["o_orderkey"], r["o_orderstatus"])), ","), 256).alias("digest"))


@query("fn51_redact", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}', '[ip]', 'g'), '[0-9a-f]{40}', '[token]', 'g')) AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.redact(F.col("text"), {"ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "token": "[0-9a-f]{40}"})).alias("text"))


@query("fn52_component_page", "SELECT l_orderkey, l_linenumber, l_linenumber AS page FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", X.component_page(F.concat(F.lit("p"), "l_linenumber", F.lit("-table-1"))).alias("page"))
