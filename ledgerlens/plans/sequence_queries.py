"""Sequence, top-k, set and streaming-twin queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import sequences as W
from ..operators import listings as L
from .catalog import query


def _pages(t):
    """Conversations as documents: a page a turn, a section where the speaker is the user."""
    p = t.conversations.groupBy("conv_id", (F.col("turn") + 1).cast("int").alias("page")).agg(F.min("role").alias("role"), F.min("text").alias("text"))
    return p


_P = "WITH p AS (SELECT conv_id, CAST(turn + 1 AS INTEGER) AS page, min(role) AS role, min(text) AS text FROM conversations GROUP BY 1, 2)"


@query(
    "win1_assemble_spans",
    _P + """, c AS (SELECT *, coalesce(last_value(CASE WHEN role <> 'assistant' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY page), 'unsectioned') AS s FROM p),
d AS (SELECT *, CASE WHEN s IS NOT DISTINCT FROM lag(s) OVER (PARTITION BY conv_id ORDER BY page) THEN 0 ELSE 1 END AS n FROM c), e AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY page) AS g FROM d)
SELECT conv_id, s AS section_id, min(page) AS start_page, max(page) AS end_page FROM e GROUP BY conv_id, g, s""",
)
def _(t):
    p = _pages(t).withColumn("section_id", F.when(F.col("role") != "assistant", F.col("role")))
    return W.assemble_spans(p, ["conv_id"]).drop("span")


@query(
    "win2_pick_candidates",
    _P
    + """, o AS (SELECT conv_id, page, role AS s, 0.9 AS c, 1 AS r FROM p UNION ALL SELECT conv_id, page, 'alt-' || (length(text) % 3), (length(text) % 10) / 10.0, 2 FROM p),
g AS (SELECT conv_id, page, list(s ORDER BY c DESC, r) AS ss, list(c ORDER BY c DESC, r) AS cs, row_number() OVER (PARTITION BY conv_id ORDER BY page) AS k FROM o GROUP BY conv_id, page)
SELECT conv_id, page, s AS section_id FROM (WITH RECURSIVE w AS (
  SELECT conv_id, k, page, ss[1] AS s FROM g WHERE k = 1
  UNION ALL SELECT g.conv_id, g.k, g.page, CASE WHEN g.ss[1] = w.s AND g.ss[2] <> w.s AND g.cs[2] >= 0.6 THEN g.ss[2] ELSE g.ss[1] END FROM w JOIN g ON g.conv_id = w.conv_id AND g.k = w.k + 1)
SELECT * FROM w)""",
)
def _(t):
    p = _pages(t)
    a = p.select("conv_id", "page", F.col("role").alias("section_id"), F.lit(0.9).alias("confidence"), F.lit(1).alias("rank"))
    b = p.select("conv_id", "page", F.concat(F.lit("alt-"), (F.length("text") % 3).cast("string")).alias("section_id"), (F.length("text") % 10 / 10.0).alias("confidence"), F.lit(2).alias("rank"))
    return W.pick_candidates(a.unionByName(b), ["conv_id"])


@query(
    "win3_packet_sections",
    _P
    + """, q AS (SELECT conv_id, page, 'Page ' || (page % 3 + 1) || ' of ' || (page // 5 + 3) || chr(10) || CASE WHEN page % 7 = 2 THEN '# ' ELSE '' END || text AS text FROM p),
ln AS (SELECT conv_id, page, list_filter(list_transform(regexp_split_to_array(text, '\\n')[1:24], lambda x: lower(trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '[^A-Za-z0-9:/.-]+', ' ', 'g'), ' '))), lambda x: x <> '' AND NOT regexp_matches(x, '\\bpage\\s+(\\d+)\\s+of\\s+(\\d+)\\b'))[1:3] AS l, CASE WHEN page % 7 = 2 THEN lower(trim(regexp_replace(string_split(text, chr(10))[2], '[^A-Za-z0-9:/.-]+', ' ', 'g'), ' ')) END AS h FROM q),
t AS (SELECT conv_id, page, page % 3 + 1 AS x, page // 5 + 3 AS y, l, nullif(h, '') AS h, list_distinct(list_filter(flatten(list_transform(l, lambda x: string_split(x, ' '))), lambda x: length(x) > 2)) AS k FROM ln),
w AS (SELECT *, lag(x) OVER r AS px, lag(y) OVER r AS py, row_number() OVER r AS nth, coalesce(last_value(CASE WHEN len(l) > 0 THEN k END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS pk FROM t WINDOW r AS (PARTITION BY conv_id ORDER BY page)),
y AS (SELECT *, CASE WHEN nth = 1 THEN 'initial_section' WHEN x = 1 AND (px > 1 OR py <> y) THEN 'page_counter_reset' WHEN len(k) >= 3 AND len(list_intersect(k, pk)) < 0.22 * len(list_distinct(list_concat(k, pk))) THEN 'header_signature_shift' END AS why FROM w),
s AS (SELECT *, count(why) OVER (PARTITION BY conv_id ORDER BY page) AS section FROM y),
z AS (SELECT conv_id, section, min(page) AS a, max(page) AS b, arg_min(coalesce(h, l[1], 'section_' || lpad(CAST(section AS VARCHAR), 3, '0')), page) AS name, arg_min(why, page) AS why FROM s GROUP BY 1, 2)
SELECT conv_id, section, 'pkt_sec_' || lpad(CAST(section AS VARCHAR), 3, '0') AS section_id, substr(name, 1, 120) AS name, a AS start_page, CAST(coalesce(lead(a) OVER (PARTITION BY conv_id ORDER BY section) - 1, b) AS INTEGER) AS end_page, CAST(CASE why WHEN 'initial_section' THEN 1.0 WHEN 'page_counter_reset' THEN 0.92 ELSE 0.76 END AS DOUBLE) AS confidence, why FROM z""",
)
def _(t):
    page = F.col("page")
    head = F.concat(F.lit("Page "), (page % 3 + 1).cast("string"), F.lit(" of "), (F.floor(page / 5) + 3).cast("string"), F.lit("\n"), F.when(page % 7 == 2, "# ").otherwise(""))
    return W.packet_sections(_pages(t).select("conv_id", "page", F.concat(head, "text").alias("text")), ["conv_id"])


@query(
    "win4_boundary_units",
    """WITH p AS (SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS page, CAST(o_orderkey % 4 AS INTEGER) AS x, CAST(o_orderkey % 2 + 4 AS INTEGER) AS y FROM orders),
u AS (SELECT *, sum(CASE WHEN x = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY page) AS unit FROM p),
b AS (SELECT *, CASE WHEN x <> 1 AND (y <> lag(y) OVER w OR x <= lag(x) OVER w) THEN 1 ELSE 0 END AS br FROM u WHERE unit > 0 WINDOW w AS (PARTITION BY o_custkey, unit ORDER BY page)),
k AS (SELECT *, max(br) OVER (PARTITION BY o_custkey, unit ORDER BY page) AS broken FROM b)
SELECT o_custkey, CAST(unit AS BIGINT) AS unit, min(page) AS start_page, max(page) AS end_page, count(*) AS n FROM k WHERE broken = 0 GROUP BY 1, 2""",
)
def _(t):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    p = t.orders.select("o_custkey", n.alias("page"), (F.col("o_orderkey") % 4).cast("int").alias("x"), (F.col("o_orderkey") % 2 + 4).cast("int").alias("y"))
    return W.boundary_units(p, ["o_custkey"]).select("o_custkey", "unit", "start_page", "end_page", "n")


_GAPS = """WITH c AS (SELECT DISTINCT user_id, CAST(event_id % 40 + 1 AS INTEGER) AS page FROM events), k AS (SELECT user_id, page FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT CAST(unnest(range(1, 41)) AS INTEGER) AS page)),
m AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = k.user_id AND c.page = k.page)), i AS (SELECT *, page - row_number() OVER (PARTITION BY user_id ORDER BY page) AS g FROM m)"""


def _covered(t):
    c = t.events.select("user_id", (F.col("event_id") % 40 + 1).cast("int").alias("page")).distinct()
    return c, t.events.select("user_id", F.lit(40).alias("total")).distinct()


@query("win5_missing_runs", _GAPS + " SELECT user_id, min(page) AS start_page, max(page) AS end_page FROM i GROUP BY user_id, g")
def _(t):
    return W.missing_pages(*_covered(t), ["user_id"])


@query(
    "win6_format_pages",
    """WITH c AS (SELECT DISTINCT l_orderkey, l_linenumber AS page FROM lineitem), i AS (SELECT *, page - row_number() OVER (PARTITION BY l_orderkey ORDER BY page) AS g FROM c), r AS (SELECT l_orderkey, min(page) AS a, max(page) AS b FROM i GROUP BY l_orderkey, g)
SELECT l_orderkey, string_agg(CASE WHEN b - a + 1 >= 3 THEN a || ' to ' || b WHEN b > a THEN a || ', ' || b ELSE CAST(a AS VARCHAR) END, ', ' ORDER BY a) AS pages FROM r GROUP BY 1""",
)
def _(t):
    return W.format_pages(t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("page")), ["l_orderkey"])


_RANGES = "r AS (SELECT o_custkey, o_orderkey AS ordinal, CAST(o_orderkey % 90 + 1 AS INTEGER) AS a, CAST(o_orderkey % 90 + 1 + o_orderkey % 13 AS INTEGER) AS b FROM orders)"


def _ranges(t):
    return t.orders.select("o_custkey", F.col("o_orderkey").alias("ordinal"), (F.col("o_orderkey") % 90 + 1).cast("int").alias("start_page"), (F.col("o_orderkey") % 90 + 1 + F.col("o_orderkey") % 13).cast("int").alias("end_page"))


@query(
    "win7_resolve_overlaps",
    f"WITH {_RANGES}, x AS (SELECT o_custkey, ordinal, greatest(a, coalesce(max(b) OVER (PARTITION BY o_custkey ORDER BY a, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, a)) AS start_page, b AS end_page FROM r) SELECT * FROM x WHERE start_page <= end_page",
)
def _(t):
    return W.resolve_overlaps(_ranges(t), ["o_custkey"])


@query("fn25_clamp", f"WITH {_RANGES} SELECT o_custkey, ordinal, greatest(a, 1) AS start_page, least(b, 60) AS end_page FROM r WHERE greatest(a, 1) <= least(b, 60)")
def _(t):
    totals = t.orders.select("o_custkey", F.lit(60).alias("total")).distinct()
    return W.clamp(_ranges(t), totals, ["o_custkey"])


@query("dsl18_overlapping_sections", f"WITH {_RANGES} SELECT x.o_custkey, x.ordinal AS first, y.ordinal AS second FROM r x JOIN r y ON x.o_custkey = y.o_custkey AND x.ordinal < y.ordinal AND x.a <= y.b AND y.a <= x.b")
def _(t):
    r = _ranges(t)
    o = r.select("o_custkey", F.col("ordinal").alias("second"), F.col("start_page").alias("a"), F.col("end_page").alias("b"))
    j = r.join(o, "o_custkey").where("ordinal < second AND start_page <= b AND a <= end_page")
    return j.select("o_custkey", F.col("ordinal").alias("first"), "second")


@query(
    "win8_split_by_unit",
    """WITH s AS (SELECT user_id, min(event_id) // 100 AS section_id, 1 AS a, 40 AS b FROM events GROUP BY 1), pg AS (SELECT user_id, section_id, CAST(unnest(range(1, 41)) AS INTEGER) AS page FROM s),
x AS (SELECT *, CASE WHEN page <= 7 + user_id % 5 THEN 1 WHEN page <= 25 THEN 2 ELSE 3 END AS unit FROM pg)
SELECT user_id, section_id, unit, min(page) AS start_page, max(page) AS end_page FROM x GROUP BY 1, 2, 3""",
)
def _(t):
    s = t.events.groupBy("user_id").agg(F.floor(F.min("event_id") / 100).alias("section_id")).withColumn("start_page", F.lit(1)).withColumn("end_page", F.lit(40))
    cut = (F.col("user_id") % 5 + 7).cast("int")
    units = s.select("user_id", F.explode(F.array(F.struct(F.lit(1).alias("unit"), F.lit(1).alias("start_page"), cut.alias("end_page")), F.struct(F.lit(2).alias("unit"), (cut + 1).alias("start_page"), F.lit(25).alias("end_page")), F.struct(F.lit(3).alias("unit"), F.lit(26).alias("start_page"), F.lit(40).alias("end_page")))).alias("x")).select("user_id", "x.*")
    return W.split_by_unit(s, units, ["user_id"])


@query("win9_unique_ids")
def _(t):
    s = t.lineitem.select("l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ordinal"), F.col("l_returnflag").alias("section_id"))
    return W.unique_ids(s, ["l_orderkey"])


@query(
    "win10_route_pages",
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page FROM events), r AS (SELECT user_id, page, CASE WHEN value >= 90 THEN 'auto' WHEN value >= 70 THEN 'batch' ELSE 'required' END AS route FROM e)
SELECT user_id, page::INTEGER AS page, route, CAST(CASE route WHEN 'auto' THEN 999 WHEN 'batch' THEN 100 + q ELSE q END AS BIGINT) AS priority FROM (SELECT *, sum(CASE WHEN route = 'required' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY page) AS q FROM r)""",
)
def _(t):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return W.route_pages(t.events.select("user_id", n.alias("page"), (F.col("value") / 100).alias("confidence")), ["user_id"]).drop("confidence")


@query(
    "win11_gap_neighbours",
    _GAPS + """, gaps AS (SELECT user_id, min(page) AS a, max(page) AS b FROM i GROUP BY user_id, g), ci AS (SELECT *, page - row_number() OVER (PARTITION BY user_id ORDER BY page) AS g FROM c), s AS (SELECT user_id, min(page) AS a, max(page) AS b, 's' || min(page) AS id FROM ci GROUP BY user_id, g)
SELECT user_id, a AS start_page, b AS end_page, (SELECT arg_max(s.id, s.b) FROM s WHERE s.user_id = gaps.user_id AND s.b < gaps.a) AS before, (SELECT arg_min(s.id, s.a) FROM s WHERE s.user_id = gaps.user_id AND s.a > gaps.b) AS after FROM gaps""",
)
def _(t):
    c, totals = _covered(t)
    s = W.islands(c, ["user_id"]).withColumn("section_id", F.concat(F.lit("s"), "start_page"))
    return W.gap_neighbours(W.missing_pages(c, totals, ["user_id"]), s, ["user_id"])


@query(
    "win12_latest_active",
    "WITH l AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN event_id + 1 END AS sup FROM events), a AS (SELECT * FROM l WHERE event_id NOT IN (SELECT sup FROM l WHERE sup IS NOT NULL)) SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM a) WHERE n = 1",
)
def _(t):
    log = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("event_id") + 1).alias("sup"))
    return W.latest_active(log, "user_id", "event_id", "sup", "ts").select("user_id", "event_id")


@query(
    "win13_repeating_headers",
    """SELECT source, line, count(*) AS n FROM (SELECT source, trim(trim(trim(line, w), '#'), w) AS line FROM (SELECT source, E' \\t\\r\\n\\f\\x0b' AS w, unnest(string_split(trim(text, E' \\t\\r\\n\\f\\x0b'), chr(10))[1:3]) AS line FROM documents)) WHERE length(line) > 5 GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def _(t):
    return W.repeating_headers(t.documents.select("source", "text"), ["source"])


@query(
    "win14_heading_sections",
    """WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS line, unnest(p) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)), h AS (SELECT * FROM l WHERE length(text) BETWEEN 1 AND 30)
SELECT h.doc_id, CAST(h.line AS INTEGER) AS line, h.text, CAST(coalesce(lead(h.line) OVER (PARTITION BY h.doc_id ORDER BY h.line) - 1, m.m) AS INTEGER) AS end_line FROM h JOIN (SELECT doc_id, max(line) AS m FROM l GROUP BY 1) m ON m.doc_id = h.doc_id""",
)
def _(t):
    l = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("line"), "text", F.length("text").between(1, 30).alias("heading"))
    return W.heading_sections(l, ["doc_id"])


@query(
    "win15_truncation",
    _GAPS + " SELECT user_id, round((40 - count(*)) / 40.0, 6)::DOUBLE AS coverage, min(page) AS first_missing FROM m GROUP BY 1 HAVING (40 - count(*)) / 40.0 < 0.97",
)
def _(t):
    return W.truncation(*_covered(t), ["user_id"]).withColumn("coverage", F.round("coverage", 6))


@query(
    "src12_page_ranges",
    "SELECT o_custkey, c::INTEGER AS chunk, (c * 5 + 1)::INTEGER AS start_page, least(c * 5 + 5, n)::INTEGER AS end_page FROM (SELECT o_custkey, n, unnest(range(0, CAST(ceil(n / 5.0) AS BIGINT))) AS c FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1))",
)
def _(t):
    totals = t.orders.groupBy("o_custkey").agg(F.count("*").cast("int").alias("total"))
    return W.page_ranges(totals, ["o_custkey"], 5)


# ---------------------------------------------------------------- top-k and sets
@query(
    "top1_review_priority",
    """SELECT l_orderkey, l_linenumber, round(least(100.0, (1 - (0.5 + l_discount)) * 70 * CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.4 ELSE 0.6 END + least(20.0, l_linenumber * 2.0) + least(10.0, (l_linenumber % 4) * 4.0) + CASE WHEN l_linestatus = 'F' THEN 15 ELSE 0 END), 2)::DOUBLE AS priority,
CASE l_returnflag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'minor' ELSE l_returnflag END || '_field_low_confidence' AS reason FROM lineitem
UNION ALL SELECT o_orderkey, 0, round(least(100.0, 30 + least(25.0, (o_orderkey % 12) * 3.0) + CASE WHEN o_orderstatus = 'F' THEN 20 ELSE 0 END), 2)::DOUBLE, 'no_structured_fields' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def _(t):
    kind = F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "minor").otherwise(F.col("l_returnflag"))
    n = F.col("l_linenumber")
    p = S.review_priority(0.5 + F.col("l_discount"), kind, n, n % 4, F.col("l_linestatus") == "F")
    fields = t.lineitem.select("l_orderkey", "l_linenumber", p["score"].alias("priority"), p["reason"].alias("reason"))
    bare = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    p = S.fieldless_priority(F.col("o_orderkey") % 12, F.col("o_orderstatus") == "F")
    rest = bare.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), p["score"].alias("priority"), p["reason"].alias("reason"))
    return fields.unionByName(rest).orderBy(F.desc("priority"), "l_orderkey", "l_linenumber")


@query("top2_report_order", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderpriority, o_orderkey) AS INTEGER) AS place FROM orders QUALIFY place <= 100")
def _(t):
    bucket = F.when(F.col("o_orderstatus") == "F", "action_required").when(F.col("o_orderstatus") == "P", "needs_attention").otherwise("compliant")
    top = L.report_order(t.orders.select(bucket.alias("bucket"), F.col("o_orderpriority").alias("agent"), F.col("o_orderkey").alias("rule_id")), 100)
    rank = F.array_position(F.array(*map(F.lit, L.BUCKETS)), F.col("bucket"))
    held = top.agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "agent", "rule_id"))).alias("all"))
    return held.select(F.posexplode("all").alias("n", "x")).select(F.col("x.rule_id").alias("o_orderkey"), (F.col("n") + 1).alias("place"))


@query("top4_review_queue", "SELECT event_id, value FROM events WHERE event_type = 'error' ORDER BY value, event_id LIMIT 20")
def _(t):
    items = t.events.select(F.col("event_id").alias("id"), F.col("value").alias("confidence"), F.when(F.col("event_type") == "error", "pending").otherwise("done").alias("status"))
    return L.review_queue(items, 20).select(F.col("id").alias("event_id"), F.col("confidence").alias("value"))


@query("top6_documents_page", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def _(t):
    return L.newest(t.orders, "o_orderdate", "o_orderkey", 25, 50).select("o_orderkey")


@query("top7_mitigation", "SELECT conv_id, coalesce(arg_max(text, struct_pack(a := length(text), b := -turn)) FILTER (WHERE trim(text) <> '' AND role = 'assistant'), 'default') AS text FROM (SELECT conv_id, turn, role, min(text) AS text FROM conversations GROUP BY 1, 2, 3) GROUP BY 1")
def _(t):
    c = t.conversations.groupBy("conv_id", "turn", "role").agg(F.min("text").alias("text"))
    said = c.select("conv_id", F.col("turn").alias("ordinal"), F.when(F.col("role") == "assistant", F.col("text")).alias("recommendation"))
    return L.mitigation(said, ["conv_id"], "default")


@query("top8_page_max", "SELECT l_orderkey, max(l_discount) AS top FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.max("l_discount").alias("top"))


@query("top9_runs_by_start", "SELECT user_id, n::INTEGER AS n FROM (SELECT user_id, row_number() OVER (ORDER BY m DESC NULLS LAST, user_id) AS n FROM (SELECT user_id, max(CASE WHEN event_type = 'signup' THEN ts END) AS m FROM events GROUP BY 1)) WHERE n <= 50")
def _(t):
    m = t.events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("m"))
    top = m.orderBy(F.desc_nulls_last("m"), "user_id").limit(50)
    return top.select("user_id", F.row_number().over(Window.orderBy(F.desc_nulls_last("m"), "user_id")).alias("n"))


@query(
    "top10_event_cap",
    "WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) SELECT user_id, event_id, 'event' AS kind FROM n WHERE i <= 5 UNION ALL SELECT user_id, NULL, 'overflow' FROM n GROUP BY 1 HAVING count(*) > 5",
)
def _(t):
    return L.capped(t.events, ["user_id"], "event_id", 5)


@query("set1_union_findings", "SELECT o_orderkey AS id, 'order' AS kind, o_orderstatus AS status FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT c_custkey, 'customer', NULL FROM customer WHERE c_acctbal < 0")
def _(t):
    a = t.orders.where("o_totalprice > 400000").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_orderstatus").alias("status"))
    return a.unionByName(t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")), allowMissingColumns=True)


@query("set2_uncovered", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    return t.customer.select("c_custkey").join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").distinct()


@query("set3_missing_section_types", "SELECT n.n_nationkey, s.segment FROM nation n CROSS JOIN (SELECT DISTINCT c_mktsegment AS segment FROM customer) s WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n.n_nationkey AND c_mktsegment = s.segment AND c_acctbal > 9000)")
def _(t):
    kinds = t.customer.select(F.col("c_mktsegment").alias("segment")).distinct()
    have = t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment"))
    return t.nation.select("n_nationkey").join(F.broadcast(kinds), how="cross").join(have, ["n_nationkey", "segment"], "left_anti")


@query("set4_unused_checks", "SELECT p_type FROM part EXCEPT SELECT p_type FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity >= 50 AND l_discount >= 0.1 AND l_tax >= 0.08")
def _(t):
    used = t.part.join(t.lineitem.where("l_quantity >= 50 AND l_discount >= 0.1 AND l_tax >= 0.08"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return L.unused_checks(t.part, used, "p_type")


@query(
    "set5_jaccard",
    "WITH a AS (SELECT l_orderkey AS k, list_distinct(list(l_suppkey)) AS x FROM lineitem GROUP BY 1) SELECT a.k, round(CASE WHEN len(list_distinct(list_concat(a.x, b.x))) = 0 THEN 1.0 ELSE len(list_intersect(a.x, b.x)) * 1.0 / len(list_distinct(list_concat(a.x, b.x))) END, 6)::DOUBLE AS sim FROM a JOIN a b ON b.k = a.k + 1",
)
def _(t):
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_suppkey").alias("x"))
    b = a.select((F.col("k") - 1).alias("k"), F.col("x").alias("y"))
    return a.join(b, "k").select("k", F.round(S.jaccard(F.col("x"), F.col("y")), 6).alias("sim"))


@query(
    "set6_detector_union",
    "WITH u AS (SELECT o_custkey, o_orderpriority AS kind, o_orderstatus AS v, 1 AS src, o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderpriority, o_orderstatus, 2, o_orderkey FROM orders WHERE o_orderkey % 2 = 1) SELECT o_custkey, kind, v, src FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, kind ORDER BY src, k) AS n FROM u) WHERE n = 1",
)
def _(t):
    o = t.orders.select("o_custkey", F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("v"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(2).alias("src"), F.col("o_orderkey").alias("k"))
    first = F.min(F.struct("src", "k", "v"))
    return o.groupBy("o_custkey", "kind").agg(first.alias("f")).select("o_custkey", "kind", "f.v", "f.src")


@query("set7_last_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def _(t):
    return L.reduced_state(t.events, ["user_id"], "event_id", "event_type")


@query(
    "str2_latest_within_ttl",
    "WITH m AS (SELECT max(ts) AS now FROM events) SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events, m WHERE ts >= now - INTERVAL 7 DAY GROUP BY 1",
)
def _(t):
    now = t.events.agg(F.max("ts").alias("now"))
    live = t.events.join(F.broadcast(now), how="cross").where(F.expr("ts >= now - INTERVAL 7 DAYS"))
    return live.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))
