"""Reconciliation, rule, join and classification queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import classify as C
from ..operators import joins as J
from ..operators import rules as R
from .catalog import query

_TOTALS = """
WITH lines AS (SELECT l_orderkey AS key, sum(CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(28,4))) AS v, count(*) AS n FROM lineitem GROUP BY 1),
j AS (SELECT o.o_orderkey AS sid, o.o_custkey AS cust, CAST(l.v AS DOUBLE) AS s, o.o_totalprice AS t, l.n FROM orders o LEFT JOIN lines l ON o.o_orderkey = l.key)
"""
_STATUS = "CASE WHEN s IS NULL THEN 'unevaluated' WHEN greatest(abs(s), abs(t)) = 0 THEN 'indeterminate' WHEN abs(s - t) <= greatest(abs(s), abs(t)) * 0.5 THEN 'pass' ELSE 'open' END"


def order_totals(t):
    """Order totals against the sum of their lines, within 50 percent."""
    value = F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).cast("decimal(28,4)"))
    target = t.lineitem.groupBy(F.col("l_orderkey").alias("key")).agg(value.cast("double").alias("value")).withColumn("ordinal", F.lit(0))
    source = t.orders.select(F.col("o_orderkey").alias("sid"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"), "o_custkey")
    return J.reconcile(source.drop("o_custkey"), target, lambda a, b: S.compare_numeric(a, b, "percent", 50)), source


@query("jn1_order_totals", _TOTALS + f"SELECT sid, {_STATUS} AS status FROM j")
def _(t):
    return order_totals(t)[0].select("sid", "status")


@query("rul2_status_counts", _TOTALS + f"SELECT {_STATUS} AS status, count(*) AS n FROM j GROUP BY 1")
def _(t):
    return order_totals(t)[0].groupBy("status").agg(F.count("*").alias("n"))


for _kind, _tol, _hold in (("absolute", 100.0, "abs(s - t) <= 100"), ("percent", 10.0, "abs(s - t) <= greatest(abs(s), abs(t)) * 0.1"), ("relative", 0.2, "abs(s - t) <= abs(t) * 0.2"), (None, 0.0, "s = t")):
    _base = {"percent": "greatest(abs(s), abs(t))", "relative": "abs(t)"}.get(_kind, "1")

    @query(
        f"fn20_compare_{_kind or 'exact'}",
        f"SELECT l_orderkey, l_linenumber, CASE WHEN s IS NULL OR t IS NULL OR {_base} = 0 THEN 'indeterminate' WHEN {_hold} THEN 'pass' ELSE 'open' END AS status "
        "FROM (SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 2) AS s, p_retailprice AS t FROM lineitem JOIN part ON l_partkey = p_partkey)",
    )
    def _(t, kind=_kind, tol=_tol):
        j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        # To cents as SQL rounds doubles: the product is rounded, not the shortest decimal that reads as the double.
        cents = F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100
        return j.select("l_orderkey", "l_linenumber", S.compare_numeric(cents, F.col("p_retailprice"), kind, tol).alias("status"))


for _mult in ("first", "all", "error"):
    _rows = {
        "all": "SELECT p.p_partkey AS sid, CASE WHEN l.l_partkey IS NULL THEN 'indeterminate' WHEN abs(p.p_size - l.q) <= 5 THEN 'pass' ELSE 'open' END AS status FROM part p LEFT JOIN l ON l.l_partkey = p.p_partkey",
        "first": "SELECT p.p_partkey AS sid, CASE WHEN l.l_partkey IS NULL THEN 'indeterminate' WHEN abs(p.p_size - l.q) <= 5 THEN 'pass' ELSE 'open' END AS status FROM part p LEFT JOIN (SELECT * FROM l WHERE o = 1) l ON l.l_partkey = p.p_partkey",
        "error": "SELECT p.p_partkey AS sid, CASE WHEN l.l_partkey IS NULL OR l.n > 1 THEN 'indeterminate' WHEN abs(p.p_size - l.q) <= 5 THEN 'pass' ELSE 'open' END AS status FROM part p LEFT JOIN (SELECT * FROM l WHERE o = 1) l ON l.l_partkey = p.p_partkey",
    }[_mult]

    @query(
        f"jn1_multiplicity_{_mult}",
        "WITH l AS (SELECT l_partkey, l_quantity AS q, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS o, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem) " + _rows,
    )
    def _(t, mult=_mult):
        source = t.part.select(F.col("p_partkey").alias("sid"), F.col("p_partkey").alias("key"), F.col("p_size").cast("double").alias("value"))
        target = t.lineitem.select(F.col("l_partkey").alias("key"), F.struct("l_orderkey", "l_linenumber").alias("ordinal"), F.col("l_quantity").alias("value"))
        found = J.reconcile(source, target, lambda a, b: S.compare_numeric(a, b, "absolute", 5), mult, "flag_as_indeterminate")
        return found.select("sid", "status")


@query(
    "jn2_entity_keys",
    "SELECT c_custkey, CAST(CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT) AS VARCHAR) AS step, upper(regexp_replace(c_name, '\\s+', '', 'g')) AS batch, lower(trim(replace(replace(c_name, '#', ' '), '_', ' '))) AS norm FROM customer",
)
def _(t):
    n = F.col("c_name")
    return t.customer.select("c_custkey", J.entity_key("step_number", n).alias("step"), J.entity_key("batch_id", n).alias("batch"), J.entity_key("normalise", n, "#_").alias("norm"))


@query(
    "jn3_alias_resolution",
    "WITH a(v, canonical) AS (VALUES ('automobile', 'vehicle'), ('machinery', 'vehicle'), ('household', 'home'), ('furniture', 'home')) "
    "SELECT c_custkey, canonical FROM customer LEFT JOIN a ON a.v = lower(trim(c_mktsegment))",
)
def _(t):
    aliases = t.values([("AUTOMOBILE", "vehicle"), ("Machinery", "vehicle"), (" household", "home"), ("FURNITURE ", "home")], "variant string, canonical string")
    return J.resolve_alias(t.customer, "c_mktsegment", aliases).select("c_custkey", "canonical")


_SECTIONS = """
WITH p AS (SELECT conv_id, CAST(turn + 1 AS INTEGER) AS page, role, text FROM conversations),
s AS (SELECT conv_id, 'opening' AS section_id, 1 AS ordinal, 1 AS a, 2 AS b FROM p GROUP BY 1 UNION ALL SELECT conv_id, 'body', 2, 2, CAST(max(page) - 1 AS INTEGER) FROM p GROUP BY 1 HAVING max(page) > 2)
"""


def _sections(t):
    pages = t.conversations.select("conv_id", (F.col("turn") + 1).cast("int").alias("page"), "role", "text")
    last = pages.groupBy("conv_id").agg(F.max("page").alias("m"))
    mk = lambda df, n, o, a, b: df.select("conv_id", F.lit(n).alias("section_id"), F.lit(o).alias("section_ordinal"), a.cast("int").alias("start_page"), b.cast("int").alias("end_page"))
    return pages, mk(last, "opening", 1, F.lit(1), F.lit(2)).unionByName(mk(last.where("m > 2"), "body", 2, F.lit(2), F.col("m") - 1))


@query(
    "jn4_page_sections",
    _SECTIONS + "SELECT conv_id, page, coalesce(arg_max(section_id, ordinal), 'unsectioned') AS section_id FROM (SELECT p.conv_id, p.page, s.section_id, s.ordinal FROM p LEFT JOIN s ON s.conv_id = p.conv_id AND p.page BETWEEN s.a AND s.b) GROUP BY 1, 2",
)
def _(t):
    pages, sections = _sections(t)
    return J.page_sections(pages.select("conv_id", "page").distinct(), sections, ["conv_id"])


@query(
    "jn11_section_text",
    _SECTIONS + ", x AS (SELECT p.conv_id, s.section_id, string_agg(p.text, chr(10) ORDER BY p.page, p.text) AS text FROM p JOIN s ON s.conv_id = p.conv_id AND p.page BETWEEN s.a AND s.b GROUP BY 1, 2) SELECT conv_id, section_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS text FROM x",
)
def _(t):
    pages, sections = _sections(t)
    return J.section_text(pages.select("conv_id", "page", "text"), sections, ["conv_id"], 300)


@query(
    "jn7_section_pairs",
    _SECTIONS + "SELECT a.conv_id, a.section_id AS source, b.section_id AS target FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.section_id <> b.section_id",
)
def _(t):
    _, s = _sections(t)
    b = s.select("conv_id", F.col("section_id").alias("target"))
    return s.select("conv_id", F.col("section_id").alias("source")).join(b, "conv_id").where("source <> target")


@query(
    "jn8_presence_gate",
    "WITH typed AS (SELECT DISTINCT p_type FROM part WHERE p_size > 40) SELECT p_partkey FROM part WHERE p_type IN (SELECT p_type FROM typed) UNION ALL SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM typed) AND p_size <= 40",
)
def _(t):
    typed = t.part.where("p_size > 40").select("p_type").distinct()
    bare = t.part.where("p_size <= 40").join(typed.agg(F.count("*").alias("n")).where("n = 0"), how="cross")
    return t.part.join(typed, "p_type", "left_semi").select("p_partkey").unionByName(bare.select("p_partkey"))


def _snapshots(t):
    old = t.customer.where("c_custkey % 5 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_mktsegment")).alias("value"), ((F.col("c_custkey") % 10) / 10.0).alias("confidence"))
    new = t.customer.where("c_custkey % 3 <> 0").select("c_custkey", F.lower("c_mktsegment").alias("value"), ((F.col("c_custkey") % 9) / 9.0).alias("confidence"))
    return old, new


_SNAP = """WITH o AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS value, (c_custkey % 10) / 10.0 AS confidence FROM customer WHERE c_custkey % 5 <> 0),
n AS (SELECT c_custkey, lower(c_mktsegment) AS value, CAST(c_custkey % 9 AS DOUBLE) / 9.0 AS confidence FROM customer WHERE c_custkey % 3 <> 0)
"""


@query(
    "jn12_upsert",
    _SNAP + """SELECT c_custkey, CASE WHEN action = 'kept' THEN ov ELSE nv END AS value, action FROM (SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, o.value AS ov, n.value AS nv,
CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'kept' WHEN coalesce(trim(o.value), '') = '' THEN 'replaced' WHEN n.confidence > CAST(o.confidence AS DOUBLE) + 0.1 THEN 'replaced' ELSE 'kept' END AS action FROM o FULL JOIN n ON o.c_custkey = n.c_custkey)""",
)
def _(t):
    return J.upsert(*_snapshots(t), "c_custkey").select("c_custkey", "value", "action")


@query(
    "jn13_shadow_delta",
    _SNAP + "SELECT count(*) FILTER (WHERE o.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL) AS both, count(*) FILTER (WHERE o.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL AND o.value IS DISTINCT FROM n.value) AS changed, count(*) FILTER (WHERE o.c_custkey IS NULL) AS gained, count(*) FILTER (WHERE n.c_custkey IS NULL) AS lost FROM o FULL JOIN n ON o.c_custkey = n.c_custkey",
)
def _(t):
    return J.shadow_delta(*_snapshots(t), "c_custkey")


@query(
    "jn14_changed_fields",
    "SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS old, lower(c_mktsegment) AS new FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR), CAST(c_nationkey + 1 AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0",
)
def _(t):
    after = t.customer.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")))
    after = after.withColumn("c_nationkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")))
    return J.changed_fields(t.customer, after, "c_custkey", ["c_mktsegment", "c_nationkey", "c_name"])


_LOG = "log AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_type IN ('click', 'view') THEN 'c_name' ELSE 'c_mktsegment' END AS field, event_type AS value FROM events)"


def _log(t):
    field = F.when(F.col("event_type").isin("click", "view"), "c_name").otherwise("c_mktsegment")
    return t.events.select(F.col("user_id").alias("c_custkey"), F.col("event_id").alias("seq"), field.alias("field"), F.col("event_type").alias("value"))


@query(
    "jn15_overlay",
    f"WITH {_LOG}, l AS (SELECT key, field, arg_max(value, seq) AS value FROM log GROUP BY 1, 2) SELECT c_custkey, coalesce(a.value, c_name) AS c_name, coalesce(b.value, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN l a ON a.key = c_custkey AND a.field = 'c_name' LEFT JOIN l b ON b.key = c_custkey AND b.field = 'c_mktsegment'",
)
def _(t):
    return J.overlay(t.customer.select("c_custkey", "c_name", "c_mktsegment"), _log(t), "c_custkey", ["c_name", "c_mktsegment"])


@query("jn15_orphans", f"WITH {_LOG} SELECT key AS c_custkey, seq, field, value FROM log WHERE key NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t):
    return J.orphans(t.customer.where("c_acctbal > 0"), _log(t), "c_custkey")


@query(
    "jn19_pages_of_findings",
    "SELECT page, list_sort(list(o_orderkey)) AS findings FROM (SELECT DISTINCT l_linenumber AS page, o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey ) GROUP BY 1",
)
def _(t):
    pages = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_linenumber").alias("pages"))
    f = t.orders.join(pages, "o_orderkey").select("o_orderkey", F.explode("pages").alias("page"))
    return f.groupBy("page").agg(F.array_sort(F.collect_list("o_orderkey")).alias("findings"))


@query(
    "jn21_points_in_boxes",
    "SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity BETWEEN p_size - 5 AND p_size + 5 AND l_discount BETWEEN 0.02 AND 0.06",
)
def _(t):
    pts = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    boxes = t.part.select("p_partkey", (F.col("p_size") - 5).alias("x1"), (F.col("p_size") + 5).alias("x2"), F.lit(0.02).alias("y1"), F.lit(0.06).alias("y2"))
    return J.inside(pts, boxes, ["p_partkey"], 10.0, 0.04).select("l_orderkey", "l_linenumber", "p_partkey")


@query(
    "jn23_supersede",
    "WITH n AS (SELECT o_custkey AS rule_id, o_orderpriority AS evidence, min(o_orderkey) AS f FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2) SELECT o_orderkey AS finding_id, n.f AS superseded_by FROM orders LEFT JOIN n ON n.rule_id = o_custkey AND n.evidence = o_orderpriority WHERE o_orderkey % 2 = 0",
)
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("rule_id"), F.col("o_orderpriority").alias("evidence"), F.col("o_orderkey").alias("finding_id"))
    return R.supersede(o.where("finding_id % 2 = 0"), o.where("finding_id % 2 = 1")).select("finding_id", "superseded_by")


@query(
    "jn24_edited_pages",
    "SELECT conv_id, string_agg(CASE WHEN role = 'user' AND turn % 2 = 0 THEN lower(text) ELSE text END, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY 1",
)
def _(t):
    text = F.when((F.col("role") == "user") & (F.col("turn") % 2 == 0), F.lower("text")).otherwise(F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("o"), text.alias("x"))))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["x"]), "\n").alias("text"))


@query(
    "rul1_same_page",
    "SELECT 'orders' AS rule_id, o_orderkey, 'open' AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IS NOT NULL)",
)
def _(t):
    fields = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("value"))
    return R.same_page(t.orders, fields, ["o_orderkey"], "orders").select("rule_id", "o_orderkey", "status")


for _agg in ("sum", "count", "min", "max", "avg"):

    @query(
        f"rul3_page_aggregate_{_agg}",
        f"WITH a AS (SELECT l_orderkey, CAST({_agg}(l_quantity) AS DOUBLE) AS actual FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN o_totalprice IS NULL THEN 'unevaluated' WHEN greatest(abs(actual), abs(o_totalprice / 2000)) = 0 THEN 'indeterminate' WHEN abs(actual - o_totalprice / 2000) <= greatest(abs(actual), abs(o_totalprice / 2000)) * 0.3 THEN 'pass' ELSE 'open' END AS status FROM a LEFT JOIN orders ON o_orderkey = l_orderkey",
    )
    def _(t, kind=_agg):
        values = t.lineitem.select("l_orderkey", F.col("l_quantity").cast("string").alias("value"))
        expected = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 2000).alias("expected"))
        return R.page_aggregate(values, expected, ["l_orderkey"], kind, "percent", 30).select("l_orderkey", "status")


_LINE_STATUS = "CASE WHEN l_returnflag = 'R' THEN 'open' WHEN l_returnflag = 'A' AND l_quantity > 40 THEN 'indeterminate' WHEN l_quantity < 5 THEN 'unevaluated' ELSE 'pass' END"
_ROLL = "CASE WHEN bool_or(s = 'open') THEN 'open' WHEN bool_or(s = 'indeterminate') THEN 'indeterminate' WHEN bool_or(s = 'unevaluated') AND NOT bool_or(s = 'pass') THEN 'unevaluated' ELSE 'pass' END"


def line_findings(t):
    status = F.when(F.col("l_returnflag") == "R", "open").when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 40), "indeterminate").when(F.col("l_quantity") < 5, "unevaluated").otherwise("pass")
    severity = F.when(F.col("l_tax") > 0.07, "critical").when(F.col("l_tax") > 0.05, "major").when(F.col("l_tax") > 0.02, "minor").otherwise("observation")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", status.alias("status"), severity.alias("severity"))


@query(
    "rul4_synthesis",
    f"SELECT l_orderkey, {_ROLL} AS status, ['observation', 'info', 'minor', 'major', 'critical'][greatest(max(v), 2) + 1] AS severity, count(*) AS parts FROM (SELECT l_orderkey, {_LINE_STATUS} AS s, CASE WHEN l_tax > 0.07 THEN 4 WHEN l_tax > 0.05 THEN 3 WHEN l_tax > 0.02 THEN 2 ELSE 0 END AS v FROM lineitem) GROUP BY 1",
)
def _(t):
    return R.synthesise(line_findings(t), ["l_orderkey"], "minor")


@query("agg2_roll_up_by_supplier", f"SELECT l_suppkey, {_ROLL} AS status FROM (SELECT l_suppkey, {_LINE_STATUS} AS s FROM lineitem) GROUP BY 1")
def _(t):
    return line_findings(t).groupBy("l_suppkey").agg(R.roll_up().alias("status"))


@query("rul5_fallbacks", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'unevaluated' WHEN l_linenumber % 3 = 1 THEN 'indeterminate' ELSE 'pass' END AS status FROM lineitem")
def _(t):
    name = F.when(F.col("l_linenumber") % 3 == 0, "flag_as_unevaluated").when(F.col("l_linenumber") % 3 == 1, "flag_as_indeterminate").otherwise("treat_as_pass")
    status = F.coalesce(*[F.when(name == k, v) for k, v in J.FALLBACK.items()])
    return t.lineitem.select("l_orderkey", "l_linenumber", status.alias("status"))


@query(
    "rul8_selective_rerun",
    "SELECT 'r' || p_partkey AS rule_id, 'leaf' AS why FROM part WHERE p_brand = 'Brand#11' UNION ALL SELECT DISTINCT 's' || (p_partkey // 10), 'synthesis' FROM part WHERE p_brand = 'Brand#11'",
)
def _(t):
    none = F.array().cast("array<string>")
    leaf = t.part.select(F.concat(F.lit("r"), "p_partkey").alias("rule_id"), F.lit("leaf").alias("scope"), F.array("p_brand").alias("fields"), none.alias("parts"), F.floor(F.col("p_partkey") / 10).alias("g"))
    syn = leaf.groupBy("g").agg(F.collect_list("rule_id").alias("parts")).select(F.concat(F.lit("s"), "g").alias("rule_id"), F.lit("synthesis").alias("scope"), none.alias("fields"), "parts")
    return R.affected(leaf.drop("g").unionByName(syn), "Brand#11", [])


@query(
    "rul9_field_overlay",
    "WITH c AS (SELECT o_orderkey AS k, 'N' AS field, 'corrected' AS v FROM orders WHERE o_orderkey % 4 = 0), f AS (SELECT l_orderkey AS k, l_returnflag AS field, CAST(l_partkey * 10 + l_linenumber AS INTEGER) AS o, l_linestatus AS v, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey * 10 + l_linenumber) AS n FROM lineitem) "
    "SELECT f.k, f.field, f.o AS field_ordinal, CASE WHEN f.n = 1 AND c.v IS NOT NULL THEN c.v ELSE f.v END AS value FROM f LEFT JOIN c ON c.k = f.k AND c.field = f.field "
    "UNION ALL SELECT c.k, c.field, CAST(coalesce((SELECT max(o) FROM f WHERE f.k = c.k), -1) + 1 AS INTEGER), c.v FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.k = c.k AND f.field = c.field)",
)
def _(t):
    fields = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("field"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).cast("int").alias("field_ordinal"), F.col("l_linestatus").alias("value"))
    fixes = t.orders.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("k"), F.lit("N").alias("field"), F.lit("corrected").alias("value"))
    return R.field_overlay(fields, fixes, ["k"])


for _mode, _pick in (("text_vision", "CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN ra > rb THEN a ELSE b END"), ("text_primary", "CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN rb > ra THEN b ELSE a END")):
    _rk = "CASE {0} WHEN 'not_applicable' THEN 0 WHEN 'compliant' THEN 1 WHEN 'error' THEN 2 WHEN 'uncertain' THEN 3 WHEN 'non_compliant' THEN 4 END"

    @query(
        f"rul19_merge_{_mode}",
        "WITH x AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'non_compliant' WHEN o_orderstatus = 'P' THEN 'uncertain' ELSE 'compliant' END AS a FROM orders WHERE o_orderkey % 3 <> 0), "
        "y AS (SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'non_compliant' WHEN o_totalprice > 150000 THEN 'error' WHEN o_totalprice > 50000 THEN 'compliant' ELSE 'not_applicable' END AS b FROM orders WHERE o_orderkey % 5 <> 0) "
        f"SELECT o_orderkey, {_pick} AS status FROM (SELECT coalesce(x.o_orderkey, y.o_orderkey) AS o_orderkey, a, b, {_rk.format('a')} AS ra, {_rk.format('b')} AS rb FROM x FULL JOIN y ON x.o_orderkey = y.o_orderkey)",
    )
    def _(t, mode=_mode):
        a = F.when(F.col("o_orderstatus") == "F", "non_compliant").when(F.col("o_orderstatus") == "P", "uncertain").otherwise("compliant")
        p = F.col("o_totalprice")
        b = F.when(p > 250000, "non_compliant").when(p > 150000, "error").when(p > 50000, "compliant").otherwise("not_applicable")
        x = t.orders.where("o_orderkey % 3 <> 0").select("o_orderkey", a.alias("a"))
        y = t.orders.where("o_orderkey % 5 <> 0").select("o_orderkey", b.alias("b"))
        f = S.worse if mode == "text_vision" else S.strictly_worse
        return x.join(y, "o_orderkey", "full_outer").select("o_orderkey", f(F.col("a"), F.col("b")).alias("status"))


# ---------------------------------------------------------------- classification
_CLS = """
WITH n AS (SELECT page_id, 'post' AS role, 1.0::DOUBLE AS s FROM pages WHERE url ILIKE '%blog.%' UNION SELECT page_id, 'mobile', 1.0 FROM pages WHERE url ILIKE '%//m.%'),
h AS (SELECT page_id, role, least(1.0, count(DISTINCT word) / 3.0)::DOUBLE AS s FROM pages JOIN (VALUES ('post', 'the '), ('post', 'and '), ('mobile', 'les '), ('mobile', 'der '), ('mobile', 'que ')) w(role, word) ON contains(lower(html), word) GROUP BY 1, 2)
"""


def _scores(t):
    globs = t.values([("post", "*blog.*"), ("mobile", "*//m.*")], "role string, glob string")
    words = t.values([("post", "the "), ("post", "and "), ("mobile", "les "), ("mobile", "der "), ("mobile", "que ")], "role string, word string")
    return C.filename_scores(t.pages, globs, "url", "page_id"), C.header_scores(t.pages, words, "html", "page_id")


@query("cls1_filename_scores", _CLS + "SELECT page_id, role, s AS score FROM n")
def _(t):
    return _scores(t)[0]


@query("cls2_header_scores", _CLS + "SELECT page_id, role, round(s, 6) AS score FROM h")
def _(t):
    return _scores(t)[1].withColumn("score", F.round("score", 6))


@query(
    "cls3_hybrid",
    _CLS + """, j AS (SELECT coalesce(n.page_id, h.page_id) AS page_id, coalesce(n.role, h.role) AS role, n.s AS a, h.s AS b FROM n FULL JOIN h ON n.page_id = h.page_id AND n.role = h.role),
k AS (SELECT *, (coalesce(a, 0) * 1.0 + coalesce(b, 0) * 0.8) / (CASE WHEN a IS NULL THEN 0 ELSE 1.0 END + CASE WHEN b IS NULL THEN 0 ELSE 0.8 END) AS score FROM j),
m AS (SELECT *, row_number() OVER w AS i, lead(score) OVER w AS nxt FROM k WINDOW w AS (PARTITION BY page_id ORDER BY score DESC, role))
SELECT page_id, CASE WHEN score >= 0.55 AND (nxt IS NULL OR score - nxt >= 0.15) THEN role END AS role, CASE WHEN coalesce(b, 0) > coalesce(a, 0) THEN 'header' ELSE 'filename' END AS source FROM m WHERE i = 1""",
)
def _(t):
    return C.hybrid(*_scores(t), "page_id").select("page_id", "role", "source")


@query(
    "cls5_cardinality",
    "WITH r(role, cardinality) AS (VALUES ('BUILDING', 'exactly_one'), ('MACHINERY', 'at_least_one'), ('ABSENT', 'at_least_one'), ('HOUSEHOLD', 'zero_or_more')), c AS (SELECT p.c_nationkey, r.role, r.cardinality, count(d.c_custkey) AS n FROM (SELECT DISTINCT c_nationkey FROM customer) p CROSS JOIN r LEFT JOIN customer d ON d.c_nationkey = p.c_nationkey AND d.c_mktsegment = r.role GROUP BY 1, 2, 3) "
    "SELECT c_nationkey, role, n, CASE WHEN n = 0 THEN 'MISSING' ELSE 'TOO_MANY' END AS issue FROM c WHERE (cardinality = 'exactly_one' AND n <> 1) OR (cardinality = 'at_least_one' AND n = 0)",
)
def _(t):
    roles = t.values([("BUILDING", "exactly_one"), ("MACHINERY", "at_least_one"), ("ABSENT", "at_least_one"), ("HOUSEHOLD", "zero_or_more")], "role string, cardinality string")
    return C.cardinality(roles, t.customer.select("c_nationkey", F.col("c_mktsegment").alias("role")), "c_nationkey")


@query(
    "cls6_package_status",
    "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F' AND o_totalprice > 300000) THEN 'REJECTED' WHEN bool_or(o_orderstatus = 'P') THEN 'NEEDS_REVIEW' ELSE 'CLASSIFIED' END AS status FROM orders GROUP BY 1",
)
def _(t):
    issue = F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000), "NO_FILES").when(F.col("o_orderstatus") == "P", "OTHER")
    return t.orders.groupBy("o_custkey").agg(C.package_status(F.collect_set(issue), ["NO_FILES"]).alias("status"))


@query(
    "cls7_page_type",
    "SELECT doc_id, CASE WHEN doc_id % 10 = 1 AND (contains(h, 'the ') OR contains(h, 'die ')) THEN 'cover' WHEN contains(text, ' | ') THEN 'form' WHEN contains(h, 'index') OR contains(h, 'is the') THEN 'index' WHEN contains(h, 'que ') THEN 'form' ELSE 'content' END AS kind FROM (SELECT doc_id, text, lower(substr(text, 1, 500)) AS h FROM documents)",
)
def _(t):
    kind = C.page_type(F.col("text"), F.col("doc_id") % 10, ["the ", "die "], ["index", "is the"], ["que "], F.contains("text", F.lit(" | ")))
    return t.documents.select("doc_id", kind.alias("kind"))


@query(
    "cls9_route_strategy",
    "WITH s AS (SELECT o_custkey, o_orderstatus AS family, sum(round(1 * greatest(0.1, CASE o_orderstatus WHEN 'F' THEN 0.5 WHEN 'O' THEN 0.4 ELSE 0.9 END), 3)) AS score FROM orders GROUP BY 1, 2) SELECT o_custkey, family FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY round(score, 6) DESC, list_position(['P', 'O', 'F'], family)) AS n FROM s) WHERE n = 1",
)
def _(t):
    conf = F.when(F.col("o_orderstatus") == "F", 0.5).when(F.col("o_orderstatus") == "O", 0.4).otherwise(0.9).cast("decimal(4,2)")
    pages = t.orders.select("o_custkey", F.col("o_orderstatus").alias("family"), F.lit(1).alias("pages"), conf.alias("confidence"))
    return C.route_strategy(pages, "o_custkey", ["P", "O", "F"]).select("o_custkey", "family")


@query(
    "cls10_resolve_family",
    "WITH k(family, o, word) AS (VALUES ('cold', 1, 'cold'), ('cold', 1, 'small cold rod'), ('long', 2, 'green ring'), ('long', 2, 'HOT ring bolt'), ('odd', 3, 'large red widget extra')), s AS (SELECT p_partkey, family, o, sum(CASE WHEN contains(p_name, lower(word)) THEN 1.0 WHEN len(list_intersect(string_split(lower(word), ' '), string_split(p_name, ' '))) >= greatest(1, len(string_split(word, ' ')) // 2) THEN 0.45 ELSE 0 END) AS score FROM part CROSS JOIN k GROUP BY 1, 2, 3) "
    "SELECT p_partkey, CASE WHEN score > 0 THEN family ELSE 'generic' END AS family, CASE WHEN score > 0 THEN round(least(1.0, score / 2.5), 3) ELSE 0.2 END::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, o) AS n FROM s) WHERE n = 1",
)
def _(t):
    words = t.values([("cold", 1, "cold"), ("cold", 1, "small cold rod"), ("long", 2, "green ring"), ("long", 2, "HOT ring bolt"), ("odd", 3, "large red widget extra")], "family string, ordinal int, word string")
    return C.resolve_family(t.part, words, "p_partkey", "p_name", "generic").drop("reason")


@query("cls12_canary", "SELECT c_custkey, (('0x' || substr(sha1(c_name), 1, 8))::BIGINT % 100) < 20 AS canary FROM customer")
def _(t):
    return t.customer.select("c_custkey", S.canary(F.col("c_name"), 20).alias("canary"))


@query(
    "cls13_rollback",
    "SELECT event_type, list_filter([CASE WHEN d < 0.0 THEN 'quality_regression' END, CASE WHEN v > 50 THEN 'latency_budget_exceeded' END, CASE WHEN e > 0.05 THEN 'cost_budget_exceeded' END], lambda x: x IS NOT NULL) AS reasons FROM (SELECT event_type, avg(CASE WHEN value > 95 THEN 1.0 ELSE 0 END) AS e, avg(value) AS v, avg(value) / 100 - 0.5 AS d FROM events GROUP BY 1)",
)
def _(t):
    a = t.events.groupBy("event_type").agg(F.avg(F.when(F.col("value") > 95, 1.0).otherwise(0.0)).alias("e"), F.avg("value").alias("v"))
    return a.select("event_type", S.rollback(F.col("v") / 100 - 0.5, F.col("v"), F.col("e"), (0.0, 50.0, 0.05)).alias("reasons"))


# ---------------------------------------------------------------- filters
@query("flt1_tag_filter", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), 'PROMO')")
def _(t):
    pages = t.part.select("p_partkey", F.split("p_type", " ").alias("tags"))
    return C.select_pages(pages, "by_tag", ["p_partkey"], tag="PROMO").select("p_partkey")


for _sel, _where in (("first_page", "n = 1"), ("last_page", "m = 1"), ("by_index", "turn IN (0, 3)")):

    @query(
        f"flt2_{_sel}",
        f"SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS m FROM (SELECT DISTINCT conv_id, turn FROM conversations)) WHERE {_where}",
    )
    def _(t, sel=_sel):
        pages = t.conversations.select("conv_id", "turn").distinct().select("*", F.col("turn").alias("page_ordinal"), F.col("turn").alias("page_index"))
        return C.select_pages(pages, sel, ["conv_id"], indices=[0, 3]).select("conv_id", "turn")


@query(
    "flt4_single_value",
    "SELECT o_custkey, arg_min(v, d) AS value FROM (SELECT o_custkey, o_orderpriority AS d, count(*) AS n, min(o_orderkey) AS v FROM orders GROUP BY 1, 2) WHERE n = 1 GROUP BY 1",
)
def _(t):
    fields = t.orders.select("o_custkey", F.col("o_orderpriority").alias("page_ordinal"), F.col("o_orderkey").alias("value"))
    return C.single_value(fields, ["o_custkey"])


@query("flt5_truthy", "SELECT doc_id, text IS NOT NULL AND trim(text) <> '' AS present FROM documents")
def _(t):
    return t.documents.select("doc_id", R.truthy(F.col("text")).alias("present"))


@query(
    "flt6_applicability",
    """WITH r(rule_id, cannot, dt, ex, kw) AS (VALUES ('r1', false, ['en', 'de'], []::VARCHAR[], ['the ']), ('r2', false, []::VARCHAR[], ['fr'], []::VARCHAR[]), ('r3', true, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[]))
SELECT doc_id, rule_id, CASE WHEN cannot THEN 'cannot_evaluate' WHEN len(dt) > 0 AND NOT list_contains(dt, lang) THEN 'document_type' WHEN len(ex) > 0 AND list_contains(ex, lang) THEN 'excluded_document_type' WHEN len(kw) > 0 AND len(list_filter(kw, lambda k: contains(lower(text), k))) = 0 THEN 'keywords' END AS reason FROM documents CROSS JOIN r""",
)
def _(t):
    rules = t.values([("r1", False, ["en", "de"], [], ["the "]), ("r2", False, [], ["fr"], []), ("r3", True, [], [], [])], "rule_id string, cannot boolean, dt array<string>, ex array<string>, kw array<string>")
    none = F.array().cast("array<string>")
    j = t.documents.select("doc_id", "lang", "text").join(F.broadcast(rules), how="cross")
    rule = {"cannot_evaluate": F.col("cannot"), "document_types": F.col("dt"), "excluded_types": F.col("ex"), "section_types": none, "page_types": none, "keywords": F.col("kw")}
    page = {"document_type": F.col("lang"), "section_type": F.lit(None).cast("string"), "page_type": F.lit("content"), "text": F.col("text")}
    return j.select("doc_id", "rule_id", C.skip_reason(rule, page).alias("reason"))


@query(
    "flt8_channels",
    "SELECT event_id, unnest(CASE event_type WHEN 'view' THEN ['vision'] WHEN 'click' THEN ['text', 'vision'] ELSE ['text'] END) AS channel FROM events",
)
def _(t):
    strategy = F.when(F.col("event_type") == "view", "vision").when(F.col("event_type") == "click", "text_primary").otherwise("text")
    return t.events.select("event_id", F.explode(C.channels(strategy, True)).alias("channel"))


@query(
    "flt13_first_labelled",
    "SELECT user_id, arg_min(event_id, event_id) FILTER (WHERE event_type = 'purchase') AS v, 'buy' AS field FROM events WHERE event_type = 'purchase' GROUP BY 1 UNION ALL SELECT user_id, min(event_id), 'look' FROM events WHERE event_type IN ('view', 'click') GROUP BY 1",
)
def _(t):
    labels = t.values([("Purchase ", "buy"), ("VIEW", "look"), ("click", "look")], "label string, field string")
    kv = t.events.select("user_id", F.col("event_id").alias("page"), F.lit(0).alias("ordinal"), F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("value"))
    return C.first_labelled(kv, labels, "user_id").select("user_id", F.col("value").cast("long").alias("v"), "field")
