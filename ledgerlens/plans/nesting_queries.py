"""Queries of nested sections, signatures, splices, requirements, paused runs, topics and batch requests, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..durable import fresh
from ..functions import edits as E
from ..functions import signatures as G
from ..operators import requirements as R
from ..operators import sections as S
from ..operators import segmentation as M
from ..operators import subsections as U
from ..sources import batches as B
from ..streaming import legibility as L
from ..streaming.topics import Topics
from .catalog import query
from .sequence_queries import _P, _pages

# ---------------------------------------------------------------- DSL-17
_SPEC = {
    "spec_version": "1",
    "sections": [
        {"section_id": "cover_page", "display_name": "Cover", "regex": [r"^\s*the "]},
        {"section_id": "of_matter", "display_name": "Of", "regex": ["^of "]},
        {"section_id": "and_more", "display_name": "And more", "regex": ["^and ", "^to "]},
    ],
}


@query(
    "dsl17_sub_sections",
    _P
    + """, z AS (SELECT conv_id AS d, max(page) AS n FROM p GROUP BY 1),
s AS (
  SELECT d, 0 AS o, CASE d % 3 WHEN 0 THEN 'rec' WHEN 1 THEN 'bpcr_main' ELSE 'talk' END AS sid, 'Main' AS title, CASE d % 3 WHEN 0 THEN 'Batch_Record_2' ELSE 'talk' END AS kind, 1 AS a, (n + 1) // 2 AS b FROM z
  UNION ALL SELECT d, 1, 'bpcr_rest', 'Rest', CASE d % 2 WHEN 0 THEN 'talk' ELSE 'and_more' END, (n + 1) // 2 + 1, n FROM z WHERE n > 1),
m AS (SELECT *, kind = 'Batch_Record_2' OR (kind <> 'and_more' AND contains(sid, 'bpcr')) AS drill FROM s),
g AS (SELECT m.d, m.o, p.page - m.a + 1 AS page, m.a - 1 AS shift, m.b - m.a + 1 AS n, p.text FROM m JOIN p ON p.conv_id = m.d AND p.page BETWEEN m.a AND m.b WHERE drill),
ls AS (SELECT d, o, page, list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM g),
li AS (SELECT d, o, page, len(l) AS k, unnest(range(len(l))) AS i, lower(unnest(l)) AS t FROM ls),
h AS (SELECT d, o, page, i / k <= 0.2 AS top, i, unnest([CASE WHEN page = 1 AND contains(t, 'the ') THEN 0 END, CASE WHEN starts_with(t, 'of ') THEN 1 END, CASE WHEN starts_with(t, 'and ') OR starts_with(t, 'to ') THEN 2 END]) AS r FROM li),
c AS (SELECT d, o, page, r, max(CASE WHEN top THEN 1.0 ELSE 0.7 END) AS conf FROM h WHERE r IS NOT NULL GROUP BY ALL),
op AS (SELECT d, o, page, list(r ORDER BY conf DESC, r) AS rs, row_number() OVER (PARTITION BY d, o ORDER BY page) AS k FROM c GROUP BY d, o, page),
pick AS (
  SELECT * FROM (WITH RECURSIVE w AS (
    SELECT d, o, k, page, rs[1] AS r FROM op WHERE k = 1
    UNION ALL SELECT op.d, op.o, op.k, op.page, CASE WHEN op.rs[1] = w.r THEN coalesce(list_filter(op.rs, lambda x: x <> w.r)[1], op.rs[1]) ELSE op.rs[1] END FROM w JOIN op ON op.d = w.d AND op.o = w.o AND op.k = w.k + 1)
  SELECT * FROM w)),
cf AS (SELECT g.d, g.o, g.page, g.shift, coalesce(last_value(r IGNORE NULLS) OVER (PARTITION BY g.d, g.o ORDER BY g.page), -1) AS r FROM g LEFT JOIN pick ON pick.d = g.d AND pick.o = g.o AND pick.page = g.page WHERE EXISTS (SELECT 1 FROM pick x WHERE x.d = g.d AND x.o = g.o)),
ch AS (SELECT *, CASE WHEN r = lag(r) OVER (PARTITION BY d, o ORDER BY page) THEN 0 ELSE 1 END AS new FROM cf),
sp AS (SELECT d, o, n, min(r) AS r, min(page) + min(shift) AS a, max(page) + min(shift) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY d, o ORDER BY page) AS n FROM ch) GROUP BY d, o, n),
found AS (
  SELECT d, o, 0 AS by_, n, CASE r WHEN -1 THEN 'unsectioned' WHEN 0 THEN 'cover_page' WHEN 1 THEN 'of_matter' ELSE 'and_more' END AS kind, CASE r WHEN 0 THEN 'Cover' WHEN 1 THEN 'Of' WHEN 2 THEN 'And more' END AS title, a, b FROM sp
  UNION ALL SELECT m.d, m.o, 1, p.page, CASE WHEN p.page % 2 = 0 THEN 'of_matter' ELSE 'reply' END, 'Said', least(greatest(p.page + (m.d % 2) * 50, m.a), m.b), least(greatest(p.page + (m.d % 2) * 50, m.a), m.b) FROM m JOIN p ON p.conv_id = m.d WHERE drill AND p.role = 'assistant'),
first AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY d, o, kind ORDER BY by_, n, a) = 1),
sub AS (SELECT *, row_number() OVER (PARTITION BY d, o ORDER BY by_, n, a, kind) AS nth FROM first)
SELECT m.d AS doc_id, CAST(m.o AS INTEGER) AS ordinal, CASE WHEN sub.d IS NULL THEN sid ELSE sid || '__' || sub.kind END AS section_id, coalesce(sub.title, m.title) AS name, coalesce(sub.kind, m.kind) AS section_type,
  CASE WHEN sub.d IS NOT NULL THEN 'batch_record' END AS document_type, CAST(coalesce(sub.a, m.a) AS INTEGER) AS start_page, CAST(coalesce(sub.b, m.b) AS INTEGER) AS end_page, CASE WHEN sub.d IS NOT NULL THEN sid END AS parent, CAST(nth AS INTEGER) AS nth
FROM m LEFT JOIN sub ON sub.d = m.d AND sub.o = m.o""",
)
def _(t):
    p = _pages(t).select(F.col("conv_id").alias("doc_id"), "page", "role", "text")
    n = p.groupBy("doc_id").agg(F.max("page").alias("n"))
    half = F.floor((F.col("n") + 1) / 2).cast("int")
    kind = F.col("doc_id") % 3
    first = n.select(
        "doc_id", F.lit(0).alias("ordinal"), F.when(kind == 0, "rec").when(kind == 1, "bpcr_main").otherwise("talk").alias("section_id"), F.lit("Main").alias("name"),
        F.when(kind == 0, "Batch_Record_2").otherwise("talk").alias("section_type"), F.lit(None).cast("string").alias("document_type"), F.lit(1).alias("start_page"), half.alias("end_page"),
    )
    second = n.where("n > 1").select(
        "doc_id", F.lit(1).alias("ordinal"), F.lit("bpcr_rest").alias("section_id"), F.lit("Rest").alias("name"), F.when(F.col("doc_id") % 2 == 0, "talk").otherwise("and_more").alias("section_type"),
        F.lit(None).cast("string").alias("document_type"), (half + 1).alias("start_page"), F.col("n").alias("end_page"),
    )
    sections = first.unionByName(second)
    said = p.where("role = 'assistant'").select("doc_id", F.col("page").alias("nth"), F.when(F.col("page") % 2 == 0, "of_matter").otherwise("reply").alias("section_type"), F.lit("Said").alias("name"), (F.col("page") + (F.col("doc_id") % 2) * 50).cast("int").alias("page"))
    proposed = sections.select("doc_id", "ordinal").join(said, "doc_id")
    return U.with_sub_sections(sections, p, proposed, S.sections_of(_SPEC), ["batch_record", "bpcr"], "batch_record")


@query(
    "dsl17_containment_tree",
    "WITH r AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS o, CAST(l_quantity AS INTEGER) AS a, CAST(l_quantity AS INTEGER) + CAST(l_partkey % 25 AS INTEGER) AS b FROM lineitem), u AS (SELECT d, o, max(a) AS a, max(b) AS b FROM r GROUP BY 1, 2), "
    "h AS (SELECT y.d, y.o, x.o AS p, x.a AS pa, x.b AS pb FROM u y JOIN u x ON x.d = y.d AND x.a <= y.a AND x.b >= y.b AND (x.a, -x.b, x.o) < (y.a, -y.b, y.o)), "
    "par AS (SELECT d, o, p FROM h QUALIFY row_number() OVER (PARTITION BY d, o ORDER BY pa DESC, pb, p DESC) = 1), "
    "tree AS (SELECT * FROM (WITH RECURSIVE w AS (SELECT u.d, u.o, CAST(NULL AS INTEGER) AS parent, 0 AS depth, u.o AS root FROM u WHERE NOT EXISTS (SELECT 1 FROM par WHERE par.d = u.d AND par.o = u.o) UNION ALL SELECT par.d, par.o, par.p, w.depth + 1, w.root FROM w JOIN par ON par.d = w.d AND par.p = w.o) SELECT * FROM w)) "
    "SELECT u.d AS doc_id, u.o AS ordinal, u.a AS start_page, u.b AS end_page, parent, depth, root FROM u JOIN tree ON tree.d = u.d AND tree.o = u.o",
)
def _(t):
    start = F.col("l_quantity").cast("int")
    r = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ordinal")).agg(F.max(start).alias("start_page"), F.max(start + (F.col("l_partkey") % 25).cast("int")).alias("end_page"))
    return U.containment_tree(r, ["doc_id"])


# ---------------------------------------------------------------- FN-36, FN-43
_CELL = "CASE l_returnflag WHEN 'R' THEN ' <i>RK</i> 01/02/25 ' WHEN 'A' THEN ' 03/10/2025 ' ELSE ' OK ' END"


@query(
    "fn36_signatures",
    f"WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_CELL} AS was, CASE l_returnflag WHEN 'R' THEN ' [Signature] <i>RK</i> 01/02/25 ' WHEN 'A' THEN ' [Signature] 03/10/2025 ' ELSE ' OK ' END AS new FROM lineitem) "
    "SELECT l_orderkey AS doc_id, 'x' || chr(10) || '| Step | Done by |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || l_linenumber || ' |' || new || '|', chr(10) ORDER BY l_linenumber, was) || chr(10) || 'y' AS enriched, "
    "CAST(count(*) FILTER (WHERE contains(was, 'RK')) AS INTEGER) AS handwritten, CAST(count(*) FILTER (WHERE was = ' 03/10/2025 ') AS INTEGER) AS dates, CASE l_orderkey % 3 WHEN 0 THEN 'L2' WHEN 1 THEN 'L3' ELSE 'L4' END AS layer, CAST(count(*) FILTER (WHERE was = ' OK ') AS INTEGER) AS verdicts FROM c GROUP BY l_orderkey",
)
def _(t):
    cell = F.expr(_CELL)
    row = F.struct("l_linenumber", cell.alias("cell"))
    lines = F.transform(F.array_sort(F.collect_list(row)), lambda r: F.concat(F.lit("| "), r["l_linenumber"].cast("string"), F.lit(" |"), r["cell"], F.lit("|")))
    md = F.concat(F.lit("x\n| Step | Done by |\n|---|---|\n"), F.array_join(lines, "\n"), F.lit("\ny"))
    doc = F.col("l_orderkey")
    pages = t.lineitem.groupBy(doc.alias("doc_id")).agg(md.alias("text")).withColumns({"has_signature": F.col("doc_id") % 3 == 0, "has_handwriting": F.col("doc_id") % 3 == 1})
    layer = F.when(F.col("has_signature"), "L2").when(F.col("has_handwriting"), "L3").otherwise("L4")
    n = F.col("counts")
    return G.enriched(pages, ["done by"]).withColumn("layer", layer).select("doc_id", "enriched", n["L_HWTEXT"].alias("handwritten"), F.try_element_at(n, "layer").alias("dates"), "layer", n["verdict"].alias("verdicts"))


@query(
    "fn43_page_texts",
    "WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0), p AS (SELECT doc_id, text, n, CAST(unnest(range(0, n, 1000)) // 1000 + 1 AS INTEGER) AS page FROM d) "
    "SELECT doc_id, page, trim(CASE WHEN n < 1100 OR page > 2 THEN substr(text, (page - 1) * 1000 + 1, 1000) WHEN page = 1 THEN substr(text, 1, 900) || '<t1>' ELSE '<t2>' || substr(text, 1101, 900) END, ' ') AS text FROM p",
)
def _(t):
    d = t.documents.where(F.length("text") > 0).withColumn("n", F.length("text"))
    starts = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(1000))).alias("start"))
    pages = starts.select("doc_id", (F.col("start") / 1000 + 1).cast("int").alias("page"), "start", F.least(F.col("start") + 1000, F.col("n")).alias("end"))
    tables = d.where("n >= 1100").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("page"), F.lit(900).alias("start"), F.lit(1100).alias("end"))
    return E.page_texts(d.select("doc_id", F.col("text").alias("content")), pages, tables.withColumn("html", F.concat(F.lit("<t"), F.col("page").cast("string"), F.lit(">"))))


# ---------------------------------------------------------------- JN-7, JN-8
_REGISTRY = [R.Requirement("returned_vs_accepted", ("r",), ("A",), "returned"), R.Requirement("any_vs_new", ("R", "a"), ("N", "X"), "new")]


def _sections(t):
    l = t.lineitem
    kind = F.when(l["l_linenumber"] % 4 != 0, F.when(l["l_linestatus"] == "O", "open doc").otherwise("filled_doc"))
    return l.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("section_id")).agg(F.min("l_returnflag").alias("section_type"), F.min(kind).alias("document_type"))


_SECTIONS = "WITH s AS (SELECT l_orderkey AS d, CAST(l_linenumber AS VARCHAR) AS i, lower(min(l_returnflag)) AS k, coalesce(min(CASE WHEN l_linenumber % 4 <> 0 THEN CASE WHEN l_linestatus = 'O' THEN 'open_doc' ELSE 'filled_doc' END END), '') AS doc FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@query(
    "jn7_requirement_division",
    _SECTIONS
    + """, w(q, side, k) AS (VALUES ('returned_vs_accepted', 'source', 'r'), ('returned_vs_accepted', 'target', 'a'), ('any_vs_new', 'source', 'r'), ('any_vs_new', 'source', 'a'), ('any_vs_new', 'target', 'n'), ('any_vs_new', 'target', 'x')),
q AS (SELECT DISTINCT d, q FROM s, w),
f AS (SELECT q.d, q.q, count(DISTINCT i) FILTER (WHERE side = 'source') AS a, count(DISTINCT i) FILTER (WHERE side = 'target') AS b, count(DISTINCT w.side || ':' || w.k) AS n FROM q LEFT JOIN (s JOIN w ON w.k = s.k) ON s.d = q.d AND w.q = q.q GROUP BY 1, 2),
g AS (SELECT q.d, q.q, string_agg(side || ':' || w.k, ', ' ORDER BY side, w.k) AS gone FROM q JOIN w ON w.q = q.q WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.d = q.d AND s.k = w.k) GROUP BY 1, 2)
SELECT f.d AS doc_id, f.q AS requirement_id, CAST(a AS INTEGER) AS sources, CAST(b AS INTEGER) AS targets, coalesce(gone, '') AS missing, a > 0 AND b > 0 AS applicable, gone IS NULL AS complete, CAST(a * b AS BIGINT) AS pairs FROM f LEFT JOIN g ON g.d = f.d AND g.q = f.q""",
)
def _(t):
    s = _sections(t)
    asked = s.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.lit(r.id) for r in _REGISTRY])).alias("requirement_id"))
    r = R.resolve_named(s, asked, _REGISTRY)
    return r.select("doc_id", "requirement_id", F.size("source_ids").alias("sources"), F.size("target_ids").alias("targets"), F.array_join("missing", ", ").alias("missing"), "applicable", "complete", "pairs")


@query(
    "jn8_inline_presence",
    _SECTIONS
    + """, w(k, doc) AS (VALUES ('r', 'open_doc'), ('', 'filled_doc'), ('n', ''), ('a', 'never'), ('', '')), q AS (SELECT * FROM (SELECT DISTINCT d FROM s), w)
SELECT q.d AS doc_id, CASE WHEN q.doc = '' THEN '*' ELSE q.doc END || '.' || CASE WHEN q.k = '' THEN '*' ELSE q.k END AS name, CAST(count(DISTINCT s.i) AS INTEGER) AS n
FROM q LEFT JOIN s ON s.d = q.d AND CASE WHEN q.k = '' AND q.doc = '' THEN false WHEN q.doc = '' THEN s.k = q.k WHEN NOT EXISTS (SELECT 1 FROM s x WHERE x.d = q.d AND x.doc = q.doc) THEN s.doc = '' AND s.k = q.k ELSE s.doc = q.doc AND (q.k = '' OR s.k = q.k) END GROUP BY ALL""",
)
def _(t):
    s = _sections(t)
    wants = F.array(*[F.struct(F.lit(k).alias("section_type"), F.lit(d).alias("in_document_type")) for k, d in (("R", "Open doc"), ("", "filled-doc"), ("N", ""), ("A", "never"), ("", ""))])
    docs = t.lineitem.select(F.col("l_orderkey").alias("doc_id")).distinct()
    r = R.resolve_inline(s, docs.select("doc_id", F.inline(wants)))
    return r.select("doc_id", "name", F.size("section_ids").alias("n"))


# ---------------------------------------------------------------- STR-6, STR-1, batches
@query(
    "str6_paused_runs",
    """WITH e AS (
  SELECT o_orderkey AS run, 0 AS seq, 'start' AS kind, o_orderstatus AS snap, o_orderstatus <> 'P' AS needs, CAST(NULL AS VARCHAR) AS act FROM orders
  UNION ALL SELECT l_orderkey, l_linenumber, CASE WHEN min(l_linestatus) = 'F' AND l_linenumber % 3 = 1 THEN 'package' ELSE 'decision' END, CASE WHEN l_linenumber % 2 = 0 THEN 'O' ELSE 'F' END, NULL, CASE min(l_returnflag) WHEN 'R' THEN 'proceed' WHEN 'A' THEN 'reupload' ELSE 'hold' END FROM lineitem GROUP BY l_orderkey, l_linenumber),
w AS (SELECT *, first_value(snap) OVER r AS seen, first_value(needs) OVER r AS wants, first_value(kind) OVER r = 'start' AS there, last_value(CASE WHEN kind <> 'decision' THEN snap END IGNORE NULLS) OVER r AS now FROM e WINDOW r AS (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT *, CASE WHEN kind = 'decision' THEN CASE WHEN act = 'hold' THEN 'unknown action' WHEN NOT there THEN 'run not found' WHEN NOT wants THEN 'not awaiting review' WHEN act = 'proceed' AND seen <> now THEN 'package changed since the pause' END END AS wrong FROM w),
g AS (SELECT *, count(*) FILTER (WHERE kind = 'decision' AND wrong IS NULL) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d),
x AS (SELECT *, CASE WHEN kind = 'decision' AND act <> 'hold' AND there AND before > 0 THEN 'not awaiting review' ELSE wrong END AS bad FROM g WHERE kind <> 'package')
SELECT CAST(run AS VARCHAR) AS run_id, CAST(seq AS BIGINT) AS seq, CASE WHEN kind = 'start' THEN CASE WHEN needs THEN 'awaiting_legibility_review' ELSE 'running' END WHEN bad IS NOT NULL THEN 'rejected' WHEN act = 'proceed' THEN 'running' ELSE 'failed' END AS status, CASE WHEN kind = 'decision' THEN bad END AS detail FROM x""",
)
def _(t):
    none = lambda kind: F.lit(None).cast(kind)
    run = F.col("o_orderkey").cast("string").alias("run_id")
    starts = t.orders.select(run, F.lit(0).cast("long").alias("seq"), F.lit("start").alias("kind"), F.col("o_orderstatus").alias("snapshot"), (F.col("o_orderstatus") != "P").alias("needs_review"), none("array<string>").alias("reasons"), none("string").alias("action"))
    l = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_linestatus").alias("s"), F.min("l_returnflag").alias("f"))
    n = F.col("l_linenumber")
    later = l.select(
        F.col("l_orderkey").cast("string").alias("run_id"), n.cast("long").alias("seq"), F.when((F.col("s") == "F") & (n % 3 == 1), "package").otherwise("decision").alias("kind"), F.when(n % 2 == 0, "O").otherwise("F").alias("snapshot"),
        none("boolean").alias("needs_review"), none("array<string>").alias("reasons"), F.when(F.col("f") == "R", "proceed").when(F.col("f") == "A", "reupload").otherwise("hold").alias("action"),
    )
    events = starts.unionByName(later).withColumns({"actor": none("string"), "note": none("string")})
    return L.replayed(events).select("run_id", "seq", "status", F.nullif("detail", F.lit("")).alias("detail"))


@query(
    "str1_topics",
    "WITH e AS (SELECT event_type AS topic, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id % 2, event_id) - 1 AS o, event_id % 2 AS b FROM events), f AS (SELECT topic, count(*) FILTER (WHERE b = 0) AS first, count(*) AS n FROM e GROUP BY 1) "
    'SELECT e.topic, CAST(o AS BIGINT) AS "offset", CAST(event_id AS VARCHAR) AS payload, CAST(greatest(n - first - 100, 0) AS BIGINT) AS lost FROM e JOIN f ON f.topic = e.topic WHERE o >= greatest(first, n - 100)',
)
def _(t):
    topics = Topics(t.spark, fresh(t.spark, "topics"))
    e = t.events.select(F.col("event_type").alias("topic"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("payload"))
    topics.publish(e.where("seq % 2 = 0"), 0)
    topics.commit("slow", topics.poll("slow"))
    topics.publish(e.where("seq % 2 = 1"), 1)
    topics.publish(e.where("seq % 2 = 1"), 1)
    return topics.poll("slow", bound=100)


@query(
    "batch_requests",
    "SELECT 'c' || conv_id AS custom_id, 'POST' AS method, 'judge' AS model, CAST(count(*) AS INTEGER) AS messages, max(text) AS last FROM conversations GROUP BY conv_id",
)
def _(t):
    said = F.struct("text", "role", "turn")
    messages = F.transform(F.array_sort(F.collect_list(said)), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    asked = t.conversations.groupBy(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("custom_id")).agg(messages.alias("messages"))
    path = fresh(t.spark, "batch-requests")
    B.write_requests(B.request_lines(asked, "judge"), path, 1000)
    x = F.from_json("line", "method string, body struct<model: string, messages: array<struct<role: string, content: string>>>")
    return B.read_requests(t.spark, path).select("custom_id", x["method"].alias("method"), x["body"]["model"].alias("model"), F.size(x["body"]["messages"]).alias("messages"), F.element_at(x["body"]["messages"], -1)["content"].alias("last"))


# ---------------------------------------------------------------- DSL-16, DSL-18
_PROFILES = M.Profiles((M.Profile("f", ("o",), (M.Expected("1_urgent", ("2_high",), True), M.Expected("5_low"))), M.Profile("p", (), (M.Expected("5_low", (), True),))))
_RAW = "r AS (SELECT o_custkey AS d, o_orderkey AS o, CAST(o_orderkey % 50 - 3 AS INTEGER) AS a, CAST(o_orderkey % 50 - 3 + o_orderkey % 9 AS INTEGER) AS b, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '1_urgent' WHEN o_orderpriority = '5-LOW' THEN '5_low' ELSE 'unknown' END AS k, lower(o_orderstatus) AS doc FROM orders)"


def _segmentations(t):
    a = (F.col("o_orderkey") % 50 - 3).cast("int")
    s = t.orders.select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("section_id"), F.col("o_orderpriority").alias("name"),
        F.col("o_orderpriority").alias("section_type"), F.lower("o_orderstatus").alias("document_type"), a.alias("start_page"), (a + F.col("o_orderkey") % 9).cast("int").alias("end_page"),
    )
    return s, t.orders.select(F.col("o_custkey").alias("doc_id"), F.lit(40).alias("total")).distinct()


@query(
    "dsl18_segmentation_issues",
    f"WITH {_RAW}"
    + """, e AS (SELECT DISTINCT o_custkey AS d, l_linenumber * 7 AS page FROM lineitem JOIN orders ON o_orderkey = l_orderkey), c AS (SELECT DISTINCT o_custkey AS d, unnest(range(1, 41)) AS page FROM orders),
m AS (SELECT d, page FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.d = c.d AND c.page BETWEEN r.a AND r.b)), g AS (SELECT d, min(page) AS a, max(page) AS b FROM (SELECT *, page - row_number() OVER (PARTITION BY d ORDER BY page) AS i FROM m) GROUP BY d, i),
x AS (
  SELECT r.d, 'overlap' AS kind, least(r.b, y.b) - greatest(r.a, y.a) + 1 AS n FROM r JOIN r y ON y.d = r.d AND (r.a, r.b, r.o) < (y.a, y.b, y.o) AND y.a <= r.b
  UNION ALL SELECT d, 'gap', b - a + 1 FROM g
  UNION ALL SELECT d, 'missing_required_section', NULL FROM (SELECT DISTINCT d, doc FROM r WHERE doc = 'f' OR doc = 'p') q WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.d = q.d AND r.doc = q.doc AND r.k = CASE q.doc WHEN 'f' THEN '1_urgent' ELSE '5_low' END)
  UNION ALL SELECT d, 'no_kv_evidence', b - a + 1 FROM r WHERE b - a >= 2 AND k <> 'unknown' AND EXISTS (SELECT 1 FROM e WHERE e.d = r.d) AND NOT EXISTS (SELECT 1 FROM e WHERE e.d = r.d AND e.page BETWEEN r.a AND r.b)
  UNION ALL SELECT d, 'type_mismatch', b - a + 1 FROM r WHERE doc = 'p' AND k = '1_urgent'
  UNION ALL SELECT d, 'unknown_section_type', NULL FROM r WHERE k = 'unknown')
SELECT d AS doc_id, kind, count(*) AS n, CAST(coalesce(sum(n), 0) AS BIGINT) AS pages FROM x GROUP BY 1, 2""",
)
def _(t):
    s, total = _segmentations(t)
    pages = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("doc_id"), (F.col("l_linenumber") * 7).alias("page"))
    found = M.issues(M.stamped(M.canonical(s, _PROFILES), _PROFILES, [], ""), _PROFILES, total, pages)
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("end_page") - F.col("start_page") + 1), F.lit(0)).alias("pages"))


@query(
    "dsl16_mended_segmentations",
    f"WITH {_RAW}"
    + """, c AS (SELECT d, o, greatest(a, 1) AS a, least(b, 40) AS b, k, doc FROM r WHERE greatest(a, 1) <= least(b, 40)), x AS (SELECT d, k, doc, greatest(a, coalesce(max(b) OVER (PARTITION BY d ORDER BY a, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, a)) AS a, b FROM c), y AS (SELECT * FROM x WHERE a <= b),
p AS (SELECT DISTINCT o_custkey AS d, CAST(unnest(range(1, 41)) AS INTEGER) AS page FROM orders), m AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.d = p.d AND p.page BETWEEN y.a AND y.b)), i AS (SELECT *, page - row_number() OVER (PARTITION BY d ORDER BY page) AS g FROM m)
SELECT d AS doc_id, a AS start_page, b AS end_page, k AS section_type, doc AS document_type FROM y UNION ALL SELECT d, min(page), max(page), 'unknown', '' FROM i GROUP BY d, g""",
)
def _(t):
    return M.mended(*_segmentations(t), _PROFILES, [], "").select("doc_id", "start_page", "end_page", "section_type", "document_type")
