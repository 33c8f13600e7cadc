"""Sections inside sections, held against a stack walk and a plain loop over random packets."""

import random

from ledgerlens.operators import sections as S
from ledgerlens.operators import subsections as U

SECTIONS = "doc_id string, ordinal int, section_id string, name string, section_type string, document_type string, start_page int, end_page int"
SPEC = S.sections_of(
    {
        "spec_version": "1",
        "sections": [
            {"section_id": "cover_page", "display_name": "Batch record"},
            {"section_id": "weighing", "display_name": "Weighing"},
            {"section_id": "milling", "display_name": "Milling step"},
        ],
    }
)
HINTS = ["batch_record", "bpcr"]


def stack_walk(ranges):
    """ordinal -> (parent, depth, root) of (ordinal, start, end)."""
    out, stack = {}, []
    for o, s, e in sorted((x for x in ranges if x[1] <= x[2]), key=lambda x: (x[1], -x[2], x[0])):
        while stack and stack[-1][1] < e:
            stack.pop()
        out[o] = (stack[-1][0] if stack else None, len(stack), stack[0][0] if stack else o)
        stack.append((o, e))
    return out


def test_containment_tree_equals_a_stack_walk(spark):
    rnd = random.Random(5)
    packets = {}
    for d in range(200):
        n, pages = rnd.randrange(0, 14), rnd.choice([3, 12, 40])
        packets[d] = []
        for o in range(n):
            a, b = rnd.randint(1, pages), rnd.randint(1, pages)
            packets[d].append((o, a, b) if rnd.random() < 0.15 else (o, min(a, b), max(a, b)))
    rows = [(d, *r) for d, rs in packets.items() for r in rs]
    got = {}
    for r in U.containment_tree(spark.createDataFrame(rows, "doc_id int, ordinal int, start_page int, end_page int"), ["doc_id"]).collect():
        got.setdefault(r["doc_id"], {})[r["ordinal"]] = (r["parent"], r["depth"], r["root"])
    assert got == {d: w for d, rs in packets.items() if (w := stack_walk(rs))}
    assert max(x[1] for w in got.values() for x in w.values()) >= 4


def plain(sections, pages, proposed):
    """The sub-sections of one packet by a loop: sections (tuples of SECTIONS without doc_id), pages {page: text}."""
    kinds = {s.id for s in SPEC} | {U.UNSECTIONED}
    out, bearers = [], {}

    def give(base, row):
        bearers[base] = bearers.get(base, 0) + 1
        return (f"{base}__{bearers[base]}" if row[-1] is not None and bearers[base] > 1 else base, *row)

    for ordinal, sid, name, kind, doc_type, a, b in sorted(sections):
        parent = any(h in (kind or "").lower() for h in HINTS) or kind not in kinds and any(h in sid.lower() for h in HINTS)
        plan = []
        if parent and a <= b:
            marks, prev = {}, None
            for p in range(a, b + 1):
                found = []
                lines = [x for x in (pages.get(p) or "").split("\n") if x.strip()]
                for rank, s in enumerate(SPEC):
                    for i, line in enumerate(lines):
                        if s.id == "cover_page" and p != a:
                            continue
                        if s.name.lower() in line.lower() if s.id == "cover_page" else line.lower().startswith(s.name.lower()):
                            c = 1.0 if i / len(lines) <= S.TOP_OF_PAGE else S.SURE_MID_PAGE
                            found.append((-c, rank, s.id))
                            break
                found.sort()
                if found:
                    best = found[0][2]
                    if best == prev:
                        best = next((x[2] for x in found[1:] if x[2] != prev and -x[0] >= 0.6), best)
                    marks[p] = prev = best
            if marks:
                now, seen = U.UNSECTIONED, []
                for p in range(a, b + 1):
                    now = marks.get(p, now)
                    if seen and seen[-1][0] == now:
                        seen[-1][2] = p
                    else:
                        seen.append([now, p, p])
                for kind_, s, e in seen:
                    if kind_ not in {x[0] for x in plan}:
                        plan.append((kind_, next((x.name for x in SPEC if x.id == kind_), name), s, e))
            for _, k, title, page in sorted(x[1:] for x in proposed if x[0] == ordinal):
                if k and k not in {x[0] for x in plan}:
                    p = min(max(a if page is None else page, a), b)
                    plan.append((k, title or name, p, p))
        if plan:
            out += [give(f"{sid}__{k}", (title, k, "record", s, e, sid, n + 1)) for n, (k, title, s, e) in enumerate(plan)]
        else:
            out.append(give(sid, (name, kind, doc_type, a, b, None, None)))
    return out


def random_packet(rnd):
    total = rnd.randint(1, 12)
    lines = ["Batch record of today", "Weighing", "weighing, continued", "Milling step 2", "no heading", "", "see Weighing below"]
    pages = {p: "\n".join(rnd.choices(lines, k=rnd.randint(1, 5))) for p in range(1, total + 1) if rnd.random() < 0.9}
    sections, proposed = [], []
    for o in range(rnd.randint(0, 4)):
        a, b = sorted((rnd.randint(1, total), rnd.randint(1, total)))
        sections.append((o, rnd.choice(["a", "bpcr", "a__weighing"]), f"name {o}", rnd.choice(["batch_record_2", "coa", "weighing", None]), rnd.choice([None, "x"]), a, b))
        for n in range(rnd.randint(0, 2)):
            proposed.append((o, n, rnd.choice(["milling", "weighing", "deviation", ""]), rnd.choice(["", "Offered"]), rnd.choice([None, 0, 3, 99])))
    return sections, pages, proposed


def framed(spark, packets):
    sections = spark.createDataFrame([(d, *s) for d, (ss, _, _) in packets.items() for s in ss], SECTIONS)
    pages = spark.createDataFrame([(d, p, t) for d, (_, ps, _) in packets.items() for p, t in ps.items()], "doc_id string, page int, text string")
    proposed = spark.createDataFrame([(d, *p) for d, (_, _, os) in packets.items() for p in os], "doc_id string, ordinal int, nth int, section_type string, name string, page int")
    return sections, pages, proposed


def test_sub_sections_equal_a_plain_loop(spark):
    rnd = random.Random(11)
    packets = {f"d{i}": random_packet(rnd) for i in range(200)}
    sections, pages, proposed = framed(spark, packets)
    got = {}
    for r in U.with_sub_sections(sections, pages, proposed, SPEC, HINTS, "record").collect():
        got.setdefault(r["doc_id"], []).append(((r["ordinal"], r["nth"] or 0), (r["section_id"], r["name"], r["section_type"], r["document_type"], r["start_page"], r["end_page"], r["parent"], r["nth"])))
    want = {d: plain(*p) for d, p in packets.items() if p[0]}
    assert {d: [x for _, x in sorted(v)] for d, v in got.items()} == want
    assert any(x[6] for v in want.values() for x in v) and any("__2" in x[0] for v in want.values() for x in v)


def test_twice_changes_nothing(spark):
    packets = {"d": ([(0, "bpcr", "Record", "batch_record", None, 1, 5), (1, "rm", "Materials", "raw_material", None, 6, 9)], {1: "Batch record", 3: "**WEIGHING**\nx", 5: "Milling step"}, [])}
    sections, pages, proposed = framed(spark, packets)
    once = U.with_sub_sections(sections, pages, proposed, SPEC, HINTS, "record")
    rows = [(r["section_type"], r["start_page"], r["end_page"]) for r in once.orderBy("ordinal", "nth").collect()]
    assert rows == [("cover_page", 1, 2), ("weighing", 3, 4), ("milling", 5, 5), ("raw_material", 6, 9)]
    from pyspark.sql import functions as F

    again = once.withColumn("ordinal", (F.col("ordinal") * 10 + F.coalesce("nth", F.lit(0))).cast("int"))
    twice = U.with_sub_sections(again, pages, proposed, SPEC, HINTS, "record")
    shape = ["section_id", "name", "section_type", "document_type", "start_page", "end_page"]
    assert sorted(map(tuple, twice.select(*shape).collect())) == sorted(map(tuple, once.select(*shape).collect()))
    assert twice.where("parent IS NOT NULL").count() == 0


def test_empty_tables(spark):
    sections, pages, proposed = framed(spark, {})
    assert U.with_sub_sections(sections, pages, proposed, SPEC, HINTS, "record").count() == 0
    assert U.containment_tree(sections, ["doc_id"]).count() == 0
