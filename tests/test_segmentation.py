"""DSL-16, DSL-18, DSL-10 and FN-26 to FN-28: segmentations, held against plain loops over random packets."""

import random

from ledgerlens.operators import segmentation as G

P = G.Profiles(
    (
        G.Profile("batch_record", ("record", "bpcr"), (G.Expected("cover_page", ("front",), True), G.Expected("weighing", ("dispensing",), True), G.Expected("log", ()))),
        G.Profile("coa", ("certificate",), (G.Expected("results", ("findings",), True), G.Expected("log", ("journal",)))),
        G.Profile("report", (), ()),
    ),
    {"data": "results"},
)
SCHEMA = "doc_id string, ordinal int, section_id string, name string, section_type string, document_type string, start_page int, end_page int"
KINDS = ["cover_page", "Front", "dispensing", "Log", "journal", "DATA", "Findings ", "report", "certificate", "unknown", "unsectioned", "", None, "odd one", "bpcr_2"]
DOCS = ["batch_record", "coa", "Certificate", "report", "nowhere", "", None]


def packets(seed, n=120):
    rnd = random.Random(seed)
    sections, totals, evidence = {}, {}, {}
    for d in range(n):
        total = rnd.randint(1, 14)
        rows = []
        for o in range(rnd.randint(0, 5)):
            a, b = rnd.randint(-1, total + 2), rnd.randint(-1, total + 2)
            rows.append((o, rnd.choice("abc"), f"n{o}", rnd.choice(KINDS), rnd.choice(DOCS), *((a, b) if rnd.random() < 0.1 else sorted((a, b)))))
        sections[f"d{d}"], totals[f"d{d}"] = rows, total
        evidence[f"d{d}"] = set(rnd.sample(range(0, 15), k=rnd.choice([0, 1, 3])))
    return sections, totals, evidence


def frames(spark, sections, totals, evidence):
    return (
        spark.createDataFrame([(d, *r) for d, rs in sections.items() for r in rs], SCHEMA),
        spark.createDataFrame(list(totals.items()), "doc_id string, total int"),
        spark.createDataFrame([(d, p) for d, ps in evidence.items() for p in ps], "doc_id string, page int"),
    )


def kind_of(x):
    n = G._slug(x or "")
    return {"front": "cover_page", "dispensing": "weighing", "journal": "log", "data": "results", "findings": "results"}.get(n, n)


def doc_of(x):
    n = G._slug(x or "")
    return {"record": "batch_record", "bpcr": "batch_record", "certificate": "coa"}.get(n, n)


OWN = {"batch_record": {"cover_page", "weighing", "log"}, "coa": {"results", "log"}, "report": set()}
ALSO = {"batch_record": {"batch_record", "record", "bpcr", "front", "dispensing"}, "coa": {"coa", "certificate", "findings", "journal"}, "report": {"report"}}
NEEDED = {"batch_record": {"cover_page", "weighing"}, "coa": {"results"}, "report": set()}
TYPES = {"cover_page", "weighing", "log", "results"}


def plain_issues(rows, total, pages):
    out = []
    good = sorted((a, b, o, s, k) for o, s, _, k, _, a, b in rows if a <= b)
    for i, (a, b, _, s, _) in enumerate(good):
        out += [("overlap", (s, t), max(a, c), min(b, d), None) for c, d, _, t, _ in good[i + 1 :] if c <= b]
    covered = {p for a, b, *_ in good for p in range(a, b + 1)}
    gaps, missing = [], [p for p in range(1, total + 1) if p not in covered]
    for p in missing:
        if gaps and gaps[-1][1] == p - 1:
            gaps[-1][1] = p
        else:
            gaps.append([p, p])
    out += [("gap", None, a, b, None) for a, b in gaps]
    for doc in {(r[4] or "").strip() for r in rows} & OWN.keys():
        out += [("missing_required_section", (), None, None, k) for k in NEEDED[doc] - {(r[3] or "").strip() for r in rows if (r[4] or "").strip() == doc}]
    for _, s, _, k, doc, a, b in rows:
        kind, doc = (k or "").strip(), (doc or "").strip()
        if b - a + 1 >= 3 and k != "unknown" and any(p >= 1 for p in pages) and not any(p >= 1 and a <= p <= b for p in pages):
            out.append(("no_kv_evidence", (s,), a, b, k))
        if kind and kind != "unknown" and doc in OWN and kind not in OWN[doc] | ALSO[doc]:
            out.append(("type_mismatch", (s,), a, b, kind))
        if doc and doc_of(doc) not in OWN:
            out.append(("unknown_document_type", (s,), None, None, doc))
        if kind_of(k) and kind_of(k) not in TYPES | {"data"}:
            out.append(("unknown_section_type", (s,), None, None, k))
    return sorted(out, key=str)


def test_issues(spark):
    sections, totals, evidence = packets(1)
    got = {}
    for r in G.issues((f := frames(spark, sections, totals, evidence))[0], P, *f[1:]).collect():
        ids = None if r["kind"] == "gap" else tuple(r["section_ids"])
        got.setdefault(r["doc_id"], []).append((r["kind"], ids, r["start_page"], r["end_page"], None if r["kind"] == "gap" else r["detail"]))
    want = {d: x for d in sections if (x := plain_issues(sections[d], totals[d], evidence[d]))}
    assert {d: sorted(v, key=str) for d, v in got.items()} == want
    assert {x[0] for v in want.values() for x in v} == {"overlap", "gap", "missing_required_section", "no_kv_evidence", "type_mismatch", "unknown_document_type", "unknown_section_type"}


def test_gaps_know_their_neighbours(spark):
    rows = [("d", 0, "a", "", "log", "", 2, 3), ("d", 1, "b", "", "log", "", 6, 6)]
    got = {r["start_page"]: (r["section_ids"], r["detail"]) for r in G.issues(spark.createDataFrame(rows, SCHEMA), P, spark.createDataFrame([("d", 8)], "doc_id string, total int"), spark.createDataFrame([], "doc_id string, page int")).where("kind = 'gap'").collect()}
    assert got == {1: (["a"], None), 4: (["a", "b"], "same type"), 7: (["b"], None)}


def test_names(spark):
    rows = [(str(i), i, "s", "", k, d, 1, 1) for i, (k, d) in enumerate((k, d) for k in KINDS for d in DOCS)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["ordinal"]: r for r in G.stamped(G.canonical(df, P), P, ["bpcr"], "batch_record").collect()}
    assert len(got) == len(rows)
    for _, i, _, _, k, d, _, _ in rows:
        n = kind_of(k)
        if n in TYPES:
            want = (n, None if n == k else "normalised")
        elif n in OWN:
            want = (n, "whole_document")
        else:
            want = ("unknown", None if k == "unknown" else "invalid" if n in ("", "unsectioned") else "drift")
        assert (got[i]["section_type"], got[i]["event"]) == want
        owner = {"cover_page": "batch_record", "weighing": "batch_record", "results": "coa", "report": "report"}.get(want[0], "")
        assert got[i]["document_type"] == (d or owner)
    raw = {r[0]: r[1] for r in G.stamped(df.where("document_type IS NULL"), P, ["bpcr"], "hinted").select("section_type", "document_type").collect()}
    assert raw["bpcr_2"] == "hinted" and raw["certificate"] == "coa" and raw["Log"] == "" and raw["DATA"] == "coa"


def test_the_chain_leaves_nothing_to_mend(spark):
    sections, totals, _ = packets(2)
    df, total, _ = frames(spark, sections, totals, {"d0": {1}})
    out = G.mended(df, total, P, ["bpcr"], "batch_record")
    left = {r["kind"] for r in G.issues(out, P, total, spark.createDataFrame([], "doc_id string, page int")).collect()}
    assert not left & {"overlap", "gap"}
    rows = {}
    for r in out.collect():
        rows.setdefault(r["doc_id"], []).append(r)
    for d, n in totals.items():
        pages = sorted(p for r in rows[d] for p in range(r["start_page"], r["end_page"] + 1))
        assert pages == list(range(1, n + 1)) and len({r["section_id"] for r in rows[d]}) == len(rows[d])
        assert {r["section_type"] for r in rows[d]} <= TYPES | OWN.keys() | {"unknown"}


def test_the_chain_drills(spark):
    from ledgerlens.operators import sections as S
    from ledgerlens.operators import subsections as U

    spec = S.sections_of({"spec_version": "1", "sections": [{"section_id": "cover_page", "display_name": "Batch record"}, {"section_id": "weighing", "display_name": "Weighing"}]})
    df = spark.createDataFrame([("d", 0, "r", "R", "batch_record_1", "", 2, 5)], SCHEMA)
    pages = spark.createDataFrame([("d", 2, "Batch record"), ("d", 4, "Weighing")], "doc_id string, page int, text string")
    none = spark.createDataFrame([], "doc_id string, ordinal int, nth int, section_type string, name string, page int")
    total = spark.createDataFrame([("d", 6)], "doc_id string, total int")
    out = G.mended(df, total, P, ["batch_record"], "batch_record", lambda s: U.with_sub_sections(s, pages, none, spec, ["batch_record"], "batch_record"))
    rows = [(r["start_page"], r["end_page"], r["section_type"], r["document_type"]) for r in out.orderBy("start_page").collect()]
    assert rows == [(1, 1, "unknown", ""), (2, 3, "cover_page", "batch_record"), (4, 5, "weighing", "batch_record"), (6, 6, "unknown", "")]


def test_configuration():
    assert P.problems() == []
    bad = G.Profiles((G.Profile("A b", ("x",), (G.Expected("s", ("t",)), G.Expected("s", ()))), G.Profile("c", ("x",), (G.Expected("u", ("t",)),))), {"q": "nowhere"})
    assert bad.problems() == ["A b: 'A b' is no slug", "A b: s is there twice", "x names A b and c", "t names sections s and u", "alias q leads to nowhere, which no profile has"]
