"""Reviews and marks, held against values by hand and plain loops."""

import json
import random
import re

from pyspark.sql import functions as F

from ledgerlens.functions import marks as M
from ledgerlens.functions.scoring import STATUS
from ledgerlens.operators import review as R


def test_arbitration(spark):
    rnd = random.Random(1)
    one = lambda: None if rnd.random() < 0.15 else (rnd.choice(list(STATUS)), rnd.choice([0.2, 0.9]), "because")
    rows = [(i, one(), one()) for i in range(200)]
    kind = "struct<status:string,confidence:double,reasoning:string>"
    df = spark.createDataFrame(rows, f"k int, text {kind}, vision {kind}")

    def port(batch):
        return [{"id": r["id"], "status": "uncertain" if i % 2 else "odd", "confidence": 0.5} for r in batch if (i := int(json.loads(r["id"])[0])) % 4]

    def plain(i, t, v, arbiter):
        if t is None or v is None:
            return ("error", None, "missing") if t is v is None else (*(t or v)[:2], "alone")
        if t[0] == v[0]:
            return t[0], min(t[1], v[1]), "agreed"
        if arbiter and i % 2:
            return "uncertain", 0.5, "arbitrated"
        return (t if STATUS[t[0]] >= STATUS[v[0]] else v)[0], min(t[1], v[1]), "graver"

    for p in (port, None):
        got = {r["k"]: (r["status"], r["confidence"], r["how"]) for r in R.arbitrated(df, p, ["k"]).collect()}
        assert got == {i: plain(i, t, v, p) for i, t, v in rows}
    assert sorted(STATUS, key=STATUS.get) == ["not_applicable", "compliant", "error", "uncertain", "non_compliant"]


def test_rule_groups(spark):
    rules = spark.createDataFrame([("p", r) for r in "abcdef"], "p string, rule_id string")
    rows = [("p", "a", 0, True, ["x"]), ("p", "a", 1, True, ["y", "x"]), ("p", "b", 0, True, ["x", "y"]), ("p", "c", 1, False, ["x"]), ("p", "d", 0, True, []), ("p", "e", 0, True, ["z"]), ("p", "zz", 0, True, ["z"])]
    got = {tuple(r["section_ids"]): r["rule_ids"] for r in R.grouped_rules(rules, spark.createDataFrame(rows, "p string, rule_id string, ordinal int, applicable boolean, section_ids array<string>"), ["p"]).collect()}
    assert got == {("x", "y"): ["a", "b"], ("z",): ["e"]}


def test_payloads(spark):
    rows = [
        ("CONFIRM", None, None, None, None), ("CONFIRM", "OTHER", None, None, "CONFIRM takes no reason_type"), ("CONFIRM", None, "", None, "CONFIRM takes no observed_value_on_document"), ("CONFIRM", None, None, "f", "CONFIRM takes no duplicate_of_finding_id"),
        ("DISMISS", None, None, None, "DISMISS needs a reason_type"), ("DISMISS", "ODD", None, None, "unknown reason_type"), ("DISMISS", "OTHER", None, None, None), ("DISMISS", "OCR_MISREAD", "", None, "this reason_type needs observed_value_on_document"),
        ("DISMISS", "OCR_MISREAD", "7", None, None), ("DISMISS", "DUPLICATE_FINDING", None, None, "DUPLICATE_FINDING needs duplicate_of_finding_id"), ("DISMISS", "DUPLICATE_FINDING", None, "f", None), ("CORRECT", None, None, None, "corrections go their own way"), (None, None, None, None, "unknown action"), ("x", None, None, None, "unknown action"),
    ]
    df = spark.createDataFrame(rows, "action string, reason string, observed string, dup string, want string")
    error = R.resolution_error(*map(F.col, ("action", "reason", "observed", "dup")))
    assert [r[0] for r in df.select(error).collect()] == [r[-1] for r in rows]
    good, bad = R.quarantined(df, error)
    assert good.count() == 4 and bad.count() == len(rows) - 4
    fixes = [("f", "7", "c", None), (" ", "7", "c", "a field's name is needed"), ("f", None, "c", "a value is needed"), ("f", "null", "c", "a value is needed"), ("f", '" "', "c", "a value is needed"), ("f", "[1]", "c", "the value must be a scalar"), ("f", "NaN", "c", "the value must be finite"), ("f", '"x"', "", "a comment is needed"), ("f", '"%s"' % ("x" * 10001), "c", "the value is too long"), ("f", "true", "x" * 10001, "the comment is too long"), ("f", '"x"', "c", None)]
    df = spark.createDataFrame(fixes, "field string, value string, comment string, want string")
    assert [r[0] for r in df.select(R.correction_error(*map(F.col, ("field", "value", "comment")))).collect()] == [r[-1] for r in fixes]


def test_decisions_seeds_and_scores(spark):
    log = spark.createDataFrame([("d", 1, 0, "flag", "dark"), ("d", 1, 1, "approve", "x"), ("d", 2, 0, "edit", None), ("d", 2, 1, "flag", "torn"), ("d", 3, 0, "delete", None)], "doc_id string, page int, ordinal int, action string, reason string")
    assert sorted(map(tuple, R.page_decisions(log, ["doc_id", "page"]).collect())) == [("d", 1, "approve", "approved", None), ("d", 2, "flag", "flagged", "torn")]
    res = spark.createDataFrame([("r1", "f1", "DISMISS", "OTHER"), ("r2", "f1", "CONFIRM", None), ("r3", "f2", "CORRECT", None), ("r4", "gone", "DISMISS", "OTHER")], "resolution_id string, finding_id string, action string, reason_type string")
    find = spark.createDataFrame([("f1", "R", 1, None), ("f2", "R", 1, None), ("f3", "R", 2, "x")], "finding_id string, rule_id string, a int, b string")
    seeds = {r["resolution_id"]: r for r in R.feedback_seeds(res, find, ["b", "a"]).collect()}
    assert seeds.keys() == {"r1", "r3"} and seeds["r1"]["digest"] == seeds["r3"]["digest"] and seeds["r1"]["sample_id"] != seeds["r3"]["sample_id"] and seeds["r1"]["digest"].startswith("sha256:")
    agents = spark.createDataFrame([("a", 80.0, 3), ("a", 50.0, 1), ("b", 80.0, 0), ("b", 50.0, -2)], "d string, score double, rules int")
    reports = spark.createDataFrame([(d, 91.26) for d in "abc"], "d string, model_score double")
    assert {r["d"]: r["review_score"] for r in R.review_adjusted(agents, reports, ["d"]).collect()} == {"a": 72.5, "b": 65.0, "c": 91.3}
    rows = [("open", None, "r", "Major", True), ("open", "x", "r", "major", False), ("closed", None, "r", "major", False), ("open", None, "low", "critical", False), ("open", None, "high", "info", True), ("open", None, None, None, False)]
    df = spark.createDataFrame(rows, "s string, by string, rule string, severity string, want boolean")
    assert [r[0] for r in df.select(R.blocking(*map(F.col, ("s", "by", "rule", "severity")), {"low": False, "high": True})).collect()] == [r[-1] for r in rows]
    df = spark.createDataFrame([(0, None, None, None), (1, "d1", 3, None), (1, "d1", 3, "BPCR_step"), (2, "d1", 12, None)], "n int, doc string, page int, note string")
    assert [r[0] for r in df.select(R.step_bucket(*map(F.col, ("n", "doc", "page", "note")))).collect()] == ["doc-unknown", "doc-d1", "step-03", "step-12"]


def test_marks(spark):
    md = "☑ a [ ] b [X]\n<!-- block_type: Handwriting -->AK  12\n<!-- block_type: Text --> x\n| h | Done by |\n|---|---|\n| 1 | Ann [Signature] |\n| 2 | [signature] |\n$$E=m$$ and $ E=m $ $y$\n<!-- block_type: Signature --> J. Doe\n<!-- end -->"
    df = spark.createDataFrame([(md,), (None,), ("",)], "t string")
    rows = df.select(*[f(F.col("t")) for f in (M.selection_marks, M.handwritten_words, M.signature_marks, M.table_sizes, M.formulas)]).collect()
    assert [(m["mark"], m["state"]) for m in rows[0][0]] == [("☑", "selected"), ("[ ]", "unselected"), ("[X]", "selected")]
    assert rows[0][1] == [w for part in re.split(r"<!-- block_type:\s*(?:Handwriting|SectionHeader|Text)\s*-->", md)[1:] for w in part.split()]
    assert [(s["label"], s["confidence"]) for s in rows[0][2]] == [("J. Doe", 0.85), ("Ann", 0.8), ("Signature", 0.8)]
    assert [tuple(t) for t in rows[0][3]] == [(3, 2)]
    assert [tuple(x) for x in rows[0][4]] == [("display", "E=m"), ("inline", "y")]
    assert all(not x for r in rows[1:] for x in r)


def test_selection_summary(spark):
    rows = [("YES no n/a", ["selected", "UNSELECTED", None], True), ("text", ["selected"], False), ("Yes / No / Not applicable", ["unselected"], True), (None, None, None)]
    df = spark.createDataFrame([(t, None if m is None else [(x,) for x in m], p) for t, m, p in rows], "t string, m array<struct<state:string>>, p boolean")
    got = [r[0] for r in df.select(M.selection_summary(*map(F.col, "tmp"))).collect()]
    assert [(r["selected"], r["unselected"], r["unknown"], r["tri_state"], r["reasons"]) for r in got] == [
        (1, 1, 1, True, []), (1, 0, 0, False, ["selected_without_checklist_headers", "selected_marks_without_geometry"]), (0, 1, 0, True, ["tri_state_headers_without_selected_marks"]), (0, 0, 0, False, [])
    ]


def test_signature_cells(spark):
    md = "| a | Done by |\n|---|---|\n| 1 | [Signature] x |\n| [Signature] | y |\n| 3 | [signature] |\n\n| b |\n|---|\n\n| Done by |\n|---|\n| [Signature] |"
    pages = spark.createDataFrame([(1, md), (2, "none")], "page int, text string")
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 20.0, 40.0), (1, 1, 100.0, 100.0, 110.0, 120.0)], "page int, nth int, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r["table"], r["row"], r["column"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in M.signature_cells(pages, boxes, ["done by"], ["page"]).collect())
    assert got == [(0, 2, 1, 10.0, 10.0, 20.0, 20.0), (0, 4, 1, 10.0, 30.0, 20.0, 40.0), (2, 2, 0, 100.0, 110.0, 110.0, 120.0)]
