"""Sections, ports around them, the audit trail and throttled progress, held against values by hand."""

import json
from datetime import datetime, timedelta

import pytest

from ledgerlens.operators import sections as S
from ledgerlens.sources import audit
from ledgerlens.streaming import progress

SPEC = {
    "spec_version": "1",
    "sections": [
        {"section_id": "cover_page", "display_name": "Batch record", "regex": [r"^\s*batch record"]},
        {"section_id": "equipment", "display_name": "Equipment (list)", "aliases": ["Machines"], "bands": ["top_of_page", "mid_page"]},
    ],
}


def test_specification():
    cover, equipment = S.sections_of(SPEC)
    assert cover.first_page_only and not equipment.first_page_only and cover.bands == ("top_of_page",)
    bad = {"sections": [{"section_id": "A", "display_name": ""}, {"section_id": "b", "display_name": "x" * 81, "bands": []}, {"section_id": "b", "display_name": "B", "bands": ["left", "left"]}, {"section_id": "unsectioned", "display_name": "U"}]}
    with pytest.raises(ValueError, match="spec_version") as e:
        S.sections_of(bad)
    assert str(e.value).count(";") == 8
    with pytest.raises(ValueError, match="no sections"):
        S.sections_of({"spec_version": "1", "sections": []})


def test_candidates_of_text(spark):
    text = "# **ACME plc BATCH RECORD**\n\n**Equipment (list):**\nother\nMachines\nEquipment (list) again"
    pages = spark.createDataFrame([("a", 1, text), ("a", 2, text), ("a", 3, None), ("a", 4, "Equipment (lists)\nmachines!")], "doc_id string, page int, text string")
    got = {(r["page"], r["section_id"]): (r["confidence"], r["ordinal"], r["band"]) for r in S.section_candidates(S.page_lines(pages), S.sections_of(SPEC)).collect()}
    assert (1, "cover_page") in got and (2, "cover_page") not in got and got[1, "cover_page"] == (1.0, 0, "top_of_page")
    assert got[4, "equipment"] == (0.4, 1, "mid_page") and (3, "equipment") not in got


def test_candidates_of_layout(spark):
    rows = [("a", 1, 0, "machines", 0.5, True), ("a", 1, 1, "MACHINES", 0.6, True), ("a", 1, 2, "Machines", 0.1, True), ("a", 1, 3, "batch record", 0.5, True)]
    lines = spark.createDataFrame(rows, "doc_id string, page int, ordinal int, line string, y double, layout boolean")
    got = S.section_candidates(lines, S.sections_of(SPEC)).collect()
    assert [(r["section_id"], r["confidence"], r["ordinal"], r["rank"]) for r in got] == [("equipment", 0.4, 1, 1)]


def test_pages_with_sections_and_order(spark):
    pages = spark.createDataFrame([("a", 1, "old"), ("a", 2, None), ("a", 9, "old"), ("b", 1, None)], "doc_id string, page int, name string")
    found = spark.createDataFrame([("a", 0, 1, 2, "x"), ("a", 1, 2, 3, "y"), ("a", 2, 3, 1, "never")], "doc_id string, ordinal int, start_page int, end_page int, name string")
    got = {(r["doc_id"], r["page"]): r["name"] for r in S.pages_with_sections(pages, found, ["name"]).collect()}
    assert got == {("a", 1): "x", ("a", 2): "y", ("a", 9): None, ("b", 1): None}
    rows = spark.createDataFrame([("a", "steps", "step-010"), ("a", "steps", "step-002"), ("a", None, "z"), ("a", "cover", "c")], "doc_id string, group_kind string, id string")
    assert {r["id"]: r["place"] for r in S.in_section_order(rows, ["cover", "steps"]).collect()} == {"c": 1, "step-002": 2, "step-010": 3, "z": 4}


def test_resolution_fails_open(spark):
    rules = spark.createDataFrame([("d", "r1", "t", ["a"]), ("d", "bad", "t", ["a"]), ("d", "none", "t", []), ("d", "no", "t", ["q"])], "doc_id string, rule_id string, text string, wanted array<string>")
    sections = spark.createDataFrame([("d", "s1", "One"), ("d", "s2", "Two")], "doc_id string, section_id string, name string")

    def port(batch):
        if any(r["rule_id"] == "bad" for r in batch):
            raise RuntimeError("down")
        return [{"id": r["id"], "sections": ["s2", "elsewhere"] if r["rule_id"] == "r1" else [], "applicable": r["rule_id"] == "r1", "reason": "said"} for r in batch]

    got = sorted(tuple(r) for r in S.resolve_sections(rules.repartition(4, "rule_id"), sections, port).select("rule_id", "section_id", "applicable").collect())
    alone = {x for x in got if x[0] == "bad"}
    assert alone == {("bad", "s1", True), ("bad", "s2", True)} and not any(x[0] == "none" for x in got)
    # Rules that share a failing batch fail open with it; the others have the port's word.
    assert {x[0] for x in got} == {"bad", "r1", "no"}


def test_evaluation_over_pages(spark):
    rules = spark.createDataFrame([("x", f"r{i:02}", "t") for i in range(7)] + [("y", "other", "t")], "agent string, rule_id string, text string")
    pages = spark.createDataFrame([("d", 1, "x", "text"), ("d", 2, "x", None), ("d", 1, "z", "unread")], "doc_id string, page int, agent string, text string")

    def port(batch):
        return [{"id": r["id"], "results": [{"rule_id": x["rule_id"], "status": "pass", "reason": str(len(r["rules"]))} for x in r["rules"] if x["rule_id"] != "r03"]} for r in batch]

    got = {(r["page"], r["rule_id"]): (r["status"], r["reason"]) for r in S.evaluate_pages(rules, pages, port, 3).collect()}
    assert len(got) == 14 and got[1, "r00"] == ("pass", "3") and got[2, "r06"] == ("pass", "1") and got[1, "r03"] == ("error", "no answer")


def test_colours(spark):
    grey, red = bytes([90, 90, 90]) * 1000, bytes([200, 20, 20])
    rows = [(1, grey), (2, red * 10 + grey), (3, red * 4 + grey), (4, None), (5, b"ab"), (6, bytes([100, 95, 95]) * 10), (7, bytes([100, 99, 99]) * 1000)]
    got = {r["id"]: r["has_colour"] for r in S.coloured(spark.createDataFrame(rows, "id long, rgb binary")).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: True, 6: True, 7: False}


def test_audit_trail_and_ocr(spark, tmp_path):
    trail = audit.AuditTrail(spark, str(tmp_path / "trail"))
    schema = "doc_id string, page int, field_path string, original_value string, new_value string, reason string, reviewer string, at timestamp"
    rows = [("a", 2, "f", "1", None, "r", "me", datetime(2024, 1, 2)), ("a", 1, "f", None, "2", "r", "me", datetime(2024, 1, 1)), ("b", 1, "f", "1", "2", "r", "me", datetime(2024, 1, 1))]
    for _ in range(2):
        trail.log(spark.createDataFrame(rows, schema))
    assert trail.entries().count() == 3 and trail.entries("a", 1).count() == 1
    out = [json.loads(r["value"]) for r in trail.export("a").collect()]
    assert [x["page"] for x in out] == [1, 2] and "doc_id" not in out[0] and out[1]["original_value"] == "1"
    pages = spark.createDataFrame([(2, "b"), (1, None)], "page int, text string")
    for p in (pages, pages.where("page = 1")):
        audit.write_ocr(p, str(tmp_path / "ocr"), "p1")
    audit.write_ocr(pages, str(tmp_path / "ocr"), "p2")
    assert [tuple(r) for r in audit.read_ocr(spark, str(tmp_path / "ocr"), "p2").collect()] == [(1, None), (2, "b")]
    assert audit.read_ocr(spark, str(tmp_path / "ocr"), "p1").count() == 1


def _ticks(n):
    start = datetime(2024, 1, 1)
    return [(f"k{i % 3}", start + timedelta(milliseconds=130 * i), i, (i * 37) % 101 if i % 7 else 100, "x") for i in range(n)]


def _plain(rows):
    held, out = {}, set()
    for key, at, seq, percent, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        last, peak = held.get(key, (None, None))
        if last is None or percent == 100 or percent >= peak + 5 or (at - last).total_seconds() >= 1:
            held[key] = (at, max(peak or 0, percent))
            out.add(seq)
    return out


def test_throttle(spark, tmp_path):
    schema, rows = "key string, ts timestamp, seq long, percent int, label string", _ticks(200)
    table = spark.createDataFrame(rows, schema)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {r["seq"] for r in progress.throttled(table.repartition(5)).collect()} == _plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for part in (rows[:90], rows[90:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = progress.throttled(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("throttled").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r["seq"] for r in spark.table("throttled").collect()} == _plain(rows)
