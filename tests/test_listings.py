"""Lists, queues and roll-ups, held against values by hand and plain loops."""

import random

from ledgerlens.operators import listings as L


def test_first_unseen_regions(spark):
    rnd = random.Random(2)
    rows = [(g, f, o, rnd.choice("ab"), rnd.choice([1, 2, None])) for g in range(60) for f in range(rnd.randint(0, 5)) for o in range(rnd.randint(0, 4))]
    df = spark.createDataFrame([r for r in rows if r[4] is not None], "g int, finding int, ordinal int, doc string, page int")
    want = {}
    for g, f, _, d, p in sorted((r for r in rows if r[4] is not None), key=lambda r: r[:3]):
        taken = want.setdefault(g, {})
        if f not in taken and (d, p) not in taken.values():
            taken[f] = (d, p)
    got = {}
    for r in L.first_unseen_regions(df, ["g"], ["doc", "page"]).collect():
        got.setdefault(r["g"], {})[r["finding"]] = (r["doc"], r["page"])
    assert got == want and any(len(set(v.values())) > 2 for v in want.values())


def test_orders(spark):
    rows = spark.createDataFrame([("compliant", "a", "1"), ("odd", "a", "0"), ("action_required", "b", "2"), ("action_required", "a", "3"), ("needs_attention", "a", "4")], "bucket string, agent string, rule_id string")
    assert [r["rule_id"] for r in L.report_order(rows).collect()] == ["3", "2", "4", "1", "0"] and L.report_order(rows, 2).count() == 2
    items = spark.createDataFrame([(1, 0.5, "pending"), (2, 0.1, "done"), (3, None, "pending"), (4, 0.5, "pending")], "id int, confidence double, status string")
    assert [r["id"] for r in L.review_queue(items, 2).collect()] == [3, 1]
    runs = spark.createDataFrame([(1, None), (2, 5), (3, 9), (4, 5)], "id int, at int")
    assert [r["id"] for r in L.newest(runs, "at", "id", 3, 1).collect()] == [2, 4, 1]
    said = spark.createDataFrame([("d", 1, "ab"), ("d", 0, "cd"), ("d", 2, "   "), ("e", 0, None), ("f", 0, "")], "d string, ordinal int, recommendation string")
    cached = spark.createDataFrame([("e", "held")], "d string, text string")
    assert {r["d"]: r["text"] for r in L.mitigation(said, ["d"], "none", cached).collect()} == {"d": "cd", "e": "held", "f": "none"}
    events = spark.createDataFrame([("a", i) for i in range(4)] + [("b", 0)], "k string, i int")
    assert sorted((r["k"], r["i"], r["kind"]) for r in L.capped(events, ["k"], "i", 2).where("i IS NOT NULL").collect()) == [("a", 0, "event"), ("a", 1, "event"), ("b", 0, "event")]
    assert [tuple(r) for r in L.capped(events, ["k"], "i", 2).where("i IS NULL").collect()] == [("a", None, "overflow")]
    rules = spark.createDataFrame([("c", i) for i in range(5)], "category string, id int")
    assert [r["batch"] for r in L.batches(rules, "category", "id", 2).orderBy("id").collect()] == [0, 0, 1, 1, 2]


def test_roll_ups(spark):
    f = spark.createDataFrame([("open", "major", None), ("open", "major", "x"), ("done", "minor", None)], "status string, severity string, superseded_by string")
    assert {(r["what"], r["value"]): r["n"] for r in L.recomputed_summary(f, []).collect()} == {("status", "open"): 1, ("status", "superseded"): 1, ("status", "done"): 1, ("severity", "major"): 2, ("severity", "minor"): 1}
    agents = spark.createDataFrame([("a", 9), ("b", 9)], "agent string, total_findings int")
    assert {r["agent"]: r["total_findings"] for r in L.resynced(agents, spark.createDataFrame([("a",), ("a",), ("z",)], "agent string")).collect()} == {"a": 2, "b": 0}
    c = spark.createDataFrame([({"L0": 1, "L1": 2},), ({"L1": 3},), ({},)], "c map<string,int>")
    assert {r["name"]: r["n"] for r in L.merged_counters(c, "c").collect()} == {"L0": 1, "L1": 5}
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "d string")
    scores = spark.createDataFrame([("a", 0.9), ("a", 0.5), ("b", 0.6)], "d string, score double")
    assert {r["d"]: r["route"] for r in L.routed(docs, scores, "d").collect()} == {"a": "review", "b": "auto", "c": "review"}
    items = spark.createDataFrame([("d", "pending", None), ("d", "approved", True), ("d", None, False)], "d string, status string, corrected boolean")
    assert [tuple(r) for r in L.review_progress(items, ["d"]).collect()] == [("d", 3, 1, 2, 1)]
    marks = spark.createDataFrame([("a", "processed"), ("a", "decided"), ("b", None), ("c", "locked"), ("c", "decided")], "d string, mark string")
    assert {r["d"]: r["state"] for r in L.document_states(marks, "d").collect()} == {"a": "decided", "b": "uploaded", "c": "locked"}
    h = spark.createDataFrame([("a", None), ("a", "x"), ("a", "odd")], "k string, s string")
    assert [tuple(r) for r in L.status_counts(h, ["k"], "s", ["x", "unknown"]).collect()] == [("a", 1, 1)]


def test_sets(spark):
    declared, used = spark.createDataFrame([("a",), ("a",), ("b",)], "c string"), spark.createDataFrame([("b",), ("z",)], "c string")
    assert [r["c"] for r in L.unused_checks(declared, used, "c").collect()] == ["a"]
    updates = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), ("k", 3, None)], "k string, at int, v string")
    assert [tuple(r) for r in L.reduced_state(updates, ["k"], "at", "v").collect()] == [("k", "y")]
