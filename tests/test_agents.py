"""Canonical documents, families, chunks, contexts, report rows and gates, held against values by hand."""

from pyspark.sql import functions as F

from ledgerlens.operators import agents as A


def test_canonical(spark):
    docs = spark.createDataFrame([("p", 1, "main"), ("p", 2, "other"), ("q", 3, "main"), ("q", 4, "main"), ("r", 5, None)], "package string, doc int, role string")
    assert {r["doc"] for r in A.canonical_documents(docs, "main", "package").where("is_canonical").collect()} == {1}
    assert A.canonical_documents(docs, None, "package").where("is_canonical").count() == 0
    assert [tuple(r) for r in A.canonical_issues(docs, "main", "package").collect()] == [("q", "DUPLICATE_CANONICAL", 2)]


def test_families_go_by_their_order(spark):
    aliases = [("late", "batch"), ("early", "packing  record"), ("late", "x")]
    df = spark.createDataFrame([("A BATCH Packing record",), ("packing\n record",), ("none",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(A.template_family(F.col("t"), aliases, "core")).collect()] == ["late", "early", "core", "core", "core"]


def test_chunks_are_halves(spark):
    pages = spark.createDataFrame([("d", p, "rec", "a") for p in range(1, 8)] + [("d", 9, "rec", None), ("d", 10, "", "a"), ("d", 11, "coa", "a")], "doc_id string, page int, document_type string, section_type string")
    rules = spark.createDataFrame([("any", ["rec"], []), ("a", ["rec", "coa", "rec"], ["a"]), ("none", ["x"], [])], "rule_id string, document_types array<string>, section_types array<string>")
    got = {}
    for r in A.rule_chunks(pages, rules, 6).collect():
        got.setdefault((r["rule_id"], r["document_type"], r["chunk_id"]), []).append(r["page"])
    want = {("any", "rec", "a-0"): [1, 2, 3], ("any", "rec", "a-1"): [4, 5, 6, 7], ("any", "rec", "rec-0"): [9], ("a", "rec", "a-0"): [1, 2, 3], ("a", "rec", "a-1"): [4, 5, 6, 7], ("a", "coa", "a-0"): [11]}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_context_says_what_it_drops(spark):
    pages = spark.createDataFrame([("d", p, "x" * p) for p in (1, 2, 3)] + [("e", 1, None)], "doc_id string, page int, text string")
    got = {r["doc_id"]: (r["text"], r["dropped"]) for r in A.context_pages(pages, ["doc_id"], 2, 1).collect()}
    assert got == {"d": ("--- page 1 ---\nx\n--- page 2 ---\nx...\n[1 more pages]", 1), "e": ("--- page 1 ---\n", 0)}


def test_report_rows(spark):
    ev = spark.createDataFrame([("d", "a", "r1", "open"), ("d", "a", "r2", "not_applicable"), ("d", "b", "r1", "pass")], "doc_id string, agent string, rule_id string, status string")
    fi = spark.createDataFrame([("d", "a", "r1", "f2", "minor"), ("d", "a", "r1", "f1", "critical"), ("d", "a", "r2", "f3", "minor")], "doc_id string, agent string, rule_id string, finding_id string, severity string")
    got = sorted((r["agent"], r["finding_ids"], r["severity"]) for r in A.report_rows(ev, fi, ["doc_id"]).collect())
    assert got == [("a", ["f1", "f2"], "critical"), ("b", [], None)]


def test_gates(spark):
    rows = [(0.0, 150.0, 0.02, 0.1, 0, True, None, True), (-0.1, 151.0, 0.0, 0.2, 1, False, False, True), (None, None, None, None, None, None, None, None), (1.0, 0.0, 0.03, 0.0, 0, True, True, False)]
    names = ["quality_f1_delta", "latency_ms_delta", "cost_usd_delta", "signature_false_negative_rate", "placeholder_errors", "deterministic", "parser_surfaced", "selection_surfaced"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, ["double"] * 4 + ["int"] + ["boolean"] * 3, strict=True)))
    got = [(r[0]["gates"], r[0]["accepted"], r[1]) for r in df.select(A.acceptance({n: F.col(n) for n in names}), A.gate_reasons(*map(F.col, names[:3]))).collect()]
    assert got == [([], True, []), (list("ABCDEF"), False, ["quality_f1_delta", "latency_ms_delta"]), ([], True, []), (["D", "F"], False, ["cost_usd_delta"])]


def test_accuracy(spark):
    labels = spark.createDataFrame([("s1", "a", "X y"), ("s1", "b", "1"), ("s2", "a", "z")], "s string, f string, value string")
    said = spark.createDataFrame([("v", "s1", "a", " x  Y"), ("w", "s1", "b", "2"), ("w", "s2", "a", "z"), ("w", "s9", "a", "z")], "variant string, s string, f string, value string")
    assert {r["variant"]: tuple(r)[1:] for r in A.accuracy(labels, said, ["s", "f"]).collect()} == {"v": (1, 2, 0.5), "w": (1, 3, 0.3333)}


def test_split_rules(spark):
    lists = "array<string>"
    df = spark.createDataFrame([("r1", "rec", ["rec"]), ("r2", "coa", ["rec"])], f"rule_id string, doc string, types {lists}")
    none = F.array().cast(lists)
    rule = {"cannot_evaluate": F.lit(False), "document_types": F.col("types"), "excluded_types": none, "section_types": none, "page_types": none, "keywords": none}
    page = {"document_type": F.col("doc"), "section_type": F.lit(None).cast("string"), "page_type": F.lit("x"), "text": F.lit("")}
    good, bad = A.split_rules(df, rule, page)
    assert [r["rule_id"] for r in good.collect()] == ["r1"] and [(r["rule_id"], r["reason"], r["status"], r["confidence"]) for r in bad.collect()] == [("r2", "document_type", "not_applicable", 1.0)]
