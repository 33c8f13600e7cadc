"""Rule banks: loading from files with reports, fixture runs, and re-evaluation after corrections."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as R
from . import dsl

_NAMES = {f.name for f in fields(dsl.Rule)}
_LISTS = ("parts", "group_by")


@dataclass
class Report:
    """What is wrong with one rule of a file, or (rule_id None) with the file itself."""

    path: str
    rule_id: str | None
    errors: list[str] = field(default_factory=list)


@dataclass
class Bank:
    """The rules that can run, and a report for each rule and unreadable file, good ones included."""

    rules: list[dsl.Rule] = field(default_factory=list)
    reports: list[Report] = field(default_factory=list)


def _mapping(path: str, text: str) -> dict:
    if path.endswith(".json"):
        data = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no reader of YAML is installed") from e
        try:
            data = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(str(e)) from e
    if not isinstance(data, dict):
        raise ValueError("not a mapping")
    return data


def _cascade(data: dict) -> list[dict]:
    """SRC-20: the rules of a mapping: what a rule says itself goes before its category's defaults, those before the file's."""
    if "rules" not in data and "categories" not in data:
        return [data]
    base, out = data.get("defaults") or {}, [(r, {}) for r in data.get("rules") or []]
    for category in (data.get("categories") or {}).values():
        out += [(r, category.get("defaults") or {}) for r in category.get("rules") or []]
    return [{**base, **own, **rule} for rule, own in out]


def _rule(mapping: dict) -> tuple[dsl.Rule | None, list[str]]:
    if missing := [n for n in ("id", "version", "scope") if not mapping.get(n)]:
        return None, [f"{n} is missing" for n in missing]
    errors = [f"unknown key {n}" for n in sorted(mapping.keys() - _NAMES)]
    given = {k: tuple(v) if k in _LISTS else v for k, v in mapping.items() if k in _NAMES}
    rule = dsl.Rule(**given | {"version": str(given["version"])})
    return rule, errors + dsl.validate(rule)


def load(files: list[tuple[str, str]]) -> Bank:
    """SRC-19: a bank from (path, text) of rule files, by path.

    A rule with errors, a second rule of one id, one superseded by an unknown
    rule and all of a cycle of supersession are reported and left out.
    """
    bank, found = Bank(), []
    for path, text in sorted(files):
        try:
            mappings = _cascade(_mapping(path, text))
        except ValueError as e:
            bank.reports.append(Report(path, None, [f"unreadable: {e}"]))
            continue
        for m in mappings:
            rule, errors = _rule(m) if isinstance(m, dict) else (None, ["not a mapping"])
            report = Report(path, m.get("id") if isinstance(m, dict) else None, errors)
            if rule and any(r.id == rule.id for r, _ in found):
                report.errors.append("another rule has this id")
            bank.reports.append(report)
            if rule and not report.errors:
                found.append((rule, report))
    ids = {r.id for r, _ in found}
    circular = {i for cycle in dsl.supersession_cycles([r for r, _ in found]) for i in cycle}
    for rule, report in found:
        if rule.superseded_by and rule.superseded_by not in ids:
            report.errors.append("superseded by an unknown rule")
        if rule.id in circular:
            report.errors.append("its supersession is circular")
        if not report.errors:
            bank.rules.append(rule)
    return bank


def load_path(spark: SparkSession, path: str) -> Bank:
    """SRC-19: load() of all .json, .yaml and .yml files at a path of any store that Spark reads.

    A bank is configuration: its files come to the driver.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = found.where(F.col("path").rlike(r"\.(json|ya?ml)$")).select("path", F.decode("content", "UTF-8").alias("text")).collect()
    return load([(r["path"], r["text"]) for r in found])


def reports(spark: SparkSession, bank: Bank) -> DataFrame:
    """path, rule_id, ok and errors of a bank's reports."""
    return spark.createDataFrame([(r.path, r.rule_id, not r.errors, r.errors) for r in bank.reports], "path string, rule_id string, ok boolean, errors array<string>")


def fixture_run(bank: list[dsl.Rule], tables: dict[str, DataFrame], expected: DataFrame) -> DataFrame:
    """DSL-6: expectations (rule_id, doc_id, page, status) against what a bank finds in a fixture: got and ok.

    A finding that is not there has no `got`; findings nothing is said about are left out. Null pages meet.
    """
    found = dsl.evaluate(bank, tables).select(F.col("rule_id").alias("r"), F.col("doc_id").alias("d"), F.col("page").alias("p"), F.col("status").alias("got"))
    on = (F.col("rule_id") == F.col("r")) & (F.col("doc_id") == F.col("d")) & F.col("page").eqNullSafe(F.col("p"))
    return expected.join(found, on, "left").select("rule_id", "doc_id", "page", "status", "got", F.coalesce(F.col("status") == F.col("got"), F.lit(False)).alias("ok"))


def reevaluate(bank: list[dsl.Rule], tables: dict[str, DataFrame], findings: DataFrame, corrections: DataFrame) -> DataFrame:
    """RUL-10: the findings after corrections (doc_id, page, field, value), each with what became of it.

    Corrections overlay the fields; rules that name a corrected field run again,
    and syntheses over them, on the corrected documents alone. Of those rules
    and documents the new findings take the old ones' place ("replaced" where
    the status differs, else "confirmed"); all others stay ("kept").
    findings: rule_id, severity, doc_id, page, status, finding_id, as dsl.evaluate() gives them.
    """
    names = {r["field"] for r in corrections.select("field").distinct().collect()}
    leaves = {r.id for r in bank if r.scope != "synthesis" and names & {r.source_field, r.target_field}}
    again = [r for r in bank if r.id in leaves or r.scope == "synthesis" and leaves & set(r.parts)]
    columns = ["rule_id", "severity", "doc_id", "page", "status", "finding_id"]
    if not again:
        return findings.select(*columns, F.lit("kept").alias("change"))
    docs = corrections.select("doc_id").distinct()
    own = {n: t.join(docs, "doc_id", "left_semi") for n, t in tables.items()}
    laid = R.field_overlay(own["fields"].withColumnRenamed("ordinal", "field_ordinal"), corrections, ["doc_id", "page"])
    own["fields"] = laid.withColumnRenamed("field_ordinal", "ordinal")
    # A synthesis reads all its parts, so parts that no correction touches run as well, on these documents.
    parts = {p for r in again if r.scope == "synthesis" for p in r.parts}
    running = [r for r in bank if r in again or r.id in parts]
    ids = [r.id for r in again]
    fresh = dsl.evaluate(running, own).where(F.col("rule_id").isin(ids)).select(*columns)
    replaced = F.col("rule_id").isin(ids)
    was = findings.where(replaced).join(docs, "doc_id", "left_semi")
    before = was.select("rule_id", "doc_id", F.col("page").alias("__page"), F.col("status").alias("__was"))
    on = (fresh["rule_id"] == before["rule_id"]) & (fresh["doc_id"] == before["doc_id"]) & fresh["page"].eqNullSafe(F.col("__page"))
    change = F.when(F.col("__was") == F.col("status"), "confirmed").otherwise("replaced")
    new = fresh.join(before, on, "left").select(*[fresh[c] for c in columns], change.alias("change"))
    stay = findings.where(~replaced).unionByName(findings.where(replaced).join(docs, "doc_id", "left_anti").select(*findings.columns))
    return new.unionByName(stay.select(*columns, F.lit("kept").alias("change")))
