"""The rule language: validation, diffs, supersession, and compilation to plans."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import once
from ..functions.scoring import SEVERITY, compare_numeric, rank
from ..functions.text import numeral
from ..operators import joins, rules

SCOPES = ("same_page", "cross_document", "page_aggregate", "synthesis")
STRATEGIES = ("exact", "normalise", "step_number", "batch_id")
TOLERANCES = (None, "absolute", "percent", "relative")
MULTIPLICITIES = ("first", "all", "error")
AGGREGATIONS = ("sum", "count", "min", "max", "avg")


@dataclass(frozen=True)
class Rule:
    """One declarative rule; validate() tells what is wrong with it."""

    id: str
    version: str
    scope: str
    severity: str = "minor"
    source_field: str = ""
    target_field: str = ""
    strategy: str = "exact"
    aggregation: str = ""
    tol_kind: str | None = None
    tolerance: float = 0.0
    multiplicity: str = "first"
    fallback: str = "flag_as_unevaluated"
    parts: tuple[str, ...] = ()
    group_by: tuple[str, ...] = field(default=())
    deprecated: bool = False
    superseded_by: str | None = None


def validate(rule: Rule) -> list[str]:
    """DSL-1 to DSL-3: the errors of a rule, in order; none for a good one."""
    bad = []
    if not re.fullmatch(r"\d+\.\d+(\.\d+)?", rule.version):
        bad.append("version")
    if rule.scope not in SCOPES:
        bad.append("scope")
    for name, value, allowed in (("strategy", rule.strategy, STRATEGIES), ("tolerance kind", rule.tol_kind, TOLERANCES), ("multiplicity", rule.multiplicity, MULTIPLICITIES), ("fallback", rule.fallback, tuple(joins.FALLBACK))):
        if value not in allowed:
            bad.append(name)
    if rule.tol_kind and rule.tolerance <= 0:
        bad.append("tolerance must be positive")
    if rule.scope == "cross_document" and not (rule.source_field and rule.target_field):
        bad.append("cross_document needs source and target fields")
    if rule.scope == "page_aggregate" and (rule.aggregation not in AGGREGATIONS or not rule.source_field):
        bad.append("page_aggregate needs an aggregation and a source field")
    if rule.scope == "same_page" and not rule.source_field:
        bad.append("same_page needs a source field")
    if rule.scope == "synthesis" and not rule.parts:
        bad.append("synthesis needs parts")
    if rule.deprecated != (rule.superseded_by is not None):
        bad.append("deprecated rules, and no others, are superseded")
    return bad


def content_hash(rule: Rule) -> str:
    """FN-45: a hash of what the rule says, whole numbers and their floats alike."""
    plain = {k: float(v) if isinstance(v, int) and not isinstance(v, bool) else v for k, v in rule.__dict__.items()}
    return hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def supersession_cycles(bank: list[Rule]) -> list[list[str]]:
    """DSL-4: each cycle of superseded_by, from its least id."""
    after = {r.id: r.superseded_by for r in bank if r.superseded_by}
    out, done = [], set()
    for start in sorted(after):
        path, at = [], start
        while at in after and at not in done and at not in path:
            path.append(at)
            at = after[at]
        if at in path:
            cycle = path[path.index(at) :]
            i = cycle.index(min(cycle))
            out.append(cycle[i:] + cycle[:i])
        done |= set(path)
    return out


def diff(old: list[Rule], new: list[Rule]) -> list[tuple[str, str, str]]:
    """DSL-5: (rule, what, detail): added, removed, or the field that changed; tolerance changes say which way."""
    a, b = {r.id: r for r in old}, {r.id: r for r in new}
    out = [(i, "added", "") for i in sorted(b.keys() - a.keys())] + [(i, "removed", "") for i in sorted(a.keys() - b.keys())]
    for i in sorted(a.keys() & b.keys()):
        for name in Rule.__dataclass_fields__:
            x, y = getattr(a[i], name), getattr(b[i], name)
            if x != y:
                tag = ("tightened" if y < x else "loosened") if name == "tolerance" else f"{x} -> {y}"
                out.append((i, name, tag))
    return out


#: scope -> evaluator(rules, tables): rule_id, doc_id, page and status of all findings of all rules of a scope. New scopes register here.
EVALUATORS: dict[str, Callable[[list[Rule], dict[str, DataFrame]], DataFrame]] = {}


def evaluator(scope: str):
    def register(f):
        EVALUATORS[scope] = f
        return f

    return register


_COLUMNS = {"rule_id": "string", "severity": "string", "source_field": "string", "target_field": "string", "strategy": "string", "aggregation": "string", "tol_kind": "string", "tolerance": "double", "multiplicity": "string", "fallback": "string"}


#: Rows of a bank's tables up to which they are sent to every task (about a hundred bytes each); more are joined by a shuffle.
SENT = 50_000


def _sent(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """What the driver holds of a bank, as a table."""
    out = spark.createDataFrame(rows, schema)
    return F.broadcast(out) if len(rows) <= SENT else out


def rule_table(spark: SparkSession, bank: list[Rule]) -> DataFrame:
    """A bank's rules as rows, a column for each parameter."""
    rows = [(r.id, r.severity, r.source_field, r.target_field, r.strategy, r.aggregation, r.tol_kind, float(r.tolerance), r.multiplicity, r.fallback) for r in bank]
    return _sent(spark, rows, ", ".join(f"{k} {v}" for k, v in _COLUMNS.items()))


def _by(value: str, of: dict[str | None, Column]) -> Column:
    """The column that a parameter names, row by row."""
    out = F.lit(None)
    for name, column in of.items():
        out = F.when(F.col(value).isNull() if name is None else F.col(value) == name, column).otherwise(out)
    return out


def _compared(source: Column, target: Column, numeric: bool) -> Column:
    return _by("tol_kind", {k: compare_numeric(source, target, k, F.col("tolerance"), numeric) for k in TOLERANCES})


@evaluator("cross_document")
def _(bank: list[Rule], t: dict[str, DataFrame]) -> DataFrame:
    """JN-1 for all rules: fields meet rules by name, and each other by (rule, key)."""
    fields, rules_ = t["fields"], rule_table(t["fields"].sparkSession, bank)
    key = _by("strategy", {s: joins.entity_key(s, F.col("entity")) for s in STRATEGIES}).alias("key")
    source = fields.join(rules_, F.col("field") == F.col("source_field")).select("rule_id", "doc_id", "page", key, "value", "tol_kind", "tolerance", "multiplicity", "fallback")
    target = fields.join(rules_, F.col("field") == F.col("target_field")).select("rule_id", "multiplicity", key, F.struct("page", "ordinal", "doc_id").alias("ordinal"), F.col("value").alias("t_value")).where("key IS NOT NULL")
    meets = target.where("multiplicity <> 'all'").groupBy("rule_id", "key").agg(F.min_by("t_value", "ordinal").alias("t_value"), F.count("*").alias("matches"))
    if any(r.multiplicity == "all" for r in bank):
        meets = meets.unionByName(target.where("multiplicity = 'all'").select("rule_id", "key", "t_value", F.lit(1).cast("long").alias("matches")))
    alone = _by("fallback", {k: F.lit(v) for k, v in joins.FALLBACK.items()})
    status = F.when(F.col("matches").isNull(), alone).when((F.col("multiplicity") == "error") & (F.col("matches") > 1), "indeterminate")
    return source.join(meets, ["rule_id", "key"], "left").select("rule_id", "doc_id", "page", status.otherwise(_compared(F.col("value"), F.col("t_value"), False)).alias("status"))


@evaluator("same_page")
def _(bank: list[Rule], t: dict[str, DataFrame]) -> DataFrame:
    """RUL-1 for all rules: a page knows which of their fields it has, and opens the rules of the others."""
    wanted = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.source_field).alias("field")) for r in bank])
    fields, names, keys = t["fields"], sorted({r.source_field for r in bank}), ["doc_id", "page"]
    good = fields.where(F.col("field").isin(names) & rules.truthy(F.col("value"))).groupBy(*keys).agg(F.collect_set("field").alias("good"))
    pages = t["pages"].select(*keys).join(good, keys, "left")
    lacks = F.filter(wanted, lambda r: ~F.coalesce(F.array_contains("good", r["field"]), F.lit(False)))
    missing = pages.select(*keys, F.explode(lacks["rule_id"]).alias("rule_id"), F.lit("open").alias("status"))
    none = t["pages"].agg(F.count("*").alias("n")).where("n = 0").select(*[F.lit(None).cast(t["pages"].schema[k].dataType).alias(k) for k in keys], F.explode(wanted["rule_id"]).alias("rule_id"), F.lit("unevaluated").alias("status"))
    return missing.unionByName(none).select("rule_id", *keys, "status")


@evaluator("page_aggregate")
def _(bank: list[Rule], t: dict[str, DataFrame]) -> DataFrame:
    """RUL-3 for all rules: one grouping by (rule, document) has every aggregate, and what is expected."""
    spark = t["fields"].sparkSession
    roles = [(r.id, f, role) for r in bank for f, role in ((r.source_field, "source"), (r.target_field, "target")) if f]
    named = _sent(spark, roles, "rule_id string, field string, role string")
    n, source = numeral(F.col("value")), F.col("role") == "source"
    of = lambda x: F.when(source, x)
    first = F.min_by(F.struct(n.alias("n")), F.when(~source, F.struct("page", "ordinal")))["n"].alias("expected")
    got = t["fields"].join(named, "field").groupBy("rule_id", "doc_id").agg(
        *[rules.aggregate(k, of(F.col("value") if k == "count" else n)).cast("double").alias(k) for k in AGGREGATIONS],
        F.count_if(source).alias("n_source"), F.count_if(source & n.isNull()).alias("bad"), first,
    )
    got = got.where("n_source > 0").join(rule_table(spark, bank), "rule_id").withColumn("actual", _by("aggregation", {k: F.col(k) for k in AGGREGATIONS}))
    unclear = F.col("expected").isNull() | (F.col("aggregation") != "count") & (F.col("bad") > 0)
    return got.select("rule_id", "doc_id", F.lit(None).cast("int").alias("page"), F.when(unclear, "unevaluated").otherwise(_compared(F.col("actual"), F.col("expected"), True)).alias("status"))


def levels(bank: list[Rule]) -> list[list[Rule]]:
    """Syntheses by level: those over leaves alone first, each after all syntheses that it is made of."""
    left, out, done = {r.id: r for r in bank if r.scope == "synthesis"}, [], set()
    while left:
        now = [r for r in left.values() if not (set(r.parts) & left.keys())]
        if not now:
            raise ValueError(f"syntheses made of each other: {sorted(left)}")
        out.append(now)
        done |= {r.id for r in now}
        left = {k: r for k, r in left.items() if k not in done}
    return out


def _synthesised(findings: DataFrame, bank: list[Rule]) -> DataFrame:
    """RUL-4 for all syntheses of a level: findings meet them by the part's id, one grouping rolls them up."""
    rows = [(r.id, p, r.severity, "doc_id" in by, "page" in by) for r in bank for by in [r.group_by or ("doc_id",)] for p in dict.fromkeys(r.parts)]
    made = _sent(findings.sparkSession, rows, "of string, part string, own string, by_doc boolean, by_page boolean")
    met = findings.join(made, F.col("rule_id") == F.col("part")).select(
        "of", "own", F.when(F.col("by_doc"), F.col("doc_id")).alias("doc_id"), F.when(F.col("by_page"), F.col("page")).alias("page"), "status", "severity"
    )
    names = F.array(*[F.lit(k) for k, _ in sorted(SEVERITY.items(), key=lambda x: x[1])])
    worst = F.get(names, F.greatest(F.max(rank(F.col("severity"), SEVERITY)), F.max(rank(F.col("own"), SEVERITY))))
    return met.groupBy("of", "doc_id", "page").agg(rules.roll_up().alias("status"), worst.alias("severity")).select(F.col("of").alias("rule_id"), "severity", "doc_id", "page", "status")


def evaluate(bank: list[Rule], tables: dict[str, DataFrame]) -> DataFrame:
    """RUL-7: the findings of all rules that aren't deprecated: leaf rules first, then syntheses over their findings.

    The bank is a table: fields meet its rules by name, and each scope takes one grouping, so what is read and
    shuffled doesn't depend on how many rules there are. Syntheses may be made of syntheses; they go level by level,
    a grouping each, over findings that are written once. tables: fields (doc_id, page, ordinal, field, entity,
    value) and pages (doc_id, page).
    """
    if wrong := {r.id: e for r in bank if (e := validate(r))}:
        raise ValueError(f"invalid rules: {wrong}")
    live = [r for r in bank if not r.deprecated]
    leaves = [r for r in live if r.scope != "synthesis"]
    if not leaves:
        raise ValueError("no leaf rule")
    out = None
    for scope in dict.fromkeys(r.scope for r in leaves):
        own = [r for r in leaves if r.scope == scope]
        one = EVALUATORS[scope](own, tables).select("rule_id", _severities(own).alias("severity"), "doc_id", "page", "status")
        out = one if out is None else out.unionByName(one)
    for level in levels(live):
        out = once(out, "findings")
        out = out.unionByName(_synthesised(out, level))
    return out.withColumn("finding_id", rules.finding_id(F.col("rule_id"), F.col("doc_id"), F.col("page"), F.col("status")))


def _severities(bank: list[Rule]) -> Column:
    """The severity of the rule that rule_id names."""
    ids = {s: [r.id for r in bank if r.severity == s] for s in dict.fromkeys(r.severity for r in bank)}
    out = F.lit(None).cast("string")
    for severity, of in ids.items():
        out = F.when(F.col("rule_id").isin(of), severity).otherwise(out)
    return out


def markdown(bank: list[Rule]) -> str:
    """DSL-7: the rules of a bank as a Markdown table."""
    rows = [f"| {r.id} | {r.version} | {r.scope} | {r.severity} | {r.source_field} | {r.target_field} |" for r in sorted(bank, key=lambda r: r.id)]
    return "\n".join(["| rule | version | scope | severity | source | target |", "|---|---|---|---|---|---|", *rows])
