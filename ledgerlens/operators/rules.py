"""Rule evaluation: leaf rules, synthesis, fallbacks, corrections and selective re-runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import SEVERITY, compare_numeric, rank


def truthy(value: Column) -> Column:
    """FLT-5: null, blank and (typed) zero or false are absent; the strings "0" and "false" are not."""
    return value.isNotNull() & (F.trim(value) != "")


def finding_id(*parts: Column) -> Column:
    """A finding's id from what it says, so that re-runs agree."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]), 256)


def same_page(pages: DataFrame, fields: DataFrame, page_keys: list[str], rule_id: str) -> DataFrame:
    """RUL-1: an open finding for each page without a truthy field; without any page one that is unevaluated. No passes."""
    good = fields.where(truthy(F.col("value"))).select(*page_keys).distinct()
    missing = pages.select(*page_keys).join(good, page_keys, "left_anti").withColumn("status", F.lit("open"))
    none = pages.agg(F.count("*").alias("n")).where("n = 0").select(
        *[F.lit(None).cast(pages.schema[k].dataType).alias(k) for k in page_keys], F.lit("unevaluated").alias("status")
    )
    return missing.unionByName(none).withColumn("rule_id", F.lit(rule_id))


def aggregate(kind: str, value: Column) -> Column:
    """AGG-1: sum, count, min, max or avg; of nothing the sum and the average are 0."""
    f = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}[kind](value)
    return F.coalesce(f, F.lit(0.0)) if kind in ("sum", "avg") else f


def page_aggregate(values: DataFrame, expected: DataFrame, keys: list[str], kind: str, tol_kind: str | None, tol: float) -> DataFrame:
    """RUL-3: an aggregate against what is expected.

    values: keys, value (string); expected: keys, expected (double). A value that is
    no numeral (unless counting), or a missing expectation, leaves it unevaluated.
    """
    from ..functions.text import numeral

    v = values.withColumn("__n", numeral(F.col("value")))
    bad = F.count_if(F.col("__n").isNull()) if kind != "count" else F.lit(0)
    got = v.groupBy(*keys).agg(aggregate(kind, F.col("__n") if kind != "count" else F.col("value")).cast("double").alias("actual"), bad.alias("bad"))
    j = got.join(expected, keys, "left")
    status = F.when((F.col("bad") > 0) | F.col("expected").isNull(), "unevaluated").otherwise(compare_numeric(F.col("actual"), F.col("expected"), tol_kind, tol))
    return j.select(*keys, "actual", "expected", status.alias("status"))


def roll_up(status: str = "status") -> Column:
    """AGG-2: any open is open, any indeterminate is indeterminate, unevaluated only without a pass, else pass."""
    has = lambda s: F.bool_or(F.col(status) == s)
    return F.when(has("open"), "open").when(has("indeterminate"), "indeterminate").when(has("unevaluated") & ~has("pass"), "unevaluated").otherwise("pass")


def worst_severity(own: str, severity: str = "severity") -> Column:
    """AGG-3: the worst of the children's severities and the rule's own."""
    names = F.array(*[F.lit(k) for k, _ in sorted(SEVERITY.items(), key=lambda x: x[1])])
    return F.get(names, F.greatest(F.max(rank(F.col(severity), SEVERITY)), F.lit(SEVERITY[own])))


def synthesise(findings: DataFrame, keys: list[str], own_severity: str) -> DataFrame:
    """RUL-4: one finding a group of constituents, with rolled-up status, worst severity and the number of parts."""
    return findings.groupBy(*keys).agg(roll_up().alias("status"), worst_severity(own_severity).alias("severity"), F.count("*").alias("parts"))


def affected(rules: DataFrame, field: str, alias_fields: list[str]) -> DataFrame:
    """RUL-8: the rules to run again after a correction of `field`: those that name it (all leaf rules where an
    alias depends on it), and the syntheses of an affected rule. rules: rule_id, scope, fields, parts."""
    leaf = rules.where("scope <> 'synthesis'")
    hit = leaf if field in alias_fields else leaf.where(F.array_contains("fields", field))
    parts = rules.where("scope = 'synthesis'").select("rule_id", F.explode("parts").alias("part"))
    above = parts.join(hit.select(F.col("rule_id").alias("part")), "part").select("rule_id").distinct()
    return hit.select("rule_id", F.lit("leaf").alias("why")).unionByName(above.withColumn("why", F.lit("synthesis")))


def field_overlay(fields: DataFrame, corrections: DataFrame, page_keys: list[str]) -> DataFrame:
    """RUL-9: the first field of a name on a page takes the corrected value; corrections of absent fields are added.

    Further columns of the fields stay with their rows, and are null in what is added."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy(*page_keys, "field").orderBy("field_ordinal")) == 1
    c = corrections.select(*page_keys, "field", F.col("value").alias("__new"))
    done = fields.withColumn("__first", first).join(c, [*page_keys, "field"], "left")
    more = [c for c in fields.columns if c not in {*page_keys, "field", "field_ordinal", "value"}]
    kept = done.select(*page_keys, "field", "field_ordinal", F.when(F.col("__first") & F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col("value")).alias("value"), *more)
    new = c.join(fields.select(*page_keys, "field").distinct(), [*page_keys, "field"], "left_anti")
    top = fields.groupBy(*page_keys).agg(F.max("field_ordinal").alias("__top"))
    add = new.join(top, page_keys, "left").select(*page_keys, "field", (F.coalesce("__top", F.lit(-1)) + 1).cast("int").alias("field_ordinal"), F.col("__new").alias("value"))
    return kept.unionByName(add, allowMissingColumns=True)


def supersede(old: DataFrame, new: DataFrame) -> DataFrame:
    """JN-23: old findings with the id that replaces each: the first new one of the rule on the same evidence, by id."""
    n = new.groupBy("rule_id", "evidence").agg(F.min("finding_id").alias("superseded_by"))
    return old.join(n, ["rule_id", "evidence"], "left")


def unevaluated(rules: DataFrame, summary: Column) -> DataFrame:
    """RUL-6: a finding for each rule (rule_id, version) that nothing could be evaluated for; its evidence is the rule itself.

    The reserved document __rule__ marks such evidence; a rule without a version counts as 0.0.0.
    """
    note = F.concat(F.lit("rule:"), F.coalesce("rule_id", F.lit("<unknown>")), F.lit("@"), F.coalesce("version", F.lit("0.0.0")))
    evidence = F.struct(F.lit("__rule__").alias("doc_id"), F.lit(1).alias("page"), F.lit("rule_source").alias("field"), note.alias("note"))
    return rules.select("rule_id", "version", F.lit("unevaluated").alias("status"), summary.alias("summary"), evidence.alias("evidence"))
