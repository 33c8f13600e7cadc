"""Numeric comparison, confidence, risk and status expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import numeral

#: Ranks of both severity vocabularies, and of rule statuses from best to worst.
SEVERITY = {"observation": 0, "info": 1, "minor": 2, "major": 3, "critical": 4}
STATUS = {"not_applicable": 0, "compliant": 1, "error": 2, "uncertain": 3, "non_compliant": 4}


def rank(value: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(-1)
    for k, v in ranks.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def compare_numeric(source: Column, target: Column, kind: str | None, tolerance: float = 0.0, numeric: bool = True) -> Column:
    """FN-20: pass, open or indeterminate for two values under a tolerance.

    kind None: equal numbers (never NaN); "absolute": |s-t| <= tolerance;
    "percent": of the larger magnitude; "relative": of the target's. Values
    that are no numerals, null ones, and a zero base leave it indeterminate, as
    does an unknown kind.
    """
    s, t = (source, target) if numeric else (numeral(source), numeral(target))
    s, t = s.cast("double"), t.cast("double")
    gap, nan = F.abs(s - t), F.isnan(s) | F.isnan(t)
    if kind is None:
        holds, base = (s == t) & ~nan, F.lit(1.0)
    elif kind == "absolute":
        holds, base = (gap <= tolerance) & ~nan, F.lit(1.0)
    elif kind in ("percent", "relative"):
        base = F.greatest(F.abs(s), F.abs(t)) if kind == "percent" else F.abs(t)
        holds = (gap <= base * (tolerance / 100.0 if kind == "percent" else tolerance)) & ~nan
    else:
        return F.lit("indeterminate")
    return F.when(s.isNull() | t.isNull() | (base == 0), "indeterminate").when(holds, "pass").otherwise("open")


def confidence_class(c: Column) -> Column:
    """FN-11."""
    return F.when(c >= 0.9, "high").when(c >= 0.7, "medium").otherwise("low")


def quality_grade(scores: list[Column]) -> Column:
    """FN-13, FN-14: struct(mean, grade) of page quality scores."""
    mean = sum(scores[1:], scores[0]) / len(scores)
    return F.struct(mean.alias("mean"), F.when(mean >= 0.9, "excellent").when(mean >= 0.7, "good").when(mean >= 0.5, "fair").otherwise("poor").alias("grade"))


def composite_confidence(quality: Column, lowest_word: Column, table: Column, validation: Column) -> Column:
    """FN-10: weighted .30 .25 .15 .30; missing parts count .5, .5, .5 and .8; a table score of zero is missing."""
    t = F.when(table == 0, None).otherwise(table / 5.0)
    parts = ((quality, 0.5, 0.30), (lowest_word, 0.5, 0.25), (t, 0.5, 0.15), (validation, 0.8, 0.30))
    return sum((F.coalesce(c.cast("double"), F.lit(d)) * w for c, d, w in parts), F.lit(0.0))


def cloud_confidence(average: Column, lowest: Column, validation: Column) -> Column:
    """FN-12."""
    return F.coalesce(average, F.lit(0.5)) * 0.5 + F.coalesce(lowest, F.lit(0.5)) * 0.2 + F.coalesce(validation, F.lit(0.5)) * 0.3


def field_criticality(field_id: Column, critical: list[str]) -> Column:
    """FN-15: critical if listed, major for names of batches, records and products, else minor."""
    is_major = field_id.rlike("batch|bpcr|mpcr|product")
    return F.when(field_id.isin(critical), "critical").when(is_major, "major").otherwise("minor")


def calibrated(base: Column, parser: Column, is_placeholder: Column, allowed: Column, ambiguous: Column, field_id: Column, anchors: Column) -> Column:
    """FN-15: struct(value and each penalty), to four places.

    Up to .2 for a parser score of 0 to 10, .35 for a placeholder that isn't
    allowed, .15 for ambiguity in a yes_no_na field, .07 an anchor issue up to
    .2. A null or zero base counts .5.
    """
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    start = F.when(base.isNull() | (base == 0), 0.5).otherwise(base.cast("double"))
    r = unit(F.coalesce(parser, F.lit(0)) / 10.0) * 0.2
    p = F.when(is_placeholder & ~F.coalesce(allowed, F.lit(False)), 0.35).otherwise(0.0)
    a = F.when(ambiguous & F.contains(field_id, F.lit("yes_no_na")), 0.15).otherwise(0.0)
    c = F.least(F.lit(0.2), F.coalesce(anchors, F.lit(0)) * 0.07)
    names = (("value", unit(start - r - p - a - c)), ("base", start), ("parser", r), ("placeholder", p), ("ambiguity", a), ("anchors", c))
    return F.struct(*[F.round(x, 4).alias(n) for n, x in names])


def corruption_risk(parser: Column, confidence: Column, ambiguous: Column, anchors: Column, handwritten: Column) -> Column:
    """AGG-17, a page: struct(score, level), to two places.

    40 for a parser score of 10 and more, 30 as confidence falls from .8 to 0,
    15 for ambiguity, 7.5 an anchor issue up to 15, 5 from 20 handwritten items on. A null confidence counts .5.
    """
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    score = F.round(
        unit(F.coalesce(parser, F.lit(0)) / 10.0) * 40
        + unit((0.8 - unit(F.coalesce(confidence, F.lit(0.5)))) / 0.8) * 30
        + F.when(ambiguous, 15.0).otherwise(0.0)
        + F.least(F.lit(15.0), F.coalesce(anchors, F.lit(0)) * 7.5)
        + F.when(handwritten >= 20, 5.0).otherwise(0.0),
        2,
    )
    return F.struct(score.alias("score"), F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low").alias("level"))


def review_priority(confidence: Column, criticality: Column, parser: Column, anchors: Column, discrepancy: Column) -> Column:
    """TOP-1, a field: struct(score, reason), at most 100, to two places.

    (1 - confidence) * 70 by criticality (critical 1, major .7, minor .4,
    observation .2, others .6), twice the parser score up to 20, 4 an anchor
    issue up to 10, 15 for a page with a discrepancy. A null or zero confidence counts .5, a null criticality is major.
    """
    kind, sure = F.coalesce(criticality, F.lit("major")), F.when(confidence.isNull() | (confidence == 0), 0.5).otherwise(confidence)
    weight = F.when(kind == "critical", 1.0).when(kind == "major", 0.7).when(kind == "minor", 0.4).when(kind == "observation", 0.2).otherwise(0.6)
    raw = (1 - sure) * 70 * weight + F.least(F.lit(20.0), parser * 2.0) + F.least(F.lit(10.0), anchors * 4.0) + F.when(discrepancy, 15.0).otherwise(0.0)
    return F.struct(F.round(F.least(F.lit(100.0), raw), 2).alias("score"), F.concat(kind, F.lit("_field_low_confidence")).alias("reason"))


def fieldless_priority(parser: Column, discrepancy: Column) -> Column:
    """TOP-1, a page without fields: struct(score, reason): 30, three times the parser score up to 25, 20 for a discrepancy."""
    raw = F.lit(30.0) + F.least(F.lit(25.0), parser * 3.0) + F.when(discrepancy, 20.0).otherwise(0.0)
    return F.struct(F.round(F.least(F.lit(100.0), raw), 2).alias("score"), F.lit("no_structured_fields").alias("reason"))


def status_bucket(status: Column, hitl: Column) -> Column:
    """FN-29: action_required, needs_attention or compliant; null for what doesn't apply.

    Approval by a reviewer makes non_compliant and uncertain compliant, never an error; an unknown status needs attention.
    """
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return (
        F.when(s == "not_applicable", None)
        .when((hitl == "user_approved") & s.isin("non_compliant", "uncertain"), "compliant")
        .when(s == "compliant", "compliant")
        .when(s == "non_compliant", "action_required")
        .otherwise("needs_attention")
    )


def hitl_status(confidence: Column, auto_at: float = 0.8) -> Column:
    """FN-30."""
    return F.when(confidence >= auto_at, "auto_approved").otherwise("needs_review")


def worse(a: Column, b: Column) -> Column:
    """RUL-19: the worse of two statuses, the second on ties."""
    return F.when(a.isNull(), b).when(b.isNull(), a).when(rank(a, STATUS) > rank(b, STATUS), a).otherwise(b)


def strictly_worse(text: Column, vision: Column) -> Column:
    """RUL-20: the first unless the second is strictly worse."""
    return F.when(text.isNull(), vision).when(vision.isNull(), text).when(rank(vision, STATUS) > rank(text, STATUS), vision).otherwise(text)


def export_gate(pending: Column, stale: Column) -> Column:
    """FN-49."""
    return F.when(pending > 0, "blocked").when(stale > 0, "blocked-stale").otherwise("ready")


def signature_evidence(mark: Column, ink: Column, label: Column) -> Column:
    """AGG-34: struct(score, signed): .45, .35 and .20; signed from .55 on."""
    score = mark * 0.45 + ink * 0.35 + label * 0.20
    return F.struct(score.alias("score"), (score >= 0.55).alias("signed"))


def rollback(quality: Column, latency: Column, cost: Column, limits=(-0.01, 150.0, 0.02)) -> Column:
    """CLS-13: the reasons to roll a canary back, from its deltas: quality below its limit, latency or cost above theirs."""
    return F.array_compact(F.array(
        F.when(quality < limits[0], "quality_regression"), F.when(latency > limits[1], "latency_budget_exceeded"), F.when(cost > limits[2], "cost_budget_exceeded")
    ))


def canary(key: Column, percent: int) -> Column:
    """CLS-12: whether the first 8 hex digits of a SHA-1, modulo 100, fall below percent."""
    return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long") % 100 < percent


def iou(a: list[Column], b: list[Column]) -> Column:
    """FN-41: overlap over union of two boxes (x1, y1, x2, y2); 0 for empty ones."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, F.try_divide(w * h, union)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """SET-5: of two arrays as sets; both empty 1, one empty 0."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), n))
