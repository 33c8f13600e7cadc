"""Aggregations: summaries, scores, consensus, learning and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import SEVERITY, STATUS, rank

#: Points a finding takes off, by severity.
PENALTY = {"critical": 10, "major": 5, "minor": 2, "info": 1, "observation": 1}


def grouping_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """AGG-5, AGG-24: counts by each column alone and in all, in one pass: dimension, value and n."""
    view = rows.select(*by)
    expanded = view.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in by], F.struct(F.lit("all").alias("dimension"), F.lit(None).cast("string").alias("value")))).alias("x")).select("x.*")
    return expanded.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def compliance_score(status: str = "status") -> Column:
    """AGG-8: 100 * compliant / (rules - not applicable - error); 100 where nothing is left. Uncertain counts against."""
    s = F.col(status)
    left = F.count("*") - F.count_if(s.isin("not_applicable", "error"))
    return F.when(left <= 0, 100.0).otherwise(F.try_divide(100.0 * F.count_if(s == "compliant"), left))


def worst_status(status: str = "status") -> Column:
    """AGG-7: the worst status of a rule's evaluations."""
    names = F.array(*[F.lit(k) for k, _ in sorted(STATUS.items(), key=lambda x: x[1])])
    return F.get(names, F.max(rank(F.col(status), STATUS)))


def agent_report(evaluations: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-7: per rule the worst status, with the reasoning of its first evaluation and its least confidence.

    evaluations: ordinal, status, confidence, reasoning."""
    worst = evaluations.groupBy(*keys).agg(worst_status().alias("status"))
    own = evaluations.join(worst.withColumnRenamed("status", "__worst"), keys).where(F.col("status") == F.col("__worst"))
    return own.groupBy(*keys).agg(
        F.first("__worst").alias("status"), F.min("confidence").alias("confidence"), F.min_by("reasoning", "ordinal").alias("reasoning"), F.count("*").alias("n")
    )


def deduplicate(findings: DataFrame, mode: str) -> DataFrame:
    """AGG-9: findings merged by rule and text: within an agent ("per_agent", "cross_agent_preserve" with the agents'
    names kept) or over agents ("cross_agent_collapse"); pages united, severity the worst, confidence the least."""
    keys = ["rule_id", "description"] if mode == "cross_agent_collapse" else ["agent", "rule_id", "description"]
    names = F.array(*[F.lit(k) for k, _ in sorted(SEVERITY.items(), key=lambda x: x[1])])
    return findings.groupBy(*keys).agg(
        F.array_sort(F.collect_set("page")).alias("pages"),
        F.get(names, F.max(rank(F.col("severity"), SEVERITY))).alias("severity"),
        F.min("confidence").alias("confidence"),
        F.min_by("evidence", "ordinal").alias("evidence"),
        F.array_sort(F.collect_set("agent")).alias("agents"),
    )


def overall_score(agents: DataFrame) -> DataFrame:
    """AGG-11: the mean of scores weighted by rules, agents without rules left out; 100 where none is left."""
    a = agents.where("rules > 0")
    return a.agg(F.coalesce(F.try_divide(F.sum(F.col("score") * F.col("rules")), F.sum("rules")), F.lit(100.0)).alias("score"))


def penalty_score(severity: str = "severity", status: str = "hitl") -> Column:
    """AGG-12: 100 less the penalties, at least 0; rejected, resolved and unknown findings take nothing off."""
    p = F.lit(0)
    for k, v in PENALTY.items():
        p = F.when(F.col(severity) == k, v).otherwise(p)
    counts = ~F.coalesce(F.col(status), F.lit("unknown")).isin("user_rejected", "resolved", "unknown")
    return F.greatest(F.lit(0), 100 - F.coalesce(F.sum(F.when(counts, p)), F.lit(0)))


def consensus(values: DataFrame, keys: list[str], least: float) -> DataFrame:
    """AGG-15: per anchor the modal value (of equal counts the first seen), its share, the number of values, and whether
    the share reaches `least`. values: ordinal, value."""
    n = values.groupBy(*keys, "value").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    a = n.groupBy(*keys).agg(
        F.max_by("value", F.struct("n", -F.col("first"))).alias("winner"), F.max("n").alias("top"), F.sum("n").alias("total"), F.count("*").alias("uniques")
    )
    return a.select(*keys, "winner", (F.col("top") / F.col("total")).alias("ratio"), "uniques", (F.col("top") / F.col("total") >= least).alias("agreed"))


def conflicts(values: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-16 a: anchors with more than one value: the values in order; the least is expected."""
    v = values.groupBy(*keys).agg(F.array_sort(F.collect_set("value")).alias("values")).where(F.size("values") > 1)
    return v.withColumn("expected", F.col("values")[0])


def last_gap(rows: DataFrame, keys: list[str], a: str, b: str, least: float = 0.01) -> DataFrame:
    """AGG-16 b: where the last values of two fields differ by more than `least` of the first."""
    last = rows.groupBy(*keys).agg(*[F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("ordinal"))).alias(n) for f, n in ((a, "a"), (b, "b"))])
    gap = F.abs(F.col("a") - F.col("b")) / F.greatest(F.abs(F.col("a")), F.lit(1.0))
    return last.withColumn("gap", gap).where(F.col("gap") > least)


def field_confidence(rows: DataFrame, keys: list[str], low: float = 0.65) -> DataFrame:
    """AGG-18."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.count_if(F.col("confidence") < low).alias("low"))


def learn_corrections(log: DataFrame, least: int = 3, docs: int = 2, top: int = 500) -> DataFrame:
    """AGG-19: rules before -> after in a context, seen `least` times in `docs` documents; confidence is their share of all
    corrections of `before` in that context, taken before the thresholds; the `top` most frequent."""
    g = log.groupBy("ctx", "before", "after").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("ctx", "before"))
    g = g.withColumn("confidence", share).where((F.col("n") >= least) & (F.col("docs") >= docs))
    return g.orderBy(F.desc("n"), F.desc("docs"), "ctx", "before", "after").limit(top)


def confusion_pairs(log: DataFrame, top: int = 50) -> DataFrame:
    """AGG-20, AGG-23, TOP-5: the `top` most frequent pairs."""
    return log.groupBy("before", "after").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "before", "after").limit(top)


def retraining(log: DataFrame, total_at: int = 20) -> DataFrame:
    """AGG-21: total, critical share and whether they call for retraining."""
    t = log.agg(F.count("*").alias("total"), F.coalesce(F.try_divide(F.count_if(F.col("criticality") == "critical"), F.count("*")), F.lit(0.0)).alias("critical"))
    return t.withColumn("retrain", (F.col("total") >= total_at) & ((F.least(F.lit(1.0), F.col("total") / 250) >= 0.08) | (F.col("critical") >= 0.03)))


def quality_dashboard(rows: DataFrame, doc: str) -> DataFrame:
    """AGG-22: the mean over documents of their mean confidence, the mean latency, and sums."""
    per = rows.groupBy(doc).agg(F.avg("confidence").alias("c"), F.sum("latency").alias("l"), F.count("*").alias("n"))
    return per.agg(F.avg("c").alias("mean_confidence"), F.avg("l").alias("mean_latency"), F.sum("n").alias("fields"), F.count("*").alias("docs"))


def document_quality(flags: list[tuple[str, float]], high: float = 0.6, medium: float = 0.3) -> Column:
    """AGG-28: struct(severity, verdict) of weighted boolean flags."""
    s = sum((F.when(F.col(c), w).otherwise(0.0) for c, w in flags), F.lit(0.0))
    return F.struct(s.alias("severity"), F.when(s >= high, "block").when(s >= medium, "warn").otherwise("ok").alias("verdict"))


def page_status(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-31: a page's own decision wins; any flagged component flags it; complete and all approved or edited is approved;
    else needs_review. decisions: component (null: the page's), decision, expected (components of the page)."""
    d = F.col("decision")
    own = F.max(F.when(F.col("component").isNull(), d))
    parts = F.col("component").isNotNull()
    done = F.count_if(parts & d.isin("approved", "edited"))
    return decisions.groupBy(*keys).agg(
        F.coalesce(own, F.when(F.bool_or(parts & (d == "flagged")), "flagged").when((done == F.count_if(parts)) & (done >= F.max("expected")), "approved").otherwise("needs_review")).alias("status")
    )


def precision_recall(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-26: per key and in all (key null): tp, fp, fn, precision, recall, f1. A wrong value is false both ways."""
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    a = outcomes.rollup(*keys).agg(n("tp").alias("tp"), n("wrong").alias("fp"), n("fn", "wrong").alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    a = a.withColumn("precision", F.coalesce(p, F.lit(0.0))).withColumn("recall", F.coalesce(r, F.lit(0.0)))
    return a.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def histogram(rows: DataFrame, keys: list[str], value: str, edges: list[float]) -> DataFrame:
    """AGG-33: counts by bucket (the first edge that holds the value; "+Inf" beyond)."""
    b = F.lit("+Inf")
    for e in sorted(edges, reverse=True):
        b = F.when(F.col(value) <= e, str(e)).otherwise(b)
    return rows.groupBy(*keys, b.alias("le")).agg(F.count("*").alias("n"))


def pending(findings: DataFrame, resolutions: DataFrame, keys: list[str]) -> DataFrame:
    """JN-16, FN-49: per key the blocking findings without an active resolution, stale ones, and the export gate."""
    from ..functions.scoring import export_gate

    j = findings.join(resolutions.select("finding_id", "action", "stale").dropDuplicates(["finding_id"]), "finding_id", "left")
    a = j.groupBy(*keys).agg(F.count_if(F.col("blocking") & F.col("action").isNull()).alias("pending"), F.count_if(F.coalesce("stale", F.lit(False))).alias("stale"))
    return a.withColumn("gate", export_gate(F.col("pending"), F.col("stale")))


def packet_risk(pages: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-17, a packet: max_score, the count of pages of each level, and status. pages: keys, score and level."""
    counts = [F.count_if(F.col("level") == x).alias(x) for x in ("low", "medium", "high")]
    out = pages.groupBy(*keys).agg(F.max("score").alias("max_score"), *counts)
    return out.withColumn("status", F.when(F.col("high") > 0, "needs_attention").when(F.col("medium") > 0, "monitor").otherwise("stable"))
