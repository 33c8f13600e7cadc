"""What reviewers and arbiters decide: verdicts of two readings, payloads that are checked, decisions, seeds and adjusted scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import STATUS, rank
from .external import Port, call

# What may be decided, and why findings are dismissed.
ACTIONS = ["CONFIRM", "DISMISS", "CORRECT"]
REASONS = ["OCR_MISREAD", "ACCEPTABLE_VARIANCE", "DUPLICATE_FINDING", "OUT_OF_SCOPE", "RULE_MISCONFIGURED", "OTHER"]
NEED_VALUE = ["OCR_MISREAD", "ACCEPTABLE_VARIANCE"]
LONGEST = 10_000
DECIDED = {"approve": "approved", "edit": "edited", "flag": "flagged"}


def _blank(c: str | Column) -> Column:
    return F.coalesce(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("")) == ""


def grouped_rules(rules: DataFrame, resolutions: DataFrame, keys: list[str]) -> DataFrame:
    """JN-10: keys, section_ids (sorted) and rule_ids (sorted): the rules whose last resolution has the same sections.

    rules: keys, rule_id. resolutions: keys, rule_id, ordinal, applicable, section_ids. Rules without a resolution, or
    whose last one is not applicable or has no sections, are in no group.
    """
    last = resolutions.groupBy(*keys, "rule_id").agg(F.max_by(F.struct("applicable", F.array_sort("section_ids").alias("section_ids")), "ordinal").alias("r"))
    held = rules.select(*keys, "rule_id").distinct().join(last, [*keys, "rule_id"]).where(F.col("r.applicable") & (F.size("r.section_ids") > 0))
    return held.groupBy(*keys, F.col("r.section_ids").alias("section_ids")).agg(F.array_sort(F.collect_list("rule_id")).alias("rule_ids"))


def arbitrated(readings: DataFrame, port: Port | None, keys: list[str]) -> DataFrame:
    """RUL-21: keys, status, confidence and how: of two readings of a rule, what both say, else what an arbiter says.

    readings: keys, text and vision, structs of status, confidence and reasoning, either of which may be null. One
    reading alone counts ("alone"), none is an error ("missing"); equal statuses have the lower confidence ("agreed").
    Only conflicts go to the port, which answers {"id", "status", "confidence"} ("arbitrated"); where it fails, or is
    None, the graver status counts, the text's on ties, with the lower confidence ("graver").
    """
    t, v = F.col("text"), F.col("vision")
    conflict = t.isNotNull() & v.isNotNull() & ~t["status"].eqNullSafe(v["status"])
    ident = F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))
    r = readings.withColumns({"__id": ident, "__conflict": conflict})
    if port is None:
        r = r.withColumn("__a", F.lit(None).cast("struct<status:string,confidence:double>"))
    else:
        asked = r.where("__conflict").select(F.col("__id").alias("id"), F.to_json(F.struct("text", "vision")).alias("body"))
        got = call(asked, port).select(F.col("id").alias("__id"), F.from_json("answer", "status string, confidence double").alias("__a"))
        r = r.join(got, "__id", "left")
    said = F.col("__a.status").isin(*STATUS)
    lower = F.least(t["confidence"], v["confidence"])
    graver = F.when(rank(t["status"], STATUS) >= rank(v["status"], STATUS), t["status"]).otherwise(v["status"])
    out = (
        F.when(t.isNull() & v.isNull(), F.struct(F.lit("error").alias("status"), F.lit(None).cast("double").alias("confidence"), F.lit("missing").alias("how")))
        .when(t.isNull() | v.isNull(), F.struct(F.coalesce(t["status"], v["status"]).alias("status"), F.coalesce(t["confidence"], v["confidence"]).alias("confidence"), F.lit("alone").alias("how")))
        .when(~F.col("__conflict"), F.struct(t["status"].alias("status"), lower.alias("confidence"), F.lit("agreed").alias("how")))
        .when(said, F.struct(F.col("__a.status").alias("status"), F.col("__a.confidence").alias("confidence"), F.lit("arbitrated").alias("how")))
        .otherwise(F.struct(graver.alias("status"), lower.alias("confidence"), F.lit("graver").alias("how")))
    )
    return r.select(*keys, out.alias("x")).select(*keys, "x.*")


def resolution_error(action: Column, reason: Column, observed: Column, duplicate_of: Column) -> Column:
    """DSL-12: what is wrong with a resolution of a finding, null if nothing."""
    extra = lambda c, name: F.when(c.isNotNull(), F.lit(f"CONFIRM takes no {name}"))
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    confirm = F.coalesce(extra(reason, "reason_type"), extra(observed, "observed_value_on_document"), extra(duplicate_of, "duplicate_of_finding_id"))
    dismiss = (
        F.when(reason.isNull(), "DISMISS needs a reason_type")
        .when(~reason.isin(*REASONS), "unknown reason_type")
        .when(reason.isin(*NEED_VALUE) & empty(observed), "this reason_type needs observed_value_on_document")
        .when((reason == "DUPLICATE_FINDING") & empty(duplicate_of), "DUPLICATE_FINDING needs duplicate_of_finding_id")
    )
    return F.when(~F.coalesce(action.isin(*ACTIONS), F.lit(False)), "unknown action").when(action == "CORRECT", "corrections go their own way").when(action == "CONFIRM", confirm).otherwise(dismiss)


def correction_error(field: Column, value: Column, comment: Column) -> Column:
    """DSL-12: what is wrong with a correction of a field to a scalar (as JSON), null if nothing."""
    text = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    quoted = F.startswith(F.trim(value), F.lit('"'))
    return (
        F.when(_blank(field), "a field's name is needed")
        .when(value.isNull() | F.trim(value).isin("null", ""), "a value is needed")
        .when(F.trim(value).rlike(r"^[\[{]"), "the value must be a scalar")
        .when(F.trim(value).isin("NaN", "Infinity", "-Infinity"), "the value must be finite")
        .when(quoted & _blank(text), "a value is needed")
        .when(quoted & (F.length(text) > LONGEST), "the value is too long")
        .when(_blank(comment), "a comment is needed")
        .when(F.length(comment) > LONGEST, "the comment is too long")
    )


def quarantined(payloads: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """DSL-12: the payloads that hold, and the others with `error`."""
    p = payloads.withColumn("error", error)
    return p.where("error IS NULL").drop("error"), p.where("error IS NOT NULL")


def page_decisions(log: DataFrame, keys: list[str]) -> DataFrame:
    """DSL-14: keys, action, status and reason: the last decision on each page; log: keys, ordinal, action (approve, edit, flag), reason.

    Only flags have reasons. Other actions are no decisions."""
    known = log.where(F.col("action").isin(*DECIDED))
    names = F.create_map(*[F.lit(x) for kv in DECIDED.items() for x in kv])
    last = known.groupBy(*keys).agg(F.max_by(F.struct("action", F.when(F.col("action") == "flag", F.nullif("reason", F.lit(""))).alias("reason")), "ordinal").alias("d"))
    return last.select(*keys, "d.action", names[F.col("d.action")].alias("status"), "d.reason")


def input_digest(columns: list[str]) -> Column:
    """FN-46: sha256: and a hash of what a finding is based on, the names in order, nulls included."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256))


def feedback_seeds(resolutions: DataFrame, findings: DataFrame, inputs: list[str]) -> DataFrame:
    """DSL-13: a sample for each dismissal or correction of a known finding: its ids, the rule, why, and a digest of its inputs.

    resolutions: resolution_id, finding_id, action, reason_type. findings: finding_id, rule_id and the inputs. A
    sample's id is a hash of the resolution's, so that re-runs give the same samples.
    """
    wanted = resolutions.where(F.col("action").isin("DISMISS", "CORRECT")).select("resolution_id", "finding_id", "action", "reason_type")
    own = findings.select("finding_id", "rule_id", input_digest(inputs).alias("digest"))
    sample = F.concat(F.lit("fbs_"), F.substring(F.sha2(F.col("resolution_id").cast("string"), 256), 1, 32))
    return wanted.join(own, "finding_id").select(sample.alias("sample_id"), "resolution_id", "finding_id", "rule_id", "action", "reason_type", "digest")


def blocking(status: Column, superseded_by: Column, rule: Column, severity: Column, overrides: dict[str, bool], severities: tuple[str, ...] = ("critical", "major")) -> Column:
    """FN-48: whether a finding holds up an export: open, not superseded, and by its rule's override or else its severity."""
    own = F.lit(None).cast("boolean")
    for r, b in overrides.items():
        own = F.when(rule == r, F.lit(b)).otherwise(own)
    return (status == "open") & superseded_by.isNull() & F.coalesce(own, F.lower(severity).isin(*severities), F.lit(False))


def step_bucket(n_evidence: Column, doc: Column, page: Column, note: Column) -> Column:
    """FN-48: a finding's place in a report by its first evidence: step-NN if that says so or there are two, else its document."""
    step = F.contains(F.lower(F.coalesce(note, F.lit(""))), F.lit("bpcr_step")) | (n_evidence >= 2)
    number = F.when(page < 10, F.concat(F.lit("0"), page.cast("string"))).otherwise(page.cast("string"))
    return F.when(F.coalesce(n_evidence, F.lit(0)) == 0, "doc-unknown").when(step, F.concat(F.lit("step-"), number)).otherwise(F.concat(F.lit("doc-"), doc))


def review_adjusted(agents: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-13: reports (keys, model_score) with review_score, to one place: the mean of their agents' scores weighted by
    their rules, where any has rules; else their plain mean; without agents the model's own. agents: keys, score, rules."""
    weight = F.greatest(F.coalesce(F.col("rules"), F.lit(0)), F.lit(0))
    by = agents.groupBy(*keys).agg(F.try_divide(F.sum(F.col("score") * weight), F.sum(weight)).alias("__w"), F.avg("score").alias("__m"))
    return reports.join(by, keys, "left").select(*reports.columns, F.round(F.coalesce("__w", "__m", "model_score"), 1).alias("review_score"))
