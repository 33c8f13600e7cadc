"""Lists, queues and roll-ups that people read: orders, pages of lists, caps, progress, states and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The order of a report's buckets, and of a document's states.
BUCKETS = ("action_required", "needs_attention", "compliant")
STATES = ("locked", "decided", "processed")


# ---------------------------------------------------------------- orders
def report_order(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """TOP-2: rows (bucket, agent, rule_id) by bucket, unknown ones last, then agent and rule; the first `limit`, if given."""
    rank = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket"))
    out = rows.orderBy(F.when(rank > 0, rank).otherwise(len(BUCKETS) + 1), "agent", "rule_id")
    return out if limit is None else out.limit(limit)


def review_queue(items: DataFrame, n: int) -> DataFrame:
    """TOP-4: the next n pending items (id, confidence, status), the least sure first, of equals by id; nulls are least sure."""
    return items.where("status = 'pending'").orderBy(F.asc_nulls_first("confidence"), "id").limit(n)


def newest(rows: DataFrame, at: str, ident: str, limit: int, offset: int = 0) -> DataFrame:
    """TOP-6, TOP-9: a page of a list: by time, the newest first, those without a time last, of equals by id."""
    return rows.orderBy(F.desc_nulls_last(at), ident).offset(offset).limit(limit)


def mitigation(findings: DataFrame, keys: list[str], default: str, cached: DataFrame | None = None) -> DataFrame:
    """TOP-7: keys and text: the longest recommendation that isn't blank (the first by ordinal of equal ones), else the
    cached text of the keys, else the default. findings: keys, ordinal, recommendation; cached: keys, text."""
    said = F.trim(F.coalesce("recommendation", F.lit(""))) != ""
    best = F.max_by(F.when(said, F.col("recommendation")), F.when(said, F.struct(F.length("recommendation"), -F.col("ordinal"))))
    out = findings.groupBy(*keys).agg(best.alias("__best"))
    if cached is not None:
        out = out.join(cached.select(*keys, F.col("text").alias("__cached")), keys, "left")
    held = F.col("__cached") if cached is not None else F.lit(None).cast("string")
    return out.select(*keys, F.coalesce("__best", held, F.lit(default)).alias("text"))


def capped(events: DataFrame, keys: list[str], order: str, cap: int) -> DataFrame:
    """TOP-10: keys, order and kind: each key's first `cap` events, and one "overflow" row for those that have more."""
    n = events.select(*keys, order, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).alias("__n")).where(F.col("__n") <= cap + 1)
    over = F.col("__n") > cap
    return n.select(*keys, F.when(~over, F.col(order)).alias(order), F.when(over, "overflow").otherwise("event").alias("kind"))


def batches(rules: DataFrame, category: str, order: str, size: int = 15) -> DataFrame:
    """DSL-9: rules with `batch`, from 0: up to `size` of one category, in order."""
    n = F.row_number().over(Window.partitionBy(category).orderBy(order))
    return rules.withColumn("batch", F.floor((n - 1) / size))


# ---------------------------------------------------------------- roll-ups
def first_unseen_regions(evidence: DataFrame, keys: list[str], region: list[str]) -> DataFrame:
    """AGG-4: keys, finding and the region's columns: in order of findings and of their evidence, each finding gives the
    first of its regions that no finding before it has given. evidence: keys, finding, ordinal, region. Findings
    whose regions are all given give none. A sequential choice, folded over a group's evidence."""
    r = F.struct(*region)
    rows = evidence.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("finding", "ordinal", r.alias("region")))).alias("__all"))
    item = evidence.select("finding", r.alias("region")).schema
    kind = f"array<struct<finding:{item['finding'].dataType.simpleString()},region:{item['region'].dataType.simpleString()}>>"

    def add(done: Column, x: Column) -> Column:
        given = F.exists(done, lambda d: (d["region"] == x["region"]) | (d["finding"] == x["finding"]))
        return F.when(given, done).otherwise(F.concat(done, F.array(F.struct(x["finding"].alias("finding"), x["region"].alias("region")))))

    picked = F.aggregate("__all", F.array().cast(kind), add)
    return rows.select(*keys, F.explode(picked).alias("x")).select(*keys, "x.finding", "x.region.*")


def recomputed_summary(findings: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-6: keys, what, value and n: findings by status, superseded ones as "superseded", and by severity, these included."""
    status = F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise(F.col("status"))
    both = F.array(F.struct(F.lit("status").alias("what"), status.alias("value")), F.struct(F.lit("severity").alias("what"), F.col("severity").alias("value")))
    return findings.select(*keys, F.inline(both)).groupBy(*keys, "what", "value").agg(F.count("*").alias("n"))


def resynced(agents: DataFrame, findings: DataFrame, agent: str = "agent") -> DataFrame:
    """AGG-10: agents with total_findings, counted anew; agents without findings have none."""
    n = findings.groupBy(agent).agg(F.count("*").alias("__n"))
    return agents.join(n, agent, "left").withColumn("total_findings", F.coalesce("__n", F.lit(0))).drop("__n")


def status_counts(rows: DataFrame, keys: list[str], status: str, names: list[str], unknown: str = "unknown") -> DataFrame:
    """AGG-14: keys and a count for each of the names; a null status counts as unknown, other names count nowhere."""
    s = F.coalesce(F.col(status), F.lit(unknown))
    return rows.groupBy(*keys).agg(*[F.count_if(s == n).alias(n) for n in names])


def merged_counters(rows: DataFrame, counters: str, keys: list[str] | None = None) -> DataFrame:
    """AGG-25: keys, name and n: maps of counters, added up by name."""
    return rows.select(*(keys or []), F.explode(counters).alias("name", "__n")).groupBy(*(keys or []), "name").agg(F.sum("__n").alias("n"))


def routed(documents: DataFrame, scores: DataFrame, key: str, least: float = 0.6) -> DataFrame:
    """AGG-29: documents with route: review where a document has no score or one under `least`, else auto. scores: key, score."""
    low = scores.groupBy(key).agg(F.min("score").alias("__low"))
    return documents.join(low, key, "left").withColumn("route", F.when(F.coalesce("__low", F.lit(-1.0)) < least, "review").otherwise("auto")).drop("__low")


def review_progress(items: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-30: keys, total, reviewed, remaining and corrections of items (status, corrected): all but pending ones are reviewed."""
    pending = F.coalesce(F.col("status") == "pending", F.lit(True))
    return items.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(~pending).alias("reviewed"), F.count_if(pending).alias("remaining"), F.count_if("corrected").alias("corrections"))


def document_states(marks: DataFrame, key: str, first: str = "uploaded") -> DataFrame:
    """AGG-32: key and state: the strongest of a document's marks (locked, decided, processed), else `first`. marks: key, mark."""
    out = F.lit(first)
    for s in reversed(STATES):
        out = F.when(F.coalesce(F.bool_or(F.col("mark") == s), F.lit(False)), s).otherwise(out)
    return marks.groupBy(key).agg(out.alias("state"))


def progress(stages: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-35: keys, percent (the mean, to six places) and done (those at 100) of stages (percent)."""
    return stages.groupBy(*keys).agg(F.round(F.avg("percent"), 6).alias("percent"), F.count_if(F.col("percent") == 100).alias("done"))


# ---------------------------------------------------------------- sets
def unused_checks(declared: DataFrame, used: DataFrame, name: str) -> DataFrame:
    """SET-4, AGG-36: the checks that are declared and never used, each once."""
    return declared.select(name).distinct().join(used.select(name).distinct(), name, "left_anti")


def used_checks(rules: DataFrame, keys: list[str], name: str) -> DataFrame:
    """AGG-36: keys and checks: the distinct checks that rules name, sorted."""
    return rules.groupBy(*keys).agg(F.array_sort(F.collect_set(name)).alias("checks"))


def reduced_state(updates: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """SET-7: keys and the value of the last update that sets one; null updates set nothing."""
    return updates.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, order).alias(value))
