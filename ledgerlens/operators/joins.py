"""Join operators: tolerance reconciliation, aliases, page ranges, upserts, overlays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_name
from .grid import points_in_boxes

FALLBACK = {"flag_as_unevaluated": "unevaluated", "flag_as_indeterminate": "indeterminate", "treat_as_pass": "pass"}


def reconcile(
    source: DataFrame, target: DataFrame, compare: Callable[[Column, Column], Column],
    multiplicity: str = "first", fallback: str = "flag_as_unevaluated",
) -> DataFrame:
    """JN-1: hold each source value against its counterparts.

    source: sid, key, value; target: key, ordinal, value. Sources without a key
    or a counterpart get the fallback's status. More than one counterpart:
    "first" takes the lowest ordinal, "all" gives a row each, "error" one
    indeterminate row. Null keys match nothing. Only first needs no window: the
    targets are reduced before the join.
    """
    t = target.where("key IS NOT NULL").select("key", F.col("ordinal").alias("t_ordinal"), F.col("value").alias("t_value"))
    if multiplicity != "all":
        t = t.groupBy("key").agg(
            F.min("t_ordinal").alias("t_ordinal"), F.min_by("t_value", "t_ordinal").alias("t_value"), F.count("*").alias("matches")
        )
    else:
        t = t.withColumn("matches", F.lit(1).cast("long"))
    joined = source.join(t, "key", "left")
    status = F.when(F.col("matches").isNull(), FALLBACK[fallback])
    if multiplicity == "error":
        status = status.when(F.col("matches") > 1, "indeterminate")
    return joined.withColumn("status", status.otherwise(compare(F.col("value"), F.col("t_value")))).select(
        "sid", "key", "value", "t_ordinal", "t_value", F.coalesce("matches", F.lit(0)).alias("matches"), "status"
    )


def entity_key(strategy: str, value: Column, strip: str = "") -> Column:
    """JN-2: the key of an entity: exact, normalise, step_number (first digits) or batch_id (upper case without blanks)."""
    if strategy == "normalise":
        return F.nullif(normalise_name(value, True, strip), F.lit(""))
    if strategy == "step_number":
        digits = F.regexp_extract(value, r"([0-9]+)", 1)
        return F.when(digits != "", F.regexp_replace(digits, "^0+(?=.)", ""))
    if strategy == "batch_id":
        return F.nullif(F.upper(F.regexp_replace(value, r"\s+", "")), F.lit(""))
    return value


def resolve_alias(rows: DataFrame, value: str, aliases: DataFrame, strip: str = "") -> DataFrame:
    """JN-3: rows with `canonical`, null where no variant matches. aliases: variant, canonical; each variant once."""
    norm = aliases.select(normalise_name(F.col("variant"), True, strip).alias("__v"), "canonical")
    return rows.withColumn("__v", normalise_name(F.col(value), True, strip)).join(norm, "__v", "left").drop("__v")


def page_sections(pages: DataFrame, sections: DataFrame, keys: list[str]) -> DataFrame:
    """JN-4, JN-5: pages with section_id; the last section wins where several hold a page, "unsectioned" where none does.

    Ranges are unfolded to pages, so this is an equi-join; a document has as many rows as its sections have pages.
    """
    held = sections.select(*keys, "section_id", "section_ordinal", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    last = held.groupBy(*keys, "page").agg(F.max_by("section_id", "section_ordinal").alias("section_id"))
    return pages.join(last, [*keys, "page"], "left").withColumn("section_id", F.coalesce("section_id", F.lit("unsectioned")))


def section_text(pages: DataFrame, sections: DataFrame, keys: list[str], most: int, mark: str = "...") -> DataFrame:
    """JN-11: the texts of a section's pages, joined in page order and cut at `most` characters."""
    held = sections.select(*keys, "section_id", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n")
    out = held.join(pages, [*keys, "page"]).groupBy(*keys, "section_id").agg(text.alias("text"))
    return out.withColumn("text", F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit(mark))).otherwise(F.col("text")))


def upsert(base: DataFrame, query: DataFrame, key: str, gain: float = 0.1) -> DataFrame:
    """JN-12: base values, filled and replaced from query ones; `action` says how.

    base and query: key, value, confidence; a key once in each. Missing keys are
    added; an empty base value, or one less sure by more than `gain`, is replaced.
    """
    b = base.select(key, F.col("value").alias("b_value"), F.col("confidence").alias("b_conf"), F.lit(True).alias("in_b"))
    q = query.select(key, F.col("value").alias("q_value"), F.col("confidence").alias("q_conf"), F.lit(True).alias("in_q"))
    action = (
        F.when(F.col("in_b").isNull(), "added")
        .when(F.col("in_q").isNull(), "kept")
        .when(F.coalesce(F.trim(F.col("b_value").cast("string")), F.lit("")) == "", "replaced")
        .when(F.col("q_conf") > F.col("b_conf") + gain, "replaced")
        .otherwise("kept")
    )
    joined = b.join(q, key, "full_outer").withColumn("action", action)
    take = F.col("action") == "kept"
    return joined.select(
        key, F.when(take, F.col("b_value")).otherwise(F.col("q_value")).alias("value"),
        F.when(take, F.col("b_conf")).otherwise(F.col("q_conf")).alias("confidence"), "action",
    )


def shadow_delta(base: DataFrame, custom: DataFrame, key: str) -> DataFrame:
    """JN-13: one row: keys in both, changed, gained and lost."""
    j = base.select(key, F.col("value").alias("b"), F.lit(1).alias("ib")).join(custom.select(key, F.col("value").alias("c"), F.lit(1).alias("ic")), key, "full_outer")
    n = lambda c: F.count_if(c)
    both = F.col("ib").isNotNull() & F.col("ic").isNotNull()
    return j.agg(
        n(both).alias("both"), n(both & ~F.col("b").eqNullSafe(F.col("c"))).alias("changed"),
        n(F.col("ib").isNull()).alias("gained"), n(F.col("ic").isNull()).alias("lost"),
    )


def changed_fields(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """JN-14: key, field, old and new for each field that differs in rows of both (null-safe)."""
    a = after.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old"), F.col(f"__{f}").cast("string").alias("new")) for f in fields])
    return before.join(a, key).select(key, F.explode(pairs).alias("x")).select(key, "x.*").where(~F.col("old").eqNullSafe(F.col("new")))


def overlay(base: DataFrame, log: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """JN-15: base with each field's last logged value (log: key, seq, field, value)."""
    last = log.groupBy(key).agg(*[F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("seq"))).alias(f"__{f}") for f in fields])
    return base.join(last, key, "left").select(
        *[F.coalesce(F.col(f"__{c}"), F.col(c).cast("string")).alias(c) if c in fields else F.col(c) for c in base.columns]
    )


def orphans(base: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """JN-15: log rows without a base row."""
    return log.join(base.select(key).distinct(), key, "left_anti")


def gold_and_predictions(gold: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """JN-18, AGG-26: an outcome a gold row (tp, fn, wrong, tn) and "extra" for predictions without one."""
    g = gold.select(*key, F.col("value").alias("gold"))
    p = predicted.select(*key, F.col("value").alias("predicted"))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    outcome = F.when(blank("gold") & blank("predicted"), "tn").when(blank("predicted"), "fn").when(F.col("gold") == F.col("predicted"), "tp").otherwise("wrong")
    extra = p.join(g.select(*key), key, "left_anti").select(*key, F.lit(None).cast("string").alias("gold"), "predicted", F.lit("extra").alias("outcome"))
    return g.join(p, key, "left").select(*key, "gold", "predicted", outcome.alias("outcome")).unionByName(extra)


def inside(points: DataFrame, boxes: DataFrame, keys: list[str], width: float = 100.0, height: float | None = None) -> DataFrame:
    """JN-21: points (x, y) in boxes (x1, y1, x2, y2) of the same keys, edges included, by the cells of a grid."""
    return points_in_boxes(points, boxes, keys, width, height)
