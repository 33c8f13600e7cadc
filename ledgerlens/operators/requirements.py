"""Requirements across sections: which packets have the sections that a rule compares, by relational division.

sections: doc_id, section_id, section_type, document_type (null or blank where nothing is stamped). Names are compared
folded: trimmed, in lower case, runs of other characters as one underscore.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug

SIDES = ("source", "target")


@dataclass(frozen=True)
class Requirement:
    """Sections of the source types are held against sections of the target types."""

    id: str
    source: tuple[str, ...]
    target: tuple[str, ...]
    comparator: str


def folded(name: Column) -> Column:
    return slug(F.coalesce(name, F.lit("")))


def _sorted_ids(side: str) -> Column:
    return F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("section_id"))))


def resolve_named(sections: DataFrame, asked: DataFrame, registry: list[Requirement]) -> DataFrame:
    """JN-7: asked (doc_id, requirement_id) with comparator, source_ids, target_ids, missing, applicable, complete, pairs and reason.

    Applicable where both sides have a section of any of their types; complete where every type of both sides is
    there (the division), and missing names those that aren't, as "source:type" and "target:type". pairs counts source
    and target sections that differ. A requirement that isn't in the registry is not applicable, whatever there is.

    The registry is rows of (requirement, side, type) that sections meet by type, so a packet's sections are
    grouped once for all requirements.
    """
    spark = sections.sparkSession
    if len({r.id for r in registry}) < len(registry):
        raise ValueError("two requirements have one id")
    rows = [(r.id, side, t) for r in registry for side in SIDES for t in getattr(r, side)]
    wanted = F.broadcast(spark.createDataFrame(rows, "requirement_id string, side string, type string").select("requirement_id", "side", folded(F.col("type")).alias("type")).distinct())
    heads = F.broadcast(spark.createDataFrame([(r.id, r.comparator) for r in registry], "requirement_id string, comparator string"))
    parts = F.broadcast(wanted.groupBy("requirement_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "side", "type"))).alias("parts")))
    own = sections.select("doc_id", F.col("section_id").cast("string").alias("section_id"), folded(F.col("section_type")).alias("type"))
    found = own.join(wanted, "type").groupBy("doc_id", "requirement_id").agg(
        _sorted_ids("source").alias("source_ids"), _sorted_ids("target").alias("target_ids"), F.collect_set(F.concat_ws(":", "side", "type")).alias("there")
    )
    none = F.array().cast("array<string>")
    out = asked.select("doc_id", "requirement_id").distinct().join(found, ["doc_id", "requirement_id"], "left").join(heads, "requirement_id", "left").join(parts, "requirement_id", "left")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("source_ids", "target_ids", "there", "parts")})
    n = {s: F.size(f"{s}_ids").cast("long") for s in SIDES}
    known, both = F.col("comparator").isNotNull(), (n["source"] > 0) & (n["target"] > 0)
    reason = (
        F.when(~known, F.concat(F.lit("unknown requirement "), "requirement_id"))
        .when(both, F.concat(n["source"].cast("string"), F.lit(" source and "), n["target"].cast("string"), F.lit(" target sections for "), "comparator"))
        .otherwise(F.concat(F.lit("missing "), F.array_join(F.array_except("parts", "there"), ", ")))
    )
    return out.select(
        "doc_id", "requirement_id", F.coalesce("comparator", F.lit("unknown")).alias("comparator"), "source_ids", "target_ids", F.array_except("parts", "there").alias("missing"),
        (known & both).alias("applicable"), (known & (F.size(F.array_except("parts", "there")) == 0)).alias("complete"),
        (n["source"] * n["target"] - F.size(F.array_intersect("source_ids", "target_ids"))).alias("pairs"), reason.alias("reason"),
    )


def matched_pairs(resolved: DataFrame) -> DataFrame:
    """JN-7: doc_id, requirement_id, source_id and target_id of what a resolved requirement compares; a section isn't compared with itself."""
    return resolved.select("doc_id", "requirement_id", F.explode("source_ids").alias("source_id"), "target_ids").select("doc_id", "requirement_id", "source_id", F.explode("target_ids").alias("target_id")).where("source_id <> target_id")


def resolve_inline(sections: DataFrame, asked: DataFrame) -> DataFrame:
    """JN-8: asked (doc_id, section_type, in_document_type) with name, section_ids, applicable and reason: is there such a section?

    A blank type stands for any section of the document type, a blank document type for any document; with both blank
    nothing is required, and it isn't applicable. Only where no section of the packet bears the document type do
    unstamped sections of the section type count instead. A packet's sections meet what is asked of it by the packet
    alone, as one row that lists them (an answer may name them all), so they are folded and shuffled once.
    """
    s = sections.select("doc_id", F.col("section_id").cast("string").alias("section_id"), folded(F.col("section_type")).alias("type"), folded(F.col("document_type")).alias("doc"))
    there = s.groupBy("doc_id").agg(F.collect_set(F.struct("doc", "type", "section_id")).alias("there"))
    a = asked.select("doc_id", "section_type", "in_document_type").distinct().withColumns({"type": folded(F.col("section_type")), "in_doc": folded(F.col("in_document_type"))})
    kind, doc, blank = F.col("type"), F.col("in_doc"), F.lit("")
    stamped = F.when(F.exists("there", lambda x: x["doc"] == doc), doc).otherwise(blank)
    a = a.join(there, "doc_id", "left").withColumn("from", F.when(doc != "", stamped))
    of_kind = lambda x: x["type"] == kind
    met = (
        F.when((kind == "") & (doc == ""), F.array().cast(there.schema["there"].dataType))
        .when(doc == "", F.filter("there", of_kind))
        .when((kind == "") & (F.col("from") != ""), F.filter("there", lambda x: x["doc"] == doc))
        .otherwise(F.filter("there", lambda x: (x["doc"] == F.col("from")) & of_kind(x)))
    )
    ids = F.array_sort(F.array_distinct(F.array_compact(F.transform(met, lambda x: x["section_id"]))))
    out = a.withColumn("section_ids", F.coalesce(ids, F.array().cast("array<string>")))
    star = lambda c: F.coalesce(F.nullif(F.col(c), blank), F.lit("*"))
    n = F.size("section_ids")
    reason = F.when((kind == "") & (doc == ""), "an empty requirement").when(n > 0, F.concat(n.cast("string"), F.lit(" sections matched"))).otherwise("no section matched")
    return out.select("doc_id", "section_type", "in_document_type", F.concat_ws(".", star("in_doc"), star("type")).alias("name"), "section_ids", (n > 0).alias("applicable"), reason.alias("reason"))
