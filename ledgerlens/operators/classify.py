"""Classification, routing and applicability operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import multimatch as M


def glob_regex(glob: Column) -> Column:
    """A file-name glob (* and ?) as an anchored, case-blind regular expression."""
    quoted = F.regexp_replace(glob, r"([.\\+^$(){}|\[\]])", r"\\$1")
    return F.concat(F.lit("(?i)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def filename_scores(docs: DataFrame, globs: DataFrame, name: str, doc: str = "doc_id") -> DataFrame:
    """CLS-1: doc, role and score 1.0 for each role one of whose globs matches. globs: role, glob, a manifest's few."""
    M.small_batches(docs)
    found = M.globs_found(F.col(name), [tuple(r) for r in M.manifest(globs, "role", "glob")])
    return docs.select(doc, F.explode(found).alias("x")).groupBy(doc, F.col("x.name").alias("role")).agg(F.lit(1.0).alias("score"))


def header_scores(docs: DataFrame, words: DataFrame, text: str, doc: str = "doc_id", enough: int = 3) -> DataFrame:
    """CLS-2: doc, role and hits over `enough`, at most 1; roles without hits left out. words: role, word."""
    M.small_batches(docs)
    found = M.words_found(F.col(text), [tuple(r) for r in M.manifest(words, "role", "word")])
    return docs.select(doc, F.explode(found).alias("x")).groupBy(doc, F.col("x.name").alias("role")).agg(F.least(F.lit(1.0), F.count_distinct("x.pattern") / enough).alias("score"))


def hybrid(names: DataFrame, headers: DataFrame, doc: str = "doc_id", weights=(1.0, 0.8), least: float = 0.55, margin: float = 0.15) -> DataFrame:
    """CLS-3: the best role a document: weighted mean over the tiers that have a score; none under `least` or, with
    several candidates, less than `margin` ahead. source: the tier with the larger score, the file name on ties."""
    a = names.select(doc, "role", F.col("score").alias("by_name"))
    j = a.join(headers.select(doc, "role", F.col("score").alias("by_text")), [doc, "role"], "full_outer")
    zero = F.lit(0.0)
    total = F.when(F.col("by_name").isNotNull(), weights[0]).otherwise(zero) + F.when(F.col("by_text").isNotNull(), weights[1]).otherwise(zero)
    score = (F.coalesce("by_name", zero) * weights[0] + F.coalesce("by_text", zero) * weights[1]) / total
    w = Window.partitionBy(doc).orderBy(F.desc("score"), "role")
    s = j.withColumn("score", score).withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where("n = 1")
    sure = (F.col("score") >= least) & (F.col("next").isNull() | (F.col("score") - F.col("next") >= margin))
    return s.select(
        doc, F.when(sure, F.col("role")).alias("role"), "score",
        F.when(F.coalesce("by_text", zero) > F.coalesce("by_name", zero), "header").otherwise("filename").alias("source"),
    )


def cardinality(roles: DataFrame, docs: DataFrame, package: str) -> DataFrame:
    """CLS-5: packages and roles whose number of documents breaks exactly_one or at_least_one, absent roles included.

    roles: role, cardinality - a manifest's few, so packages times roles is small. docs: package, role.
    """
    wanted = F.array(*[F.struct(F.lit(r["role"]).alias("role"), F.lit(r["cardinality"]).alias("cardinality")) for r in M.manifest(roles, "role", "cardinality")])
    packages = docs.select(package).distinct().select(package, F.inline(wanted))
    n = docs.groupBy(package, "role").agg(F.count("*").alias("n"))
    j = packages.join(n, [package, "role"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    issue = F.when((F.col("cardinality") == "exactly_one") & (F.col("n") != 1), F.when(F.col("n") == 0, "MISSING").otherwise("TOO_MANY")).when(
        (F.col("cardinality") == "at_least_one") & (F.col("n") == 0), "MISSING"
    )
    return j.withColumn("issue", issue).where("issue IS NOT NULL").select(package, "role", "n", "issue")


def package_status(issues: Column, fatal: list[str]) -> Column:
    """CLS-6: rejected for a fatal issue, needs_review for any other, else classified. issues: an array."""
    return (
        F.when(F.arrays_overlap(issues, F.array(*map(F.lit, fatal))), "REJECTED")
        .when(F.size(issues) > 0, "NEEDS_REVIEW")
        .otherwise("CLASSIFIED")
    )


def page_type(text: Column, page: Column, cover: list[str], index: list[str], form: list[str], structured: Column) -> Column:
    """CLS-7: cover, form, index or content by the first 500 characters, in that order of rules."""
    head = F.lower(F.substring(text, 1, 500))
    has = lambda words: F.greatest(*[F.contains(head, F.lit(w)) for w in words], F.lit(False))
    return (
        F.when((page == 1) & has(cover), "cover").when(structured, "form").when(has(index), "index").when(has(form), "form").otherwise("content")
    )


def route_strategy(pages: DataFrame, doc: str, families: list[str]) -> DataFrame:
    """CLS-9: the family with the largest sum of pages * max(.1, confidence); equal ones by declared order.

    The addends have three decimals and are added up as such, so that equal sums are equal whatever they are made of.
    """
    place = F.array_position(F.array(*map(F.lit, families)), F.col("family"))
    part = F.round(F.col("pages") * F.greatest(F.lit(0.1), F.col("confidence")), 3)
    s = pages.groupBy(doc, "family").agg(F.sum(part.try_cast("decimal(20,3)")).alias("score"))
    w = Window.partitionBy(doc).orderBy(F.desc("score"), place)
    return s.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n").withColumn("score", F.col("score").cast("double"))


def resolve_family(docs: DataFrame, words: DataFrame, doc: str, text: str, fallback: str | None = None) -> DataFrame:
    """CLS-10: doc, family, confidence and reason: +1 for each keyword that the text holds, +.45 where it has half of a
    keyword's words; the highest score, the first declared (by ordinal) of equal ones. confidence: min(1, score / 2.5),
    .2 for the fallback, 0 for blank texts. words: family, ordinal, word."""
    rows = sorted((r["ordinal"], r["family"], r["word"]) for r in M.manifest(words, "family", "ordinal", "word"))
    best = docs.select(doc, F.trim(F.coalesce(F.col(text), F.lit(""))).alias("__t"), M.best_family(F.col(text), [(f, w) for _, f, w in rows], fallback).alias("b"))
    none = F.col("b.score") == 0
    return best.select(
        doc, F.col("b.family").alias("family"),
        F.when(F.col("__t") == "", 0.0).when(none, 0.2).otherwise(F.least(F.lit(1.0), F.round(F.col("b.score") / 2.5, 3))).alias("confidence"),
        F.when(F.col("__t") == "", "empty").when(none, "fallback").otherwise(F.concat(F.lit("matched:"), F.col("b.matched").cast("string"))).alias("reason"),
    )


def skip_reason(rule: dict[str, Column], page: dict[str, Column]) -> Column:
    """FLT-6: the first reason why a rule doesn't apply to a page, null if it does. Empty lists pass; so does a missing section."""
    outside = lambda have, want: (F.size(want) > 0) & ~F.array_contains(want, have)
    return (
        F.when(rule["cannot_evaluate"], "cannot_evaluate")
        .when(outside(page["document_type"], rule["document_types"]), "document_type")
        .when((F.size(rule["excluded_types"]) > 0) & F.array_contains(rule["excluded_types"], page["document_type"]), "excluded_document_type")
        .when(page["section_type"].isNotNull() & outside(page["section_type"], rule["section_types"]), "section_type")
        .when(outside(page["page_type"], rule["page_types"]), "page_type")
        .when((F.size(rule["keywords"]) > 0) & ~F.exists(rule["keywords"], lambda k: F.contains(F.lower(page["text"]), F.lower(k))), "keywords")
    )


def channels(strategy: Column, vision_ready: bool) -> Column:
    """FLT-8: the channels a rule's strategy asks for; text alone where vision isn't there, or the strategy is unknown."""
    if not vision_ready:
        return F.array(F.lit("text"))
    both = F.array(F.lit("text"), F.lit("vision"))
    return F.when(strategy == "vision", F.array(F.lit("vision"))).when(strategy.isin("text_and_vision", "text_primary", "llm_arbitrated"), both).otherwise(F.array(F.lit("text")))


def select_pages(pages: DataFrame, selector: str, keys: list[str], tag: str | None = None, indices: list[int] | None = None, section_id: str | None = None) -> DataFrame:
    """FLT-1, FLT-2: all, first_page, last_page (by page_ordinal, the order of input), by_index or by_tag; then a section."""
    if selector in ("first_page", "last_page"):
        o = F.col("page_ordinal") if selector == "first_page" else F.desc("page_ordinal")
        pages = pages.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(o))).where("__n = 1").drop("__n")
    elif selector == "by_index":
        pages = pages.where(F.col("page_index").isin(indices or []))
    elif selector == "by_tag" and tag:
        pages = pages.where(F.array_contains("tags", tag))
    return pages.where(F.col("section_id") == section_id) if section_id else pages


def single_value(fields: DataFrame, keys: list[str]) -> DataFrame:
    """FLT-3, FLT-4: per key the value of the first page that has exactly one. fields: page_ordinal, value."""
    one = fields.groupBy(*keys, "page_ordinal").agg(F.count("*").alias("n"), F.first("value").alias("value")).where("n = 1")
    return one.groupBy(*keys).agg(F.min_by("value", "page_ordinal").alias("value"))


def first_labelled(kv: DataFrame, labels: DataFrame, doc: str) -> DataFrame:
    """FLT-13, SRC-8: per document and field the earliest non-empty value under one of its labels (trimmed, case-blind).

    kv: page, ordinal, key, value; labels: label, field."""
    norm = lambda c: F.lower(F.trim(F.col(c)))
    j = kv.where(F.trim(F.coalesce("value", F.lit(""))) != "").withColumn("__k", norm("key")).join(
        F.broadcast(labels.select(norm("label").alias("__k"), "field").dropDuplicates(["__k"])), "__k"
    )
    return j.groupBy(doc, "field").agg(F.min_by("value", F.struct("page", "ordinal")).alias("value"))
