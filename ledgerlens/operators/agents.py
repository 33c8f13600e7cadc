"""What agents get and give: canonical documents, families, the pages and chunks a rule reads, report rows and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import multimatch as M
from .classify import skip_reason

# The bounds of the acceptance gates.
BOUNDS = {"quality_f1_delta": 0.0, "latency_ms_delta": 150.0, "cost_usd_delta": 0.02, "signature_false_negative_rate": 0.1, "placeholder_errors": 0}

#: Rows of rules and their document types up to which they are sent to every task; more are joined by a shuffle.
SENT = 50_000


def canonical_documents(docs: DataFrame, role: str | None, package: str) -> DataFrame:
    """CLS-4: docs (package, role and more) with is_canonical: a package's only document of the canonical role is."""
    if role is None:
        return docs.withColumn("is_canonical", F.lit(False))
    n = F.count_if(F.col("role") == role).over(Window.partitionBy(package))
    return docs.withColumn("is_canonical", F.coalesce(F.col("role") == role, F.lit(False)) & (n == 1))


def canonical_issues(docs: DataFrame, role: str, package: str) -> DataFrame:
    """CLS-4: package, issue DUPLICATE_CANONICAL and n of packages with several documents of the canonical role."""
    return docs.where(F.col("role") == role).groupBy(package).agg(F.count("*").alias("n")).where("n > 1").select(package, F.lit("DUPLICATE_CANONICAL").alias("issue"), "n")


def template_family(probe: Column, aliases: list[tuple[str, str]], fallback: str) -> Column:
    """CLS-11: the first family one of whose aliases a probe holds, case and white space folded; aliases: (family, alias), families in order."""
    folded = F.trim(F.regexp_replace(F.lower(F.coalesce(probe, F.lit(""))), r"\s+", " "))
    order = {f: n for n, f in enumerate(dict.fromkeys(f for f, _ in aliases))}
    words = sorted(((f, " ".join(a.lower().split())) for f, a in aliases), key=lambda x: order[x[0]])
    return F.coalesce(F.get(M.words_found(folded, words), F.lit(0))["name"], F.lit(fallback))


def family_probe(packets: DataFrame, sections: DataFrame, doc: str) -> DataFrame:
    """CLS-11: doc and probe: a packet's extraction family and its sections' names, in order. packets: doc, extraction_family; sections: doc, ordinal, name."""
    names = sections.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda s: s["name"]), " ").alias("names"))
    return packets.join(names, doc, "left").select(doc, F.concat_ws(" ", "extraction_family", "names").alias("probe"))


def split_rules(pairs: DataFrame, rule: dict[str, Column], page: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """FLT-7: of pairs of rules and pages those that apply, and the others with status not_applicable, confidence 1 and the reason."""
    p = pairs.withColumn("reason", skip_reason(rule, page))
    return p.where("reason IS NULL").drop("reason"), p.where("reason IS NOT NULL").withColumns({"status": F.lit("not_applicable"), "confidence": F.lit(1.0)})


def rule_chunks(pages: DataFrame, rules: DataFrame, limit: int) -> DataFrame:
    """RUL-16: rule_id, doc_id, document_type, section_type, page and chunk_id: the pages that rules read, in the workers' chunks.

    pages: doc_id, page, document_type, section_type. rules: rule_id, document_types, section_types (empty: any). A
    rule reads pages of its document types; up to `limit` pages of one section type are one chunk, more are two
    halves, the first the smaller. A rule reads all pages of a type or none, so the chunks are cut once for all rules;
    then rules and pages meet by the document type. Up to SENT rows of rules go to every task.
    """
    wanted = rules.select("rule_id", "section_types", F.explode(F.array_distinct("document_types")).alias("document_type"))
    wanted = F.broadcast(wanted) if wanted.limit(SENT + 1).count() <= SENT else wanted
    keys = ["doc_id", "document_type", "section_type"]
    w = Window.partitionBy(*keys)
    n, place = F.count("*").over(w), F.row_number().over(w.orderBy("page"))
    second = (F.col("__n") > limit) & (F.col("__place") > F.floor(F.col("__n") / 2))
    name = F.concat(F.coalesce("section_type", "document_type"), F.when(second, "-1").otherwise("-0"))
    read = pages.where("document_type <> ''").join(wanted.select("document_type"), "document_type", "left_semi")
    cut = read.withColumns({"__n": n, "__place": place}).select(*keys, "page", name.alias("chunk_id"))
    met = cut.join(wanted, "document_type").where((F.size("section_types") == 0) | F.array_contains("section_types", F.col("section_type")))
    return met.select("rule_id", *keys, "page", "chunk_id")


def context_pages(pages: DataFrame, keys: list[str], cap: int, most: int) -> DataFrame:
    """RUL-17: keys, text and dropped: the first `cap` pages of each key, each cut at `most` characters, and how many there are beyond.

    pages: keys, page, text. The text says so where pages were dropped."""
    w = Window.partitionBy(*keys)
    p = pages.withColumns({"__n": F.count("*").over(w), "__place": F.row_number().over(w.orderBy("page"))}).where(F.col("__place") <= cap)
    cut = F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("..."))).otherwise(F.coalesce("text", F.lit("")))
    part = F.struct("page", F.concat(F.lit("--- page "), F.col("page").cast("string"), F.lit(" ---\n"), cut).alias("text"))
    dropped = F.greatest(F.max("__n") - cap, F.lit(0))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "\n")
    note = F.when(dropped > 0, F.concat(F.lit("\n["), dropped.cast("string"), F.lit(" more pages]"))).otherwise("")
    return p.groupBy(*keys).agg(F.concat(text, note).alias("text"), dropped.alias("dropped"))


def report_rows(evaluations: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """JN-17: evaluations (keys, agent, rule_id, status) that apply, each with finding_ids and severity, of its agent's findings on its rule.

    findings: keys, agent, rule_id, finding_id, severity. not_applicable ones are left out; severity is the worst, null without findings.
    """
    from ..functions.scoring import SEVERITY, rank

    on = [*keys, "agent", "rule_id"]
    worst = F.max_by("severity", rank(F.col("severity"), SEVERITY))
    by = findings.groupBy(*on).agg(F.array_sort(F.collect_set("finding_id")).alias("finding_ids"), worst.alias("severity"))
    rows = evaluations.where("status <> 'not_applicable'").select(*on, "status").join(by, on, "left")
    return rows.withColumn("finding_ids", F.coalesce("finding_ids", F.array().cast(by.schema["finding_ids"].dataType)))


# ---------------------------------------------------------------- gates
def accuracy(labels: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-27: variant, right, total and accuracy of predictions (variant, keys, value) against labels (keys, value), case and white space folded.

    Samples count for a variant that predicts any field of theirs; keys begin with the sample's.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    seen = predictions.select("variant", keys[0]).distinct()
    wanted = labels.select(*keys, norm(F.col("value")).alias("__want")).join(seen, keys[0])
    j = wanted.join(predictions.select("variant", *keys, norm(F.col("value")).alias("__got")), ["variant", *keys], "left")
    right = F.count_if(F.coalesce("__got", F.lit("")) == F.col("__want"))
    return j.groupBy("variant").agg(right.alias("right"), F.count("*").alias("total"), F.round(right / F.count("*"), 4).alias("accuracy"))


def gate_reasons(quality: Column, latency: Column, cost: Column, bounds: dict[str, float] = BOUNDS) -> Column:
    """AGG-27: why a change of quality, latency and cost doesn't pass; empty if it does. Nulls count as 0."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return F.array_compact(
        F.array(
            F.when(zero(quality) < bounds["quality_f1_delta"], "quality_f1_delta"),
            F.when(zero(latency) > bounds["latency_ms_delta"], "latency_ms_delta"),
            F.when(zero(cost) > bounds["cost_usd_delta"], "cost_usd_delta"),
        )
    )


def acceptance(metrics: dict[str, Column], bounds: dict[str, float] = BOUNDS) -> Column:
    """AGG-27: struct(gates, accepted): the gates A to F that fail, in order, and whether none does.

    metrics: quality_f1_delta, latency_ms_delta, cost_usd_delta, signature_false_negative_rate, placeholder_errors (null: 0),
    deterministic, parser_surfaced and selection_surfaced (null: true).
    """
    number = lambda n: F.coalesce(metrics[n].cast("double"), F.lit(0.0))
    true = lambda n: F.coalesce(metrics[n], F.lit(True))
    tests = {
        "A": number("quality_f1_delta") >= bounds["quality_f1_delta"],
        "B": number("signature_false_negative_rate") <= bounds["signature_false_negative_rate"],
        "C": number("placeholder_errors") <= bounds["placeholder_errors"],
        "D": (number("latency_ms_delta") <= bounds["latency_ms_delta"]) & (number("cost_usd_delta") <= bounds["cost_usd_delta"]),
        "E": true("deterministic"),
        "F": true("parser_surfaced") & true("selection_surfaced"),
    }
    failed = F.array_compact(F.array(*[F.when(~t, k) for k, t in tests.items()]))
    return F.struct(failed.alias("gates"), (F.size(failed) == 0).alias("accepted"))
