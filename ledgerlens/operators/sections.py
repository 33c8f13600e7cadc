"""Sections of packets: their specification, where pages show them, what pages take from them, and their order."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .external import Port, answered, call

#: The bands of a page, and how sure a hit of each kind is.
BANDS = ("top_of_page", "top_of_table", "mid_page")
TOP_OF_PAGE = 0.2
SURE_AT_TOP, SURE_ELSEWHERE, SURE_MID_PAGE, SURE_BY_ALIAS = 1.0, 0.85, 0.7, 0.4
_ID = re.compile(r"[a-z][a-z0-9_]*")


@dataclass(frozen=True)
class Section:
    """A section to look for; first_page_only ones may stand anywhere in a line, but on page 1 alone."""

    id: str
    name: str
    aliases: tuple[str, ...] = ()
    regex: tuple[str, ...] = ()
    bands: tuple[str, ...] = ("top_of_page",)
    emphasised: bool = True
    first_page_only: bool = False


def sections_of(spec: dict, reserved: tuple[str, ...] = ("unsectioned",), cover: str = "cover_page") -> list[Section]:
    """DSL-11: the sections of a specification, in order; a ValueError names everything that is wrong with it."""
    wrong, out, seen = [], [], set()
    if not spec.get("spec_version"):
        wrong.append("spec_version is missing")
    for n, s in enumerate(spec.get("sections") or []):
        at, name, bands = s.get("section_id") or f"section {n}", s.get("display_name") or "", tuple(s.get("bands", ("top_of_page",)))
        checks = {
            "its id is not a lower-case name": not _ID.fullmatch(s.get("section_id") or ""),
            "its id is reserved": s.get("section_id") in reserved,
            "its id repeats": s.get("section_id") in seen,
            "its name has no or over 80 characters": not 1 <= len(name) <= 80,
            "it needs bands": not bands,
            "a band is unknown": not set(bands) <= set(BANDS),
            "a band repeats": len(set(bands)) < len(bands),
        }
        seen.add(s.get("section_id"))
        wrong += [f"{at}: {what}" for what, so in checks.items() if so]
        out.append(Section(at, name, tuple(s.get("aliases", ())), tuple(s.get("regex", ())), bands, s.get("requires_emphasis_for_mid_page", True), at == cover))
    if not out:
        wrong.append("there are no sections")
    if wrong:
        raise ValueError("; ".join(wrong))
    return out


def bare_line(line: Column) -> Column:
    """A line without heading marks and without asterisks around all of it."""
    text = F.trim(F.regexp_replace(line, r"^\s*#{1,6}\s+", ""))
    return F.regexp_replace(text, r"^\*\*\s*(.+?)\s*\*\*\s*[:.;,]?\s*$", "$1")


def page_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, page, ordinal, line, y (evenly spread from 0) and layout (false) of pages without word positions."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: bare_line(x)), lambda x: x != "")
    split = pages.select("doc_id", "page", lines.alias("lines"))
    each = split.select("doc_id", "page", F.size("lines").alias("n"), F.posexplode("lines").alias("ordinal", "line"))
    return each.select("doc_id", "page", "ordinal", "line", (F.col("ordinal") / F.col("n")).alias("y"), F.lit(False).alias("layout"))


def _any(line: Column, patterns: list[str]) -> Column:
    return line.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def _literal(words: str) -> str:
    return re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", words)


def emphasised(line: Column) -> Column:
    """Whether a line is a heading, bold, or has letters, all of them capitals."""
    capitals = line.rlike(r"\p{L}") & ~line.rlike(r"[\p{L}&&[^\p{Lu}]]")
    return line.rlike(r"^\s*#") | capitals | F.trim(line).rlike(r"^\*\*.*\*\*:?$")


def section_candidates(lines: DataFrame, sections: list[Section]) -> DataFrame:
    """FN-23: doc_id, page, section_id, rank, confidence, band, ordinal and matched_text: each section's best line on each page.

    lines: doc_id, page, ordinal, line, y and layout (whether y comes from words' positions; only then do bands gate).
    The surest line counts, the first one of equals; rank is the section's place in the specification. One pass
    over the lines tests all sections; the best is an aggregate, combined before the shuffle.
    """
    band = F.when(F.col("y") <= TOP_OF_PAGE, "top_of_page").otherwise("mid_page")
    mid, line = F.col("band") == "mid_page", F.col("line")
    tests = []
    for n, s in enumerate(sections):
        lead = "^.*?" if s.first_page_only else r"^\s*"
        own = [lead + p.removeprefix(r"^\s*") if s.first_page_only and p.startswith(r"^\s*") else p for p in s.regex] or [rf"{lead}{_literal(s.name)}\b"]
        hit, also = _any(line, own), _any(line, [rf"{lead}{_literal(a)}\b" for a in s.aliases])
        sure = (
            F.when(hit & (F.col("band") == "top_of_page") & F.lit(s.bands[0] == "top_of_page"), SURE_AT_TOP)
            .when(hit & mid, SURE_MID_PAGE).when(hit, SURE_ELSEWHERE).when(also, SURE_BY_ALIAS)
        )
        may = ~F.col("layout") | F.col("band").isin(*s.bands) & (~mid | F.lit(not s.emphasised) | emphasised(line))
        if s.first_page_only:
            may = may & (F.col("page") == 1)
        tests.append(F.when(may, F.struct(F.lit(s.id).alias("section_id"), F.lit(n).alias("rank"), sure.alias("confidence"))))
    found = lines.withColumn("band", band).withColumn("found", F.explode(F.filter(F.array(*tests), lambda x: x["confidence"].isNotNull())))
    best = F.min_by(F.struct("found.confidence", "band", "ordinal", F.substring("line", 1, 120).alias("matched_text")), F.struct(-F.col("found.confidence"), F.col("ordinal")))
    return found.groupBy("doc_id", "page", F.col("found.section_id").alias("section_id"), F.col("found.rank").alias("rank")).agg(best.alias("b")).select(
        "doc_id", "page", "section_id", "rank", "b.*"
    )


def pages_with_sections(pages: DataFrame, sections: DataFrame, columns: list[str]) -> DataFrame:
    """JN-6: pages with the columns of the section that covers them; of several, the last by ordinal; null where none does.

    sections: doc_id, ordinal, start_page, end_page and the columns.

    Documents go where their key says before their sections are unfolded to pages, and bring what covers their pages as
    a map, so neither side's pages are shuffled if the caller's pages stand by document (repartition("doc_id") before
    an explode(), say). A document's covered pages are one row.
    """
    by_doc = sections.where("start_page <= end_page").select(F.col("doc_id").alias("__doc"), "start_page", "end_page", "ordinal", F.struct(*columns).alias("__of")).repartition("__doc")
    covers = by_doc.select("__doc", F.explode(F.sequence("start_page", "end_page").cast("array<bigint>")).alias("__page"), "ordinal", "__of")
    last = covers.groupBy("__doc", "__page").agg(F.max_by("__of", "ordinal").alias("__of"))
    held = last.groupBy("__doc").agg(F.map_from_entries(F.collect_list(F.struct("__page", "__of"))).alias("__held"))
    joined = pages.drop(*columns).join(held, pages["doc_id"] == held["__doc"], "left").withColumn("__of", F.try_element_at("__held", F.col("page").cast("long")))
    return joined.select(*[pages[c] for c in pages.columns if c not in columns], *[F.col("__of")[c].alias(c) for c in columns])


def in_section_order(sections: DataFrame, groups: list[str]) -> DataFrame:
    """TOP-3: sections with their place (from 1) in their document: by the rank of group_kind, unlisted ones last, then by id as a string."""
    rank = F.array_position(F.array(*map(F.lit, groups)), F.col("group_kind"))
    order = Window.partitionBy("doc_id").orderBy(F.when(rank > 0, rank).otherwise(len(groups) + 1), "id")
    return sections.withColumn("place", F.row_number().over(order))


def resolve_sections(rules: DataFrame, sections: DataFrame, port: Port) -> DataFrame:
    """JN-9: doc_id, rule_id, section_id (null where none matches), applicable and reason, from a port; fails open.

    rules: doc_id, rule_id, text, wanted (array of section types; rules without any aren't asked). sections: doc_id, section_id, name.
    The port answers {"id", "sections": [ids], "applicable", "reason"}. Sections that the document hasn't are
    left out; a rule whose call fails takes all of its document's sections, which wait beside its request.
    """
    asked = rules.where(F.size("wanted") > 0)
    known = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_id", "name"))).alias("sections"))
    ident = F.to_json(F.array(F.col("doc_id").cast("string"), F.col("rule_id").cast("string")))
    bodies = asked.join(known, "doc_id", "left").select("doc_id", "rule_id", "sections", ident.alias("id"), F.to_json(F.struct("rule_id", "text", "wanted", "sections")).alias("body"))
    said = F.from_json("answer", "sections array<string>, applicable boolean, reason string")
    named = answered(bodies, port).withColumn("a", said)
    all_ids = F.transform(F.coalesce("sections", F.array()), lambda s: s["section_id"].cast("string"))
    chosen = F.when(F.col("error").isNotNull(), all_ids).otherwise(F.array_intersect(F.coalesce("a.sections", F.array()), all_ids))
    return named.select(
        "doc_id", "rule_id", F.explode_outer(chosen).alias("section_id"),
        (F.col("error").isNotNull() | F.coalesce("a.applicable", F.lit(True))).alias("applicable"),
        F.when(F.col("error").isNotNull(), "no resolution; all sections").otherwise(F.col("a.reason")).alias("reason"),
    )


def evaluate_pages(rules: DataFrame, pages: DataFrame, port: Port, size: int = 15) -> DataFrame:
    """RUL-12: doc_id, page, rule_id, status and reason: every rule of an agent on every page that the agent reads.

    rules: agent, rule_id, text. pages: doc_id, page, agent, text. A request holds one page and at most `size` of
    an agent's rules, so rules and pages meet by an equi-join over batches; the port answers
    {"id", "results": [{"rule_id", "status", "reason"}]}. Rules without an answer have the status "error".
    """
    batches = rules.groupBy("agent").agg(F.array_sort(F.collect_list(F.struct("rule_id", F.col("text").alias("rule")))).alias("all"))
    starts = F.sequence(F.lit(0), F.size("all") - 1, F.lit(size))
    batches = batches.select("agent", F.posexplode(F.transform(starts, lambda i: F.slice("all", i + 1, size))).alias("batch", "rules"))
    ident = F.to_json(F.array(*[F.col(c).cast("string") for c in ("doc_id", "page", "agent", "batch")]))
    asked = pages.select("doc_id", "page", "agent", "text").join(batches, "agent").withColumn("id", ident)
    got = call(asked.select("id", F.to_json(F.struct("agent", "page", "text", "rules")).alias("body")), port)
    results = F.from_json("answer", "results array<struct<rule_id: string, status: string, reason: string>>")["results"]
    said = got.select("id", F.explode(results).alias("r")).groupBy("id", F.col("r.rule_id").cast("string").alias("rule_id")).agg(F.min("r").alias("r"))
    failed = got.select("id", "error")
    wanted = asked.select("id", "doc_id", "page", F.explode("rules.rule_id").alias("rule_id"))
    out = wanted.join(said, (wanted["id"] == said["id"]) & (wanted["rule_id"].cast("string") == said["rule_id"]), "left").drop(said["id"]).drop(said["rule_id"])
    return out.join(failed, "id").select(
        "doc_id", "page", "rule_id", F.coalesce("r.status", F.lit("error")).alias("status"), F.coalesce("r.reason", "error", F.lit("no answer")).alias("reason")
    )


def coloured(images: DataFrame, mean: float = 8.0, share: float = 0.005, floor: int = 30) -> DataFrame:
    """FLT-11: images (id, rgb binary of three bytes a pixel, null where it can't be read) with has_colour.

    Grey is what has a mean saturation under `mean` and under `share` of its pixels at `floor` or more, of 255;
    an image without saturation at all is grey. What can't be read counts as coloured.
    """
    import numpy as np

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            out = []
            for data in df["rgb"]:
                if data is None or not len(data) or len(data) % 3:
                    out.append(True)
                    continue
                p = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
                high, low = p.max(axis=1), p.min(axis=1)
                saturation = (high - low) * 255 // np.maximum(high, 1)
                out.append(bool(saturation.any() and not (saturation.mean() < mean and (saturation >= floor).mean() < share)))
            yield pd.DataFrame({"id": df["id"], "has_colour": out})

    return images.select("id", "rgb").mapInPandas(each, f"id {dict(images.dtypes)['id']}, has_colour boolean")
