"""Segmentations of packets: type names by profiles, what is wrong with them, and the chain that mends them.

A segmentation is a table of sections: doc_id, ordinal, section_id, name, section_type, document_type, start_page and
end_page. Profiles say which documents and sections there are; they are configuration and stand in the plans.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from . import sequences as Q
from .grid import interval_overlaps
from .subsections import UNSECTIONED, named_like

COLUMNS = ["doc_id", "ordinal", "section_id", "name", "section_type", "document_type", "start_page", "end_page"]
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Expected:
    """A section type of a document's profile."""

    type: str
    aliases: tuple[str, ...] = ()
    required: bool = False


@dataclass(frozen=True)
class Profile:
    """A document type, its other names and its sections."""

    type: str
    aliases: tuple[str, ...] = ()
    sections: tuple[Expected, ...] = ()


def _slug(x: str) -> str:
    return re.sub("^_+|_+$", "", re.sub("[^a-z0-9]+", "_", x.lower()))


def _map(of: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in of.items() for x in kv]) if of else F.create_map().cast("map<string,string>")


@dataclass(frozen=True)
class Profiles:
    """All profiles, in order: of names that two of them claim, the first holds."""

    profiles: tuple[Profile, ...]
    aliases: dict[str, str] = field(default_factory=dict)

    def problems(self) -> list[str]:
        """DSL-10: what is wrong with the configuration itself: names that aren't slugs, claimed twice, or lead nowhere."""
        out, docs, kinds = [], {}, {}
        for p in self.profiles:
            out += [f"{p.type}: {n!r} is no slug" for n in (p.type, *p.aliases, *(x for s in p.sections for x in (s.type, *s.aliases))) if n != _slug(n) or not n]
            for n in (p.type, *p.aliases):
                if docs.setdefault(n, p.type) != p.type:
                    out.append(f"{n} names {docs[n]} and {p.type}")
            own = [s.type for s in p.sections]
            out += [f"{p.type}: {n} is there twice" for n in sorted({n for n in own if own.count(n) > 1})]
            for s in p.sections:
                for n in s.aliases:
                    if kinds.setdefault(n, s.type) != s.type:
                        out.append(f"{n} names sections {kinds[n]} and {s.type}")
        known = {s.type for p in self.profiles for s in p.sections}
        return out + [f"alias {a} leads to {b}, which no profile has" for a, b in self.aliases.items() if b not in known]

    def document_names(self) -> dict[str, str]:
        """Every name of a document type, and the type."""
        out = {p.type: p.type for p in self.profiles}
        for p in self.profiles:
            for a in p.aliases:
                out.setdefault(a, p.type)
        return out

    def section_names(self) -> dict[str, str]:
        """Every name of a section type, and the type; the aliases beside the profiles go first."""
        own: dict[str, str] = {}
        for p in self.profiles:
            for s in p.sections:
                for n in (s.type, *s.aliases):
                    own.setdefault(n, s.type)
        return own | {a: own.get(b, b) for a, b in self.aliases.items()}

    def owners(self) -> dict[str, str]:
        """The document type of each section type that one profile alone has."""
        found: dict[str, set[str]] = {}
        for p in self.profiles:
            for s in p.sections:
                for n in (s.type, *s.aliases):
                    found.setdefault(n, set()).add(p.type)
        return {n: next(iter(of)) for n, of in found.items() if len(of) == 1}

    def shared(self) -> list[str]:
        """Section types that several profiles have."""
        return sorted({n for p in self.profiles for s in p.sections for n in (s.type, *s.aliases)} - self.owners().keys())

    def document_type(self, name: Column) -> Column:
        """FN-28: a document type's name as its type; a name that no profile has, as a slug."""
        n = slug(F.coalesce(name, F.lit("")))
        return F.coalesce(F.try_element_at(_map(self.document_names()), n), n)

    def section_type(self, name: Column) -> Column:
        """FN-28: a section type's name as its type; a name that no profile has, as a slug."""
        n = slug(F.coalesce(name, F.lit("")))
        return F.coalesce(F.try_element_at(_map(self.section_names()), n), n)

    def owner(self, section_type: Column) -> Column:
        """FN-27: the document type that a section type is of: the only profile that has it, or the document that it
        names itself; null where several have it, or none."""
        n = self.section_type(section_type)
        whole = F.try_element_at(_map(self.document_names()), n)
        return F.coalesce(F.try_element_at(_map(self.owners()), n), F.when(~n.isin(*self.shared()), whole) if self.shared() else whole)


# ---------------------------------------------------------------- names
def canonical(sections: DataFrame, profiles: Profiles) -> DataFrame:
    """FN-26: sections with their canonical section_type and `event`: what was changed, null if nothing.

    Names of section types become the type ("normalised"); a document type's name stays ("whole_document"), as a whole
    document may be one section; "unknown" stays; all else, "unsectioned" and blanks too, becomes "unknown"
    ("invalid" for those two, "drift" for others).
    """
    raw = F.coalesce("section_type", F.lit(""))
    new = profiles.section_type(F.col("section_type"))
    known, doc = new.isin(*{*profiles.section_names().values()}), new.isin(*{p.type for p in profiles.profiles})
    blank = F.lower(raw).isin(UNSECTIONED, "") | new.isin(UNSECTIONED, "")
    event = F.when(known, F.when(new != raw, "normalised")).when(doc, "whole_document").when(raw == UNKNOWN, None).when(blank, "invalid").otherwise("drift")
    return sections.withColumn("__new", F.when(known | doc, new).otherwise(UNKNOWN)).withColumn("event", event).withColumn("section_type", F.col("__new")).drop("__new")


def stamped(sections: DataFrame, profiles: Profiles, hints: list[str], hinted: str) -> DataFrame:
    """FN-27: sections whose blank document_type is filled in: `hinted` where the section type holds a hint, else its owner."""
    blank = F.coalesce("document_type", F.lit("")) == ""
    found = F.when(named_like(F.col("section_type"), hints), F.lit(hinted)).otherwise(profiles.owner(F.col("section_type")))
    return sections.withColumn("document_type", F.when(blank, F.coalesce(found, F.lit(""))).otherwise(F.col("document_type")))


# ---------------------------------------------------------------- issues
def _issue(df: DataFrame, kind: str, ids: Column, start: Column, end: Column, detail: Column) -> DataFrame:
    return df.select("doc_id", F.lit(kind).alias("kind"), ids.alias("section_ids"), start.cast("int").alias("start_page"), end.cast("int").alias("end_page"), detail.cast("string").alias("detail"))


def overlaps(sections: DataFrame) -> DataFrame:
    """DSL-18: doc_id, first, second, start_page and end_page of each pair of sections that share pages, first by (start, end, ordinal).

    Sections meet in blocks of 32 pages, each pair in one block only.
    """
    s = sections.where("start_page <= end_page").select("doc_id", "section_id", "ordinal", F.col("start_page").alias("start"), (F.col("end_page") + 1).alias("end"))
    met = interval_overlaps(s, s.withColumnsRenamed({"section_id": "other", "ordinal": "other_ordinal"}), ["doc_id"], 32)
    first = F.struct("a_start", "a_end", "ordinal") < F.struct("b_start", "b_end", "other_ordinal")
    return met.where(first).select("doc_id", F.col("section_id").alias("first"), F.col("other").alias("second"), F.greatest("a_start", "b_start").alias("start_page"), (F.least("a_end", "b_end") - 1).alias("end_page"))


def issues(sections: DataFrame, profiles: Profiles, totals: DataFrame, evidence: DataFrame, least_pages: int = 3) -> DataFrame:
    """DSL-18: doc_id, kind, section_ids, start_page, end_page and detail of all that is wrong with segmentations.

    overlap: sections that share pages. gap: pages of 1 to total that no section has, with the sections around it, and
    "same type" if they are of one. missing_required_section: a document type is there, a required section of it
    isn't (detail). no_kv_evidence: least_pages pages and more, of a known type, none of which has a key-value pair;
    documents without any pair aren't asked. type_mismatch: a section type that its document's profile hasn't.
    unknown_document_type, unknown_section_type: names that no profile has (detail). totals: doc_id, total. evidence:
    doc_id, page of key-value pairs. The work is that of equi-joins by document and page; no sections are paired but
    those that overlap.
    """
    s = sections.select(*COLUMNS)
    one, none = F.array("section_id"), F.array().cast("array<string>")
    nothing = F.lit(None)
    out = _issue(overlaps(s), "overlap", F.array("first", "second"), F.col("start_page"), F.col("end_page"), nothing)

    gaps = Q.uncovered(s, totals, ["doc_id"])
    around = Q.gap_neighbours(gaps, s.select("doc_id", F.to_json(F.struct("section_id", "section_type")).alias("section_id"), "start_page", "end_page"), ["doc_id"])
    side = lambda c: F.from_json(c, "section_id string, section_type string")
    around = around.withColumns({"b": side("before"), "a": side("after")})
    alike = (F.coalesce("b.section_type", F.lit("")) != "") & (F.col("b.section_type") == F.col("a.section_type"))
    out = out.unionByName(_issue(around, "gap", F.array_compact(F.array("b.section_id", "a.section_id")), F.col("start_page"), F.col("end_page"), F.when(alike, "same type")))

    kind, doc = F.trim(F.coalesce("section_type", F.lit(""))), F.trim(F.coalesce("document_type", F.lit("")))
    named = s.withColumns({"kind": kind, "doc": doc})
    wanted = {p.type: [x.type for x in p.sections if x.required] for p in profiles.profiles}
    lists = F.create_map(*[y for k, v in wanted.items() for y in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))]) if wanted else F.create_map().cast("map<string,array<string>>")
    lacking = named.where("doc <> ''").groupBy("doc_id", "doc").agg(F.collect_set("kind").alias("kinds")).select("doc_id", F.explode(F.array_except(F.try_element_at(lists, F.col("doc")), "kinds")).alias("lacks"))
    out = out.unionByName(_issue(lacking, "missing_required_section", none, nothing, nothing, F.col("lacks")))

    pages = evidence.where("page >= 1").select("doc_id", "page").distinct()
    asked = s.where((F.col("end_page") - F.col("start_page") + 1 >= least_pages) & ~F.col("section_type").eqNullSafe(UNKNOWN)).join(pages.select("doc_id").distinct(), "doc_id", "left_semi")
    seen = asked.select("doc_id", "ordinal", F.explode(F.sequence("start_page", "end_page")).alias("page")).join(pages, ["doc_id", "page"], "left_semi").select("doc_id", "ordinal").distinct()
    out = out.unionByName(_issue(asked.join(seen, ["doc_id", "ordinal"], "left_anti"), "no_kv_evidence", one, F.col("start_page"), F.col("end_page"), F.col("section_type")))

    valid = {p.type: sorted({p.type, *p.aliases, *(n for x in p.sections for n in (x.type, *x.aliases))}) for p in profiles.profiles}
    lists = F.create_map(*[y for k, v in valid.items() for y in (F.lit(k), F.array(*map(F.lit, v)))]) if valid else F.create_map().cast("map<string,array<string>>")
    odd = named.where((F.col("kind") != "") & (F.col("kind") != UNKNOWN) & ~F.array_contains(F.try_element_at(lists, F.col("doc")), F.col("kind")))
    out = out.unionByName(_issue(odd, "type_mismatch", one, F.col("start_page"), F.col("end_page"), F.col("kind")))

    new_doc, new_kind = profiles.document_type(F.col("document_type")), profiles.section_type(F.col("section_type"))
    docs, kinds = [p.type for p in profiles.profiles], [*{*profiles.section_names().values()}, *profiles.aliases]
    out = out.unionByName(_issue(s.where((F.coalesce("document_type", F.lit("")) != "") & ~new_doc.isin(*docs)), "unknown_document_type", one, nothing, nothing, F.col("document_type")))
    return out.unionByName(_issue(s.where((new_kind != "") & ~new_kind.isin(*kinds)), "unknown_section_type", one, nothing, nothing, F.col("section_type")))


# ---------------------------------------------------------------- the chain
def gaps_filled(sections: DataFrame, totals: DataFrame) -> DataFrame:
    """Sections, and one of type "unknown" for each run of pages of 1 to total that none has."""
    runs = Q.uncovered(sections, totals, ["doc_id"])
    span = lambda sep: F.concat(F.col("start_page").cast("string"), F.lit(sep), F.col("end_page").cast("string"))
    new = runs.select(
        "doc_id", (F.lit(1_000_000) + F.col("start_page")).cast(sections.schema["ordinal"].dataType).alias("ordinal"), F.concat(F.lit("unknown_pages_"), span("_")).alias("section_id"),
        F.concat(F.lit("Unclassified pages "), span("-")).alias("name"), F.lit(UNKNOWN).alias("section_type"), F.lit("").alias("document_type"), "start_page", "end_page",
    )
    return sections.select(*COLUMNS).unionByName(new)


def disjoint(sections: DataFrame, totals: DataFrame) -> DataFrame:
    """FN-25 and WIN-7: sections within 1 to total, each beginning after all before it end."""
    return Q.resolve_overlaps(Q.clamp(sections.select(*COLUMNS), totals, ["doc_id"]), ["doc_id"]).select(*COLUMNS)


def unique_sections(sections: DataFrame) -> DataFrame:
    """WIN-9: the n-th bearer of an id in a document gets _n."""
    return Q.unique_ids(sections.select(*COLUMNS), ["doc_id"]).withColumn("section_id", F.col("unique_id")).select(*COLUMNS)


def mended(sections: DataFrame, totals: DataFrame, profiles: Profiles, hints: list[str], hinted: str, enrich: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """DSL-16: a raw segmentation made whole: unique ids, pages within the packet, no overlaps, gaps filled, the sections
    that `enrich` drills into replaced (DSL-17, say) and made whole again, canonical types, documents stamped.

    (doc_id, ordinal) must be unique. Gaps that are filled have ordinals from 1 000 000 on.
    """
    whole = gaps_filled(disjoint(unique_sections(sections), totals), totals)
    if enrich:
        more = enrich(whole)
        place = F.row_number().over(Q._order(["doc_id"], "start_page").orderBy("start_page", "ordinal", F.coalesce("nth", F.lit(0)))).cast("int") if "nth" in more.columns else F.col("ordinal")
        whole = gaps_filled(disjoint(more.withColumn("ordinal", place).select(*COLUMNS), totals), totals)
        whole = unique_sections(whole)
    return stamped(canonical(whole, profiles), profiles, hints, hinted)
