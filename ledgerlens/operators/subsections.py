"""Sections inside sections: which range holds which, and sections drilled into the sub-sections their pages show."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sections as S
from . import sequences as Q

#: The section of pages before the first heading.
UNSECTIONED = "unsectioned"


def containment_tree(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ordinal, start_page, end_page, parent, depth and root of page ranges.

    In the order (start, longer first, ordinal) a range's parent is the last one before it that holds it whole; a
    range that only overlaps is no parent, and of equal ranges the earlier holds the later. depth counts the
    ancestors, root is the topmost (the range itself where it has no parent). Empty ranges are left out.

    The rows of a partition come sorted by `keys` and that order, and one pass walks them packet after packet: of the
    ranges before a row, only those that end no earlier than all after them can still hold something, so a batch and
    this chain of holders is all that it keeps. Ranges with a null key stand alone.
    """
    import pyarrow as pa

    r = ranges.where("start_page <= end_page").select(*keys, "ordinal", "start_page", "end_page")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chain = None, []
        for b in batches:
            parents, depths, roots = [], [], []
            for key, ordinal, end in zip(zip(*[b.column(k).to_pylist() for k in keys], strict=True), b.column("ordinal").to_pylist(), b.column("end_page").to_pylist(), strict=True):
                if key != at or None in key:
                    at, chain = key, []
                while chain and chain[-1][1] < end:
                    chain.pop()
                parents.append(chain[-1][0] if chain else None)
                depths.append(len(chain))
                chain.append((ordinal, end))
                roots.append(chain[0][0])
            kind = b.schema.field("ordinal").type
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parents, kind), pa.array(depths, pa.int32()), pa.array(roots, kind)], names=[*b.schema.names, "parent", "depth", "root"])

    kind = dict(r.dtypes)
    schema = ", ".join(f"`{c}` {k}" for c, k in r.dtypes) + f", parent {kind['ordinal']}, depth int, root {kind['ordinal']}"
    return r.repartition(*keys).sortWithinPartitions(*keys, "start_page", F.desc("end_page"), "ordinal").mapInArrow(walk, schema)


def named_like(name: Column, hints: list[str]) -> Column:
    """Whether a name holds a hint, without regard to case; null and blank hold none."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(low, F.lower(h)))


def is_parent(hints: list[str], kinds: list[str]) -> Column:
    """DSL-17: sections to drill into: the type holds a hint, or the id does and the type is none of the sub-sections' own."""
    own = F.coalesce(F.col("section_type"), F.lit("")).isin(*kinds)
    return named_like(F.col("section_type"), hints) | ~own & named_like(F.col("section_id"), hints)


def detected_spans(parents: DataFrame, pages: DataFrame, spec: list[S.Section]) -> DataFrame:
    """FN-23, WIN-2 and WIN-1 within each parent: doc_id, ordinal, section_type, start_page, end_page and nth (the span's place).

    Pages count from 1 inside a parent, so a first page is one wherever it stands in the packet. Pages without text
    and without a heading go on with the section before them. A parent without any heading gives no spans.
    """
    key = F.struct("doc_id", "ordinal")
    within = parents.select("doc_id", "ordinal", "start_page", "end_page", F.explode(F.sequence("start_page", "end_page")).alias("page")).join(pages, ["doc_id", "page"], "left")
    local = within.select(key.alias("doc_id"), (F.col("page") - F.col("start_page") + 1).alias("page"), (F.col("start_page") - 1).alias("shift"), F.coalesce("text", F.lit("")).alias("text"))
    found = S.section_candidates(S.page_lines(local), spec)
    picked = Q.pick_candidates(found, ["doc_id"])
    marked = local.select("doc_id", "page", "shift").join(picked.withColumnRenamed("section_id", "found"), ["doc_id", "page"], "left").withColumnRenamed("found", "section_id")
    any_hit = F.max(F.col("section_id").isNotNull()).over(Window.partitionBy("doc_id"))
    marked = marked.withColumn("any", any_hit).where("any")
    spans = Q.assemble_spans(marked, ["doc_id", "shift"])
    return spans.select("doc_id.*", F.col("section_id").alias("section_type"), (F.col("start_page") + F.col("shift")).alias("start_page"), (F.col("end_page") + F.col("shift")).alias("end_page"), F.col("span").alias("nth"))


def with_sub_sections(sections: DataFrame, pages: DataFrame, proposed: DataFrame, spec: list[S.Section], hints: list[str], document_type: str) -> DataFrame:
    """DSL-17: the sections, each parent replaced by the sub-sections found in it.

    sections: doc_id, ordinal, section_id, name, section_type, document_type, start_page, end_page. pages: doc_id,
    page, text. proposed (by a model, say): doc_id, ordinal (the parent's), nth, section_type, name, page.
    Of a parent's spans the first of each type counts, and proposals only for types that no span has (SET-6); a
    proposal is one page, brought into the parent's range, its first page where it names none. The run before the
    first heading is an "unsectioned" sub-section. Parents with neither stay whole, other sections pass through.

    The columns come back, with `parent` (the section drilled into, else null) and `nth` (the place in it). New ids
    are parent__type, from the second bearer in a document on with __n. Doing it twice changes nothing, as
    sub-sections' types are no parents.
    """
    kinds = [s.id for s in spec] + [UNSECTIONED]
    columns = ["doc_id", "ordinal", "section_id", "name", "section_type", "document_type", "start_page", "end_page"]
    marked = sections.select(*columns).withColumn("__drill", is_parent(hints, kinds) & (F.col("start_page") <= F.col("end_page")))
    parents = marked.where("__drill")
    titles = F.create_map(*[F.lit(x) for s in spec for x in (s.id, s.name)])
    spans = detected_spans(parents, pages, spec).select("doc_id", "ordinal", F.lit(0).alias("__by"), "nth", "section_type", F.try_element_at(titles, F.col("section_type")).alias("__title"), "start_page", "end_page")
    bounds = parents.select("doc_id", "ordinal", F.col("start_page").alias("__low"), F.col("end_page").alias("__high"))
    page = F.least(F.greatest(F.coalesce("page", "__low"), F.col("__low")), F.col("__high"))
    offered = proposed.where("section_type <> ''").join(bounds, ["doc_id", "ordinal"]).select(
        "doc_id", "ordinal", F.lit(1).alias("__by"), "nth", "section_type", F.col("name").alias("__title"), page.alias("start_page"), page.alias("end_page")
    )
    order = F.struct("__by", "nth", "start_page")
    rest = F.struct("__by", "nth", "__title", "start_page", "end_page")
    first = spans.unionByName(offered).groupBy("doc_id", "ordinal", "section_type").agg(F.min_by(rest, order).alias("x")).select("doc_id", "ordinal", F.col("section_type").alias("__type"), "x.*")
    place = F.row_number().over(Window.partitionBy("doc_id", "ordinal").orderBy("__by", "nth", "start_page", "__type"))
    subs = first.select("doc_id", "ordinal", "__type", "__title", F.struct("start_page", "end_page").alias("__range"), place.alias("nth"))
    joined = marked.join(subs, ["doc_id", "ordinal"], "left")
    sub = F.col("nth").isNotNull()
    base = F.when(sub, F.concat_ws("__", "section_id", "__type")).otherwise(F.col("section_id"))
    out = joined.select(
        "doc_id", "ordinal", base.alias("__base"), F.when(sub, F.coalesce(F.nullif("__title", F.lit("")), "name")).otherwise(F.col("name")).alias("name"),
        F.when(sub, F.col("__type")).otherwise(F.col("section_type")).alias("section_type"), F.when(sub, F.lit(document_type)).otherwise(F.col("document_type")).alias("document_type"),
        F.when(sub, F.col("__range.start_page")).otherwise(F.col("start_page")).alias("start_page"), F.when(sub, F.col("__range.end_page")).otherwise(F.col("end_page")).alias("end_page"),
        F.when(sub, F.col("section_id")).alias("parent"), "nth",
    )
    bearer = F.row_number().over(Window.partitionBy("doc_id", "__base").orderBy("ordinal", F.coalesce("nth", F.lit(0))))
    unique = F.when(F.col("nth").isNotNull() & (F.col("__n") > 1), F.concat_ws("__", "__base", "__n")).otherwise(F.col("__base"))
    return out.withColumn("__n", bearer).select("doc_id", "ordinal", unique.alias("section_id"), *columns[3:], "parent", "nth")
