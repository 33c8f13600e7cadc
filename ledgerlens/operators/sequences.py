"""Sequence operators over ordered pages and page ranges."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import packet_page


def _order(keys: list[str], by: str):
    return Window.partitionBy(*keys).orderBy(by)


def assemble_spans(pages: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-1: runs of pages (page, section_id or null) with the section carried forward; a leading run is "unsectioned"."""
    w = _order(keys, "page")
    carried = F.coalesce(F.last("section_id", ignorenulls=True).over(w), F.lit("unsectioned"))
    p = pages.select(*keys, "page", carried.alias("section_id"))
    new = F.when(F.col("section_id").eqNullSafe(F.lag("section_id").over(w)), 0).otherwise(1)
    return (
        p.withColumn("new", new).withColumn("span", F.sum("new").over(w)).groupBy(*keys, "span", "section_id")
        .agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"))
    )


def islands(pages: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-5: runs of consecutive pages."""
    p = pages.select(*keys, "page").distinct()
    p = p.withColumn("island", F.col("page") - F.row_number().over(_order(keys, "page")))
    return p.groupBy(*keys, "island").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page")).drop("island")


def missing_pages(pages: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """SET-2, WIN-5: runs of the pages 1 to total that aren't covered. totals: keys, total."""
    every = totals.where("total >= 1").select(*keys, F.explode(F.sequence(F.lit(1), F.col("total"))).alias("page"))
    return islands(every.join(pages.select(*keys, "page").distinct(), [*keys, "page"], "left_anti"), keys)


def uncovered(ranges: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-5: missing_pages() of pages given as ranges (keys, start_page, end_page), which aren't unfolded: by start, a run
    of pages begins after all ranges before it end. totals: keys, total; of several the largest counts."""
    kind = totals.schema["total"].dataType
    none = F.lit(None).cast(kind)
    ends = totals.where("total >= 1").groupBy(*keys).agg(F.max("total").alias("__total")).select(*keys, (F.col("__total") + 1).alias("__at"), none.alias("__to"), "__total")
    held = ranges.where("start_page <= end_page").select(*keys, F.col("start_page").alias("__at"), F.col("end_page").alias("__to"), none.alias("__total"))
    w = Window.partitionBy(*keys)
    # The total's row goes before ranges that begin right after it, as these would else hide the run that it ends.
    before = w.orderBy("__at", F.desc_nulls_last("__total")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest(F.coalesce(F.max("__to").over(before), F.lit(0)) + 1, F.lit(1))
    runs = ends.unionByName(held).withColumns({"start_page": start.cast(kind), "end_page": (F.col("__at") - 1).cast(kind), "__most": F.max("__total").over(w)})
    # What begins beyond the total ends no run; the total itself does.
    return runs.where((F.col("start_page") <= F.col("end_page")) & (F.col("__total").isNotNull() | (F.col("__at") <= F.col("__most")))).select(*keys, "start_page", "end_page")


def format_pages(pages: DataFrame, keys: list[str], min_run: int = 3) -> DataFrame:
    """WIN-6: positive pages as text, runs of min_run and more as "a to b"."""
    runs = islands(pages.where("page > 0"), keys)
    piece = F.when(F.col("end_page") - F.col("start_page") + 1 >= min_run, F.concat_ws(" to ", "start_page", "end_page")).otherwise(
        F.array_join(F.sequence("start_page", "end_page"), ", ")
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_page", piece.alias("piece")))), lambda x: x["piece"]), ", ")
    return runs.groupBy(*keys).agg(text.alias("pages"))


def resolve_overlaps(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-7: by start, each range begins after all before it end; those swallowed whole are dropped."""
    w = Window.partitionBy(*keys).orderBy("start_page", "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest(F.col("start_page"), F.coalesce(F.max("end_page").over(w) + 1, F.col("start_page")))
    return ranges.withColumn("start_page", start).where("start_page <= end_page")


def clamp(ranges: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """FN-25: ranges clipped to [1, total]; empty ones dropped."""
    j = ranges.join(totals, keys)
    return j.withColumn("start_page", F.greatest("start_page", F.lit(1))).withColumn("end_page", F.least("end_page", "total")).where("start_page <= end_page").drop("total")


def decompose(pages: DataFrame, keys: list[str], least: float = 0.22, tokens: int = 3) -> DataFrame:
    """WIN-3: pages with why a section begins at them (else null), how sure that is, and the section's number.

    pages: page, x and y (the page's counter "x of y", null without), lines (its header's) and tokens (their words).
    The first page begins one ("initial_section", 1); so does a counter that is 1 again after one beyond 1, or with
    another total ("page_counter_reset", .92); and a header of `tokens` and more words whose likeness to the last
    header before it (as sets; an empty one is like none) is under `least` ("header_signature_shift", .76).
    """
    w = _order(keys, "page")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("x").isNotNull(), F.struct("x", "y")), ignorenulls=True).over(before)
    header = F.coalesce(F.last(F.when(F.size("lines") > 0, F.col("tokens")), ignorenulls=True).over(before), F.array().cast("array<string>"))
    p = pages.withColumns({"__nth": F.row_number().over(w), "__last": last, "__header": header})
    alike = F.coalesce(F.try_divide(F.size(F.array_intersect("tokens", "__header")), F.size(F.array_union("tokens", "__header"))), F.lit(1.0))
    why = (
        F.when(F.col("__nth") == 1, "initial_section")
        .when((F.col("x") == 1) & ((F.col("__last.x") > 1) | (F.col("__last.y") != F.col("y"))), "page_counter_reset")
        .when((F.size("tokens") >= tokens) & (alike < least), "header_signature_shift")
    )
    sure = F.when(F.col("why") == "initial_section", 1.0).when(F.col("why") == "page_counter_reset", 0.92).when(F.col("why") == "header_signature_shift", 0.76)
    p = p.withColumn("why", why).withColumn("confidence", sure)
    return p.withColumn("section", F.count("why").over(w)).drop("__nth", "__last", "__header")


def packet_sections(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """WIN-3: keys, section, section_id, name, start_page, end_page, confidence and why of packets' pages (keys, page, text).

    A section is named after its first page's heading, else its first header line, else its number.
    """
    read = pages.select(*keys, "page", packet_page(F.col(text)).alias("p")).select(*keys, "page", "p.*")
    cut = decompose(read, keys)
    first = F.min_by(F.struct("heading", F.get("lines", F.lit(0)).alias("line"), "confidence", "why"), "page").alias("f")
    s = cut.groupBy(*keys, "section").agg(F.min("page").alias("start_page"), F.max("page").alias("__last"), first)
    end = F.coalesce(F.lead("start_page").over(_order(keys, "section")) - 1, F.col("__last"))
    number = F.lpad(F.col("section").cast("string"), 3, "0")
    name = F.substring(F.coalesce("f.heading", "f.line", F.concat(F.lit("section_"), number)), 1, 120)
    return s.select(*keys, "section", F.concat(F.lit("pkt_sec_"), number).alias("section_id"), name.alias("name"), "start_page", end.alias("end_page"), "f.confidence", "f.why")


def boundary_units(pages: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-4: units of pages "x of y": x = 1 opens one, which goes on while y is the same and x grows; a page that
    breaks it, and those after it up to the next x = 1, belong to none."""
    w = _order(keys, "page")
    p = pages.where("x IS NOT NULL").withColumn("unit", F.sum(F.when(F.col("x") == 1, 1).otherwise(0)).over(w)).where("unit > 0")
    u = _order([*keys, "unit"], "page")
    breaks = (F.col("x") != 1) & ((F.col("y") != F.lag("y").over(u)) | (F.col("x") <= F.lag("x").over(u)))
    p = p.withColumn("broken", F.max(F.when(breaks, 1).otherwise(0)).over(u)).where("broken = 0")
    return p.groupBy(*keys, "unit").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.first("y").alias("of"), F.count("*").alias("n"))


def split_by_unit(sections: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-8: the pieces of sections that reach over two units or more: per unit the largest piece, of equal ones the first."""
    pages = sections.select(*keys, "section_id", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    of = units.select(*keys, "unit", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    runs = islands(pages.join(of, [*keys, "page"]), [*keys, "section_id", "unit"])
    best = runs.groupBy(*keys, "section_id", "unit").agg(
        F.max_by(F.struct("start_page", "end_page"), F.struct(F.col("end_page") - F.col("start_page"), -F.col("start_page"))).alias("piece")
    )
    several = best.groupBy(*keys, "section_id").agg(F.count("*").alias("units")).where("units >= 2")
    return best.join(several, [*keys, "section_id"]).select(*keys, "section_id", "unit", "piece.*")


def unique_ids(sections: DataFrame, keys: list[str], name: str = "section_id") -> DataFrame:
    """WIN-9: `unique_id`: the n-th bearer of an id gets _n, the next free number where that id is taken.

    A sequential choice, as a first bearer may find its own id given away. The rows of a partition come sorted by
    `keys`, ordinal and id, and one pass names them group after group (a document's sections): a batch and the ids of
    one group are all that it holds. All columns come back.
    """
    import pyarrow as pa

    def name_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, counts = None, set(), {}
        for b in batches:
            out = []
            for key, x in zip(zip(*[b.column(k).to_pylist() for k in keys], strict=True), b.column(name).to_pylist(), strict=True):
                if key != at:
                    at, seen, counts = key, set(), {}
                n = counts.get(x, 0) + 1
                new = x if n == 1 else f"{x}_{n}"
                while new in seen:
                    n += 1
                    new = f"{x}_{n}"
                counts[x] = n
                seen.add(new)
                out.append(new)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "unique_id"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in sections.dtypes) + ", unique_id string"
    return sections.repartition(*keys).sortWithinPartitions(*keys, "ordinal", name).mapInArrow(name_all, schema)


def pick_candidates(candidates: DataFrame, keys: list[str], least: float = 0.6) -> DataFrame:
    """WIN-2: each page's section: its best candidate, but where that is the section chosen before it, the first other one
    of confidence `least` or more. A recursive choice, folded over a document's pages in Catalyst.

    candidates: page, section_id, confidence, rank (order of equal confidences).
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "rank", "section_id")))
    pages = candidates.groupBy(*keys, "page").agg(ordered.alias("options"))
    doc = pages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page", "options"))).alias("pages"))
    kind = "array<struct<page:int,section_id:string>>"

    def choose(done: Column, page: Column) -> Column:
        last = F.when(F.size(done) > 0, F.element_at(done, -1)["section_id"])
        others = F.filter(page["options"], lambda o: ~o["section_id"].eqNullSafe(last) & (-o["c"] >= least))
        best = page["options"][0]["section_id"]
        chosen = F.when(best.eqNullSafe(last) & (F.size(others) > 0), F.get(others, 0)["section_id"]).otherwise(best)
        return F.concat(done, F.array(F.struct(page["page"].cast("int").alias("page"), chosen.alias("section_id"))))

    return doc.select(*keys, F.explode(F.aggregate("pages", F.array().cast(kind), choose)).alias("x")).select(*keys, "x.*")


def route_pages(pages: DataFrame, keys: list[str], auto_at: float = 0.9, batch_at: float = 0.7) -> DataFrame:
    """WIN-10: auto (priority 999), batch (required so far + 100) or required (running number) by confidence."""
    w = _order(keys, "page")
    route = F.when(F.col("confidence") >= auto_at, "auto").when(F.col("confidence") >= batch_at, "batch").otherwise("required")
    so_far = F.sum(F.when(F.col("route") == "required", 1).otherwise(0)).over(w)
    return pages.withColumn("route", route).withColumn(
        "priority", F.when(F.col("route") == "auto", 999).when(F.col("route") == "batch", so_far + 100).otherwise(so_far)
    )


def gap_neighbours(gaps: DataFrame, sections: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-11: the nearest section that ends before each gap and the nearest that starts after it (an as-of join both ways).

    Union and two ordered scans instead of a range join.
    """
    g = gaps.select(*keys, F.col("start_page").alias("at"), F.lit(None).cast("string").alias("section_id"), "start_page", "end_page", F.lit(1).alias("gap"))
    ends = sections.select(*keys, F.col("end_page").alias("at"), "section_id", F.lit(None).cast("int").alias("start_page"), F.lit(None).cast("int").alias("end_page"), F.lit(0).alias("gap"))
    starts = sections.select(*keys, F.col("start_page").alias("at"), "section_id", F.lit(None).cast("int").alias("start_page"), F.lit(None).cast("int").alias("end_page"), F.lit(0).alias("gap"))
    before = Window.partitionBy(*keys).orderBy("at", "gap", "section_id").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("at"), "gap", F.desc("section_id")).rowsBetween(Window.unboundedPreceding, -1)
    a = g.unionByName(ends).withColumn("before", F.last("section_id", ignorenulls=True).over(before)).where("gap = 1")
    b = g.unionByName(starts).withColumn("after", F.last("section_id", ignorenulls=True).over(after)).where("gap = 1")
    return a.select(*keys, "start_page", "end_page", "before").join(b.select(*keys, "start_page", "end_page", "after"), [*keys, "start_page", "end_page"])


def latest_active(log: DataFrame, key: str, id_: str, supersedes: str, at: str) -> DataFrame:
    """WIN-12: the latest log row a key that no other row supersedes; of equal times the first by id."""
    live = log.join(log.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(id_)).distinct(), id_, "left_anti")
    w = Window.partitionBy(key).orderBy(F.desc(at), id_)
    return live.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


_SPACE = " \t\r\n\f\x0b"


def repeating_headers(pages: DataFrame, keys: list[str], first: int = 3, longer: int = 5, least: int = 3) -> DataFrame:
    """WIN-13: lines among the first `first` of a page's trimmed text, without heading marks, of more than `longer`
    characters, that occur `least` times or more, with their count. pages: keys and text."""
    trim = lambda x, what: F.btrim(x, F.lit(what))
    head = F.slice(F.split(trim(F.col("text"), _SPACE), "\n"), 1, first)
    lines = pages.select(*keys, F.explode(head).alias("line")).withColumn("line", trim(trim(trim(F.col("line"), _SPACE), "#"), _SPACE))
    return lines.where(F.length("line") > longer).groupBy(*keys, "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def heading_sections(lines: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-14: from each heading to the line before the next. lines: line, text, heading boolean."""
    h = lines.where("heading").select(*keys, "line", "text")
    last = lines.groupBy(*keys).agg(F.max("line").alias("__last"))
    end = F.lead("line").over(_order(keys, "line")) - 1
    return h.withColumn("end_line", end).join(last, keys).withColumn("end_line", F.coalesce("end_line", "__last")).drop("__last")


def truncation(covered: DataFrame, totals: DataFrame, keys: list[str], least: float = 0.97) -> DataFrame:
    """WIN-15: documents whose covered pages make up less than `least`, with the first page that isn't covered."""
    have = covered.select(*keys, "page").distinct().groupBy(*keys).agg(F.count("*").alias("n"))
    gaps = missing_pages(covered, totals, keys).groupBy(*keys).agg(F.min("start_page").alias("first_missing"))
    j = totals.join(have, keys, "left").join(gaps, keys, "left").withColumn("coverage", F.coalesce("n", F.lit(0)) / F.col("total"))
    return j.where(F.col("coverage") < least).select(*keys, "coverage", "first_missing")


def page_ranges(totals: DataFrame, keys: list[str], chunk: int = 50) -> DataFrame:
    """SRC-12: fixed chunks of pages."""
    n = F.ceil(F.col("total") / chunk).cast("int")
    out = totals.where("total >= 1").select(*keys, "total", F.posexplode(F.sequence(F.lit(1), n)).alias("chunk", "__c"))
    start = (F.col("chunk") * chunk + 1).cast("int")
    return out.select(*keys, "chunk", start.alias("start_page"), F.least(start + chunk - 1, F.col("total")).cast("int").alias("end_page"))
