"""What OCR marks in a page's Markdown: check boxes, handwriting, signatures, tables and formulas, and what they amount to (FN-16, FN-37, FN-42)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signatures import MARKER, marked_cells, signature_header

# Marks, and how sure each kind is.
_BOX = r"(☑|☐|✓|✗|✘|\[x\]|\[X\]|\[ \])"
_SELECTED = ["☑", "✓", "[x]", "[X]"]
_HAND = r"(?i)<!-- block_type:\s*(?:Handwriting|SectionHeader|Text)\s*-->"
_SIGNED = r"(?is)<!-- block_type:\s*Signature\s*-->(.*?)(?=<!--|$)"
_DISPLAY, _INLINE = r"\$\$([^$]+)\$\$", r"\$([^$]+)\$"
_TABLE = r"\|.+\|(?:\n\|.+\|)*"
_YES, _NO, _NA = r"(?i)\bYES\b", r"(?i)\bNO\b", r"(?i)\bN/?A\b|\bNOT\s+APPLICABLE\b"
SURE = {"mark": 0.9, "handwriting": 0.85, "signature": 0.85, "inline signature": 0.80, "formula": 0.9}


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def selection_marks(text: Column) -> Column:
    """FN-37: array of struct(mark, state) of a page's check boxes, in order."""
    found = F.regexp_extract_all(_text(text), F.lit(_BOX), F.lit(1))
    return F.transform(found, lambda m: F.struct(m.alias("mark"), F.when(m.isin(*_SELECTED), "selected").otherwise("unselected").alias("state")))


def handwritten_words(text: Column) -> Column:
    """FN-37: the words after the first block comment of handwriting, headers or text, in order; the comments are no words."""
    parts = F.split(_text(text), _HAND)
    return F.filter(F.flatten(F.transform(F.slice(parts, 2, 1_000_000), lambda p: F.split(_strip(p), r"\s+"))), lambda w: w != "")


def signature_marks(text: Column) -> Column:
    """FN-37: array of struct(label, confidence): signature blocks, labelled by what follows them, then inline markers,
    labelled by up to 60 characters before them, back to a cell's border; without such text "Signature"."""
    t = _text(text)
    label = lambda x, most: F.coalesce(F.nullif(F.substring(_strip(x), 1, most), F.lit("")), F.lit("Signature"))
    blocks = F.transform(F.regexp_extract_all(t, F.lit(_SIGNED), F.lit(1)), lambda x: F.struct(label(x, 120).alias("label"), F.lit(SURE["signature"]).alias("confidence")))
    parts = F.split(t, r"(?i)\[Signature\]")
    heads = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    before = F.transform(heads, lambda h: F.substring(h, F.greatest(F.length(h) - 59, F.lit(1)), F.lit(60)))
    cell = F.transform(before, lambda b: F.when(F.contains(b, F.lit("|")), F.element_at(F.split(b, r"\|", -1), -1)).otherwise(""))
    inline = F.transform(cell, lambda x: F.struct(label(x, 80).alias("label"), F.lit(SURE["inline signature"]).alias("confidence")))
    return F.concat(blocks, inline)


def table_sizes(text: Column) -> Column:
    """FN-37: array of struct(rows, columns): lines of each table but rules, and the first line's cells that say something."""

    def size(t: Column) -> Column:
        lines = F.filter(F.split(_strip(t), "\n"), lambda r: F.trim(r) != "")
        data = F.filter(lines, lambda r: ~r.rlike(r"^\|[\s\-:|]+\|$"))
        head = F.filter(F.split(F.get(lines, F.lit(0)), r"\|"), lambda c: F.trim(c) != "")
        return F.struct(F.size(data).alias("rows"), F.size(head).alias("columns"))

    return F.transform(F.regexp_extract_all(_text(text), F.lit(_TABLE), F.lit(0)), size)


def formulas(text: Column) -> Column:
    """FN-37: array of struct(kind, value): display formulas, and inline ones, looked for outside of those, whose value isn't there yet."""
    t = _text(text)
    trimmed = lambda x, p: F.transform(F.regexp_extract_all(x, F.lit(p), F.lit(1)), _strip)
    kind = lambda k: lambda v: F.struct(F.lit(k).alias("kind"), v.alias("value"))
    display = trimmed(t, _DISPLAY)
    inline = F.array_except(trimmed(F.regexp_replace(t, _DISPLAY, " "), _INLINE), F.array_append(display, F.lit("")))
    return F.concat(F.transform(display, kind("display")), F.transform(inline, kind("inline")))


def selection_summary(text: Column, marks: Column, placed: Column) -> Column:
    """FN-16: struct(selected, unselected, unknown, yes, no, na, tri_state, ambiguous, reasons) of a page's check boxes.

    marks: array of struct(state); placed: whether any of them has a place on the page. Ambiguous are selected boxes
    without a YES, NO or NA on the page, selected ones none of which has a place, and all three words with no box selected.
    """
    t, state = _text(text), F.transform(F.coalesce(marks, F.array().cast("array<struct<state:string>>")), lambda m: F.lower(F.coalesce(m["state"], F.lit(""))))
    count = lambda s: F.size(F.filter(state, lambda x: x == s))
    selected, unselected = count("selected"), count("unselected")
    yes, no, na = t.rlike(_YES), t.rlike(_NO), t.rlike(_NA)
    reasons = F.array_compact(
        F.array(
            F.when((selected > 0) & ~(yes | no | na), "selected_without_checklist_headers"),
            F.when((selected > 0) & ~F.coalesce(placed, F.lit(False)), "selected_marks_without_geometry"),
            F.when(yes & no & na & (selected == 0), "tri_state_headers_without_selected_marks"),
        )
    )
    return F.struct(
        selected.alias("selected"), unselected.alias("unselected"), (F.size(state) - selected - unselected).alias("unknown"), yes.alias("yes"), no.alias("no"), na.alias("na"),
        (yes & no & na).alias("tri_state"), (F.size(reasons) > 0).alias("ambiguous"), reasons.alias("reasons"),
    )


def signature_cells(pages: DataFrame, boxes: DataFrame, patterns: list[str], keys: list[str]) -> DataFrame:
    """FN-42: keys, table, row, column, text and x1, y1, x2, y2 of marked signature cells, from their tables' boxes divided evenly.

    pages: keys, text. boxes: keys, nth (from 0) and x1, y1, x2, y2 of the tables that OCR saw on a page, in order. The
    n-th table of the text that has a body stands in the n-th box; its header takes one row's height. Only cells of
    signature columns that hold the marker come back; empty boxes, and tables without a box, give none.

    A text is looked at once, and pages meet the boxes that they show by their keys alone.
    """
    has_marker = F.contains(F.lower("text"), F.lit(MARKER.lower()))
    cells = pages.where(has_marker).select(*keys, F.explode(marked_cells(F.col("text"))).alias("c")).select(*keys, "c.*")
    marked = cells.where(signature_header(F.col("header"), patterns) & has_marker)
    seen = boxes.where("x1 < x2 AND y1 < y2").groupBy(*keys).agg(F.collect_list(F.struct("nth", "x1", "y1", "x2", "y2")).alias("__boxes"))
    own = F.filter("__boxes", lambda b: b["nth"] == F.col("place"))
    j = marked.join(seen, keys).select(*keys, "table", "row", "column", "text", "rows", "columns", F.col("nth").alias("__nth"), F.explode(own).alias("b")).select("*", "b.*")
    w, h = (F.col("x2") - F.col("x1")) / F.greatest("columns", F.lit(1)), (F.col("y2") - F.col("y1")) / (F.col("rows") + 1)
    left, top = F.col("x1") + w * F.col("column"), F.col("y1") + h * F.col("__nth")
    return j.select(*keys, "table", "row", "column", "text", left.alias("x1"), top.alias("y1"), (left + w).alias("x2"), (top + h).alias("y2"))
