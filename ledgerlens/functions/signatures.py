"""Signatures in Markdown tables: a model of cells, and layers of evidence that mark cells as signed (FN-36).

A page's tables become cells with their place in the text. Each cell of a signature column goes through the layers
in order; the first that finds evidence names the cell's layer, and the cell gets a marker. All edits of a page are
folded over its text in one pass, so nothing is shuffled, and marked cells are left alone the next time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .edits import splice

MARKER = "[Signature]"
#: Characters of text beside dates up to which a cell may be a signature.
SHORT = 40

# How sure each layer is.
CONFIDENCE = {
    "L0": 0.85,
    "L1": 0.80,
    "L_IMG": 0.75,
    "L_IMG_PLACEHOLDER": 0.70,
    "L2": 0.65,
    "L_HWTEXT": 0.55,
    "L3": 0.45,
    "L_TEXT": 0.40,
    "L4": 0.30,
}

# What OCR writes, and what reviewers write where they don't sign.
_BLOCK = r"(?i)<!--\s*block_type:\s*Signature\s*-->"
_MARKED = r"(?i)\[Signature\]"
_IMAGE = r'(?i)<img\s+[^>]*data-bbox\s*=\s*"[^"]+"[^>]*>'
_ITALIC = r"(?i)<i\b[^>]*>"
_PLACEHOLDER = r"(?i)<p>\s*Image\s*:\s*signature\s*</p>"
_TAGS = r"(?i)</?(?:i|b|em|strong|br|span|p|div)\b[^>]*>"
_DATE = r"\b\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\b"
VERDICTS = [
    "ok", "okay", "pass", "passed", "fail", "failed", "na", "n/a", "n.a.", "nil", "none", "yes", "no", "y", "n",
    "approved", "approve", "rejected", "reject", "compliant", "non-compliant", "noncompliant", "satisfactory", "unsatisfactory",
    "done", "complete", "completed", "pending", "tbd", "tba",
]

_BORDER = re.compile(r"(?<!\\)\|")
_RULE = re.compile(r"\|[\s\-:|]+\|")


# ---------------------------------------------------------------- cells
def _cells_of_row(line: str, offset: int) -> list[tuple[int, int]]:
    """Where a table line's cells stand in the text, without their borders; \\| is none."""
    body = line.strip()
    begin = line.index(body) if body else 0
    end = begin + len(body)
    borders = [m.start() for m in _BORDER.finditer(line, begin, end)]
    if borders and borders[0] == begin:
        begin, borders = begin + 1, borders[1:]
    if borders and borders[-1] == end - 1:
        end, borders = end - 1, borders[:-1]
    return [(offset + a, offset + b) for a, b in zip([begin, *(x + 1 for x in borders)], [*borders, end], strict=True)]


def _tables(lines: list[str]) -> Iterator[tuple[int, list[int]]]:
    """The first line and the lines but rules of each table: a run of (stripped) lines that begin with a border, one of them a rule."""
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and lines[j].startswith("|"):
            j += 1
        rows = [k for k in range(i, j) if not _RULE.fullmatch(lines[k])]
        if rows and len(rows) < j - i:
            yield i, rows
        i = max(j, i + 1)


def cells_in(text: str | None) -> list[dict]:
    """FN-36: the cells of a text's tables: table, row (from the table's first line), column, start, end, header, text.

    A table is a run of lines that begin with a border, one of them a rule; its first other line is the header. The
    header's own cells have no header.
    """
    lines, out, at = (text or "").split("\n"), [], 0
    offsets = []
    for line in lines:
        offsets.append(at)
        at += len(line) + 1
    for table, (first, rows) in enumerate(_tables([x.strip() for x in lines])):
        names = None
        for k in rows:
            spans = _cells_of_row(lines[k], offsets[k])
            texts = [text[a:b] for a, b in spans]
            for c, ((a, b), x) in enumerate(zip(spans, texts, strict=True)):
                out.append({"table": table, "row": k - first, "column": c, "start": a, "end": b, "header": names[c] if names and c < len(names) else None, "text": x})
            names = names or texts
    return out


CELLS = "array<struct<table:int,row:int,column:int,start:int,end:int,header:string,text:string>>"


def table_cells(text: Column) -> Column:
    """FN-36: cells_in over a column, in Arrow batches."""

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(cells_in)

    return F.pandas_udf(each, CELLS)(text)


def _texts_of_row(body: str) -> list[str]:
    """The texts of a stripped table line's cells."""
    texts = _BORDER.split(body) if "\\" in body else body.split("|")
    if len(texts) > 1 and not texts[0]:
        texts = texts[1:]
    if len(texts) > 1 and not texts[-1]:
        texts = texts[:-1]
    return texts


def marked_in(text: str | None) -> list[dict]:
    """FN-42: the body cells of a text that hold the marker, each with its place among its table's rows and tables.

    nth is the cell's row among the table's rows (of `rows`, the header aside), `columns` the cells without a header,
    and `place` the table among those that have a body. Only marked cells are built, as pages hold many others.
    """
    lines, out, place, marker = [x.strip() for x in (text or "").split("\n")], [], 0, MARKER.lower()
    for table, (first, (head, *body)) in enumerate(_tables(lines)):
        if not body:
            continue
        names, marked = _texts_of_row(lines[head]), []
        columns = len(names)
        for nth, k in enumerate(body, 1):
            texts = _texts_of_row(lines[k])
            columns += max(0, len(texts) - len(names))
            if marker in lines[k].lower():
                marked += [(nth, k - first, c, name, x) for c, (name, x) in enumerate(zip(names, texts, strict=False)) if marker in x.lower()]
        out += [{"table": table, "row": row, "column": c, "header": name, "text": x, "nth": nth, "rows": len(body), "columns": columns, "place": place} for nth, row, c, name, x in marked]
        place += 1
    return out


_MARKED_CELLS = "array<struct<table:int,row:int,column:int,header:string,text:string,nth:int,rows:long,columns:long,place:int>>"


def marked_cells(text: Column) -> Column:
    """FN-42: marked_in over a column, in Arrow batches; only marked cells leave Python."""

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(marked_in)

    return F.pandas_udf(each, _MARKED_CELLS)(text)


# ---------------------------------------------------------------- what a cell says
def _folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def signature_header(header: Column, patterns: list[str]) -> Column:
    """Whether a column's header holds a pattern, white space and case aside."""
    name = F.lower(_folded(F.coalesce(header, F.lit(""))))
    wanted = sorted({" ".join(p.lower().split()) for p in patterns if p and p.strip()})
    hits = [F.contains(name, F.lit(p)) for p in wanted]
    return F.exists(F.array(*hits), lambda x: x) if hits else F.lit(False)


def bare(cell: Column) -> Column:
    """A cell without tags and outer white space."""
    return F.regexp_replace(F.regexp_replace(cell, _TAGS, ""), r"^\s+|\s+$", "")


def said(cell: Column) -> Column:
    """What a cell says beside dates, tags and fillers; empty if nothing."""
    text = F.replace(F.regexp_replace(F.regexp_replace(cell, _TAGS, ""), _DATE, ""), F.lit("&nbsp;"), F.lit(" "))
    return F.regexp_replace(text, r"^[ \-—|<>/\t\n\r]+|[ \-—|<>/\t\n\r]+$", "")


def is_filler(cell: Column) -> Column:
    """Nothing, or dashes, underscores and dots alone: a signature that is missing."""
    return bare(cell).rlike(r"^[-—_.]*$")


def is_date_only(cell: Column) -> Column:
    """A date, and nothing else but fillers."""
    text = bare(cell)
    return text.rlike(_DATE) & F.regexp_replace(text, _DATE, "").rlike(r"^[\s\-—_.|]*$")


# ---------------------------------------------------------------- layers
def layers(page_layer: Column) -> list[tuple[str | Column, Callable[[Column, Column], Column]]]:
    """(outcome, test of a cell without placeholders and of whether it had one), in order: the first that holds names it.

    Outcomes that are no layers ("marked", "filler", "verdict", "long", "nothing") leave a cell as it is.
    """
    return [
        ("marked", lambda c, had: c.rlike(_MARKED)),
        ("L_IMG_PLACEHOLDER", lambda c, had: had),
        ("L_IMG", lambda c, had: c.rlike(_IMAGE)),
        ("filler", lambda c, had: is_filler(c)),
        ("verdict", lambda c, had: F.lower(said(c)).isin(*VERDICTS)),
        ("L_HWTEXT", lambda c, had: c.rlike(_ITALIC) & (said(c) != "")),
        (page_layer, lambda c, had: page_layer.isNotNull() & is_date_only(c)),
        ("L_TEXT", lambda c, had: F.length(said(c)).between(1, SHORT)),
        ("long", lambda c, had: said(c) != ""),
    ]


def outcome(cell: Column, had: Column, page_layer: Column) -> Column:
    """The outcome of a cell of a signature column."""
    tests = layers(page_layer)
    out = F.when(tests[0][1](cell, had), tests[0][0])
    for name, test in tests[1:]:
        out = out.when(test(cell, had), name)
    return out.otherwise("nothing")


def judged_cells(pages: DataFrame, patterns: list[str], aggressive: bool = True) -> DataFrame:
    """pages with `cells`: those of signature columns, each with had (a placeholder), bare (without it), outcome and new (its text).

    pages: text, has_signature and has_handwriting (whether OCR saw such blocks on the page), and any other columns.
    A date alone is evidence by the page's: L2 where OCR saw a signature, L3 handwriting, else L4, if aggressive.
    Where not, a page without such blocks and without images isn't judged at all.
    """
    seen = F.coalesce("has_signature", F.lit(False)), F.coalesce("has_handwriting", F.lit(False))
    of_page = F.when(seen[0], "L2").when(seen[1], "L3").when(F.lit(aggressive), "L4")
    judge = F.lit(aggressive) | seen[0] | seen[1] | F.coalesce("text", F.lit("")).rlike(_IMAGE)
    own = F.filter(table_cells(F.col("text")), lambda c: c["header"].isNotNull() & signature_header(c["header"], patterns))
    df = pages.withColumn("__layer", of_page).withColumn("cells", own).withColumn("cells", F.when(judge, F.col("cells")).otherwise(F.array().cast(CELLS)))

    def judged(c: Column) -> Column:
        had = c["text"].rlike(_PLACEHOLDER)
        plain = F.when(had, F.concat(F.lit(" "), _folded(F.regexp_replace(c["text"], _PLACEHOLDER, "")), F.lit(" "))).otherwise(c["text"])
        return F.struct(*[c[n].alias(n) for n in ("table", "row", "column", "start", "end", "text")], had.alias("had"), plain.alias("bare"), outcome(plain, had, F.col("__layer")).alias("outcome"))

    def marked(c: Column) -> Column:
        inner = F.regexp_replace(c["bare"], r"^\s+|\s+$", "")
        new = F.when(c["outcome"].isin(*CONFIDENCE), F.concat(F.lit(f" {MARKER} "), F.when(inner != "", F.concat(inner, F.lit(" "))).otherwise(""))).otherwise(c["bare"])
        return F.struct(*[c[n].alias(n) for n in ("table", "row", "column", "start", "end", "text", "had", "outcome")], new.alias("new"))

    return df.withColumn("cells", F.transform("cells", judged)).withColumn("cells", F.transform("cells", marked)).drop("__layer")


_JUDGED = "array<struct<start:int,end:int,text:string,outcome:string>>"
_APPLIED = "enriched string, outcomes array<struct<name:string,n:int>>"


def _applied(text: Column, cells: Column) -> Column:
    """struct(enriched, outcomes) of a text and its judged cells: its edits folded over it, and the cells' outcomes counted.

    Both come from one look at the cells, which would else be judged anew for each count.
    """

    def each(texts: pd.Series, all_cells: pd.Series) -> pd.DataFrame:
        out = []
        for t, cs in zip(texts, all_cells, strict=True):
            cs = [] if cs is None else list(cs)
            n = Counter(c["outcome"] for c in cs)
            out.append((splice(t, [c for c in cs if c["text"] is not None]), [{"name": k, "n": v} for k, v in n.items()]))
        return pd.DataFrame(out, columns=["enriched", "outcomes"])

    return F.pandas_udf(each, _APPLIED)(text, cells.cast(_JUDGED))


def enriched(pages: DataFrame, patterns: list[str], aggressive: bool = True, enabled: bool = True) -> DataFrame:
    """FN-36: pages with `enriched` (their text with markers), `counts` (a map of layers and skips) and `injected`.

    counts: L0 and L1 are what was there before; marked, verdict and long count cells left alone, each other name
    the markers written by that layer (L_IMG_PLACEHOLDER: also placeholders taken from marked cells). Not enabled, or
    without patterns: the text as it is, and L0 and L1 alone. Doing it again changes nothing.
    """
    before = {"L0": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_BLOCK)), "L1": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_MARKED))}
    df = judged_cells(pages, patterns if enabled else [], aggressive)
    # A marked cell from which a placeholder goes is "cleaned".
    judged = F.transform(
        "cells",
        lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), F.when(c["new"] != c["text"], c["new"]).alias("text"),
            F.when((c["outcome"] == "marked") & c["had"], "cleaned").otherwise(c["outcome"]).alias("outcome"),
        ),
    )
    df = df.withColumn("__x", _applied(F.col("text"), judged)).drop("cells")
    found = F.map_from_entries(F.col("__x.outcomes"))
    n = lambda name: F.coalesce(F.try_element_at(found, F.lit(name)), F.lit(0))
    names = [k for k in CONFIDENCE if k not in before]
    each = {k: n(k) for k in [*names, "verdict", "long", "marked"]}
    injected = sum((each[k] for k in names), F.lit(0))
    each["L_IMG_PLACEHOLDER"] = each["L_IMG_PLACEHOLDER"] + n("cleaned")
    counts = F.create_map(*[x for k, v in (before | each).items() for x in (F.lit(k), v)])
    return df.select(*[c for c in df.columns if c != "__x"], F.col("__x.enriched").alias("enriched"), counts.alias("counts"), injected.alias("injected"))
