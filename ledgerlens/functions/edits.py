"""Edits of texts by offsets, and pages cut from a document's text with their tables written anew (FN-43)."""

from __future__ import annotations

from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.grid import interval_overlaps

#: The edits of a text: characters start (from 0) to end, without end, become text.
EDITS = "array<struct<start:int,end:int,text:string>>"


def splice(text: str | None, edits: list[dict] | None) -> str | None:
    """FN-43: a text after its edits, folded over them in order of (start, end), in one pass.

    Edits that begin before the one before them ends are left out, those beyond the text's ends brought into it.
    An edit of no characters inserts; several at one place do so in the order given.
    """
    if text is None or edits is None:
        return text
    out, at = [], 0
    for e in sorted((e for e in edits if e is not None), key=lambda e: (e["start"], e["end"])):
        start, end = max(e["start"], 0), min(e["end"], len(text))
        if start < at or start > end:
            continue
        out += [text[at:start], e["text"] or ""]
        at = end
    return "".join([*out, text[at:]])


def spliced(text: Column, edits: Column) -> Column:
    """FN-43 over columns, in Arrow batches."""

    def each(texts: pd.Series, all_edits: pd.Series) -> pd.Series:
        return pd.Series([splice(t, None if e is None else list(e)) for t, e in zip(texts, all_edits, strict=True)], dtype=object)

    return F.pandas_udf(each, "string")(text, edits.cast(EDITS))


def page_texts(contents: DataFrame, pages: DataFrame, tables: DataFrame) -> DataFrame:
    """FN-43: doc_id, page and text: the pages of documents' texts, their tables replaced by what is written for them there.

    contents: doc_id, content. pages: doc_id, page, start, end: where a page stands in the content (without end). tables:
    doc_id, page, start, end, html: where a table stands, and how one page shows it; a table that reaches over
    pages has a row for each, and is cut at their ends. A page's table without html goes. Pages without characters are left out.
    """
    p = pages.where("start < end").select("doc_id", "page", "start", "end")
    met = interval_overlaps(p.select("doc_id", "start", "end", "page"), tables.where("start < end").select("doc_id", F.col("page").alias("of"), "start", "end", "html"), ["doc_id"])
    own = met.where("page = of").select("doc_id", "page", F.greatest(F.col("b_start") - F.col("a_start"), F.lit(0)).alias("start"), (F.least("b_end", "a_end") - F.col("a_start")).alias("end"), F.coalesce("html", F.lit("")).alias("text"))
    edits = own.groupBy("doc_id", "page").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "text")).alias("edits"))
    cut = F.substring(F.col("content"), F.col("start") + 1, F.col("end") - F.col("start"))
    each = p.join(contents.select("doc_id", "content"), "doc_id").select("doc_id", "page", cut.alias("cut")).join(edits, ["doc_id", "page"], "left")
    return each.select("doc_id", "page", F.trim(spliced(F.col("cut"), F.coalesce("edits", F.array().cast(EDITS)))).alias("text"))


# The kinds of cells that stand in a table's head, and those that head a row.
HEAD_KINDS, ROW_KINDS = ("columnHeader", "stubHead"), ("rowHeader",)


def grid_html(cells: list[dict], columns: int = 0, page: int | None = None, caption: str = "") -> str:
    """FN-43: cells (r, c, text and, if given, rs, cs, kind, pages) as an HTML table with head and body; "" without any.

    The head stands on every page, of the body the cells of the given page. Spans are cut at the table's width and
    count rows of the page alone; what no cell covers is an empty cell.
    """
    width = columns or max((x["c"] + (x.get("cs") or 1) for x in cells), default=0)
    head = [x for x in cells if x.get("kind") in HEAD_KINDS]
    body = [x for x in cells if x.get("kind") not in HEAD_KINDS and (page is None or page in (x.get("pages") or ()))]
    if not head and not body:
        return ""
    tops, lows = sorted({x["r"] for x in head}), sorted({x["r"] for x in body})
    there = {*tops, *lows}
    at, covered = {}, set()
    for x in (x for x in [*head, *body] if x["c"] < width):
        rows, cs = range(x["r"], x["r"] + max(1, x.get("rs") or 1)), min(max(1, x.get("cs") or 1), width - x["c"])
        at[x["r"], x["c"]] = (x, max(1, len(there.intersection(rows))), cs)
        covered |= {(r, c) for r in rows for c in range(x["c"], x["c"] + cs)} - {(x["r"], x["c"])}

    def row(r: int, tag: str) -> str:
        out = []
        for c in (c for c in range(width) if (r, c) not in covered):
            x, rs, cs = at.get((r, c), ({"text": ""}, 1, 1))
            mark = "th" if x.get("kind") in ROW_KINDS and tag == "td" else tag
            more = "".join(f' {k}="{v}"' for k, v in (("rowspan", rs), ("colspan", cs)) if v > 1) + (' scope="row"' if mark != tag else "")
            out.append(f"<{mark}{more}>{escape(str(x['text']))}</{mark}>")
        return "\n".join(["<tr>", *out, "</tr>"])

    parts = ["<table>"] + ([f"<caption>{escape(caption)}</caption>"] if caption else [])
    for rows, tag, group in ((tops, "th", "thead"), (lows, "td", "tbody")):
        if rows:
            parts += [f"<{group}>", *(row(r, tag) for r in rows), f"</{group}>"]
    return "\n".join([*parts, "</table>"])


CELLS = "array<struct<r:int,c:int,text:string,rs:int,cs:int,kind:string,pages:array<int>>>"


def grid_tables(cells: Column, page: Column) -> Column:
    """FN-43: grid_html over columns, of cells (CELLS) on a page."""

    def value(v):
        """Arrow gives whole numbers beside nulls as floats, and arrays as numpy's."""
        if isinstance(v, float):
            return None if v != v else int(v)
        return v.tolist() if hasattr(v, "tolist") else v

    def each(all_cells: pd.Series, pages: pd.Series) -> pd.Series:
        plain = lambda x: {k: value(v) for k, v in x.items()}
        return pd.Series([None if cs is None else grid_html([plain(x) for x in cs], page=None if pd.isna(p) else int(p)) for cs, p in zip(all_cells, pages, strict=True)], dtype=object)

    return F.pandas_udf(each, "string")(cells.cast(CELLS), page)
