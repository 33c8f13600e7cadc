"""Markdown tables and nested JSON as Arrow-batched functions: what regular expressions can't parse."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_RULE = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$")


def split_row(line: str) -> list[str]:
    """FN-35: the cells of a table line; \\| is no border."""
    cells = re.split(r"(?<!\\)\|", line.strip())
    if cells and not cells[0].strip():
        cells = cells[1:]
    if cells and not cells[-1].strip():
        cells = cells[:-1]
    return [c.strip().replace("\\|", "|") for c in cells]


def tables_in(text: str | None) -> list[dict]:
    """FN-35: the tables of a Markdown text: where each starts, its header and its rows."""
    lines, out, i, at = (text or "").split("\n"), [], 0, 0
    offsets = []
    for x in lines:
        offsets.append(at)
        at += len(x) + 1
    while i + 1 < len(lines):
        if "|" in lines[i] and _RULE.match(lines[i + 1]) and "-" in lines[i + 1]:
            j = i + 2
            while j < len(lines) and "|" in lines[j]:
                j += 1
            out.append({"start": offsets[i], "header": split_row(lines[i]), "rows": [split_row(x) for x in lines[i + 2 : j]]})
            i = j
        else:
            i += 1
    return out


TABLE = "array<struct<start:int,header:array<string>,rows:array<array<string>>>>"


def _over(f, kind: str, column: Column) -> Column:
    """f over a column, in Arrow batches; made when called, as types are parsed by the session."""

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(f)

    return F.pandas_udf(each, kind)(column)


def markdown_tables(text: Column) -> Column:
    """FN-35 over a column."""
    return _over(tables_in, TABLE, text)


def flatten_json(text: str | None) -> list[dict]:
    """FN-38: key and value pairs of one nesting level: k, k.sub, k[i] and k[i].sub; keys that begin with _ or end in
    _score or _citations are left out. Text that is no object gives none."""
    try:
        data = json.loads(text) if text else {}
    except ValueError:
        data = {}
    out = []

    def put(key, value):
        if value is not None and not isinstance(value, (dict, list)):
            out.append({"key": key, "value": value if isinstance(value, str) else json.dumps(value)})

    for k, v in data.items() if isinstance(data, dict) else ():
        if k.startswith("_") or k.endswith(("_score", "_citations")):
            continue
        parts = [(k, v)] if not isinstance(v, list) else [(f"{k}[{i}]", x) for i, x in enumerate(v)]
        for name, x in parts:
            if isinstance(x, dict):
                for sub, y in x.items():
                    put(f"{name}.{sub}", y)
            else:
                put(name, x)
    return out


def json_pairs(text: Column) -> Column:
    """FN-38 over a column."""
    return _over(flatten_json, "array<struct<key:string,value:string>>", text)


def boxes_in(text: str | None) -> list[dict]:
    """FN-40: every object with a polygon, at any depth: page, kind, text and its bounding box."""
    try:
        todo = [(json.loads(text) if text else None, None)]
    except ValueError:
        return []
    out = []
    while todo:
        x, page = todo.pop()
        if isinstance(x, list):
            todo += [(y, page) for y in reversed(x)]
        elif isinstance(x, dict):
            page = x.get("page", page)
            p = x.get("polygon")
            if isinstance(p, list) and len(p) >= 4 and all(isinstance(v, (int, float)) for v in p):
                xs, ys = p[0::2], p[1::2]
                out.append({"page": page, "kind": x.get("type"), "text": x.get("text"), "x1": float(min(xs)), "y1": float(min(ys)), "x2": float(max(xs)), "y2": float(max(ys))})
            todo += [(y, page) for k, y in reversed(x.items()) if k != "polygon"]
    return out


def json_boxes(text: Column) -> Column:
    """FN-40 over a column."""
    return _over(boxes_in, "array<struct<page:int,kind:string,text:string,x1:double,y1:double,x2:double,y2:double>>", text)


def table_html(cells: list[dict]) -> str:
    """FN-43: a grid of cells (r, c, text, spans) as an HTML table."""
    rows: dict[int, list[str]] = {}
    for x in sorted(cells, key=lambda x: (x["r"], x["c"])):
        span = "".join(f' {n}="{x[k]}"' for n, k in (("rowspan", "rs"), ("colspan", "cs")) if (x.get(k) or 1) > 1)
        text = str(x["text"]).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        rows.setdefault(x["r"], []).append(f"<td{span}>{text}</td>")
    return "<table>" + "".join(f"<tr>{''.join(v)}</tr>" for _, v in sorted(rows.items())) + "</table>"
