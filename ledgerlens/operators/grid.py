"""Joins by place: points and boxes, and intervals, that meet in the cells of a grid.

What covers a region is copied to the cells that it touches, and cells join by equality, so rows far apart never
meet. A pair that shares several cells is reported in one of them only: the one where the overlap begins.

The copies are always sorted and merged: Spark estimates them from the files that they are unfolded from, and would
broadcast to each task what is many times larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(width)).cast("long")


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], width: float, height: float | None = None) -> DataFrame:
    """JN-21: each point (keys, x, y, ...) with each box (keys, x1, y1, x2, y2, ...) of its keys that holds it, borders included.

    A point has one cell, so no pair comes twice. width and height (the same if not given): a cell's, about those of
    a common box; any are right, but far smaller ones copy boxes to many cells, and far larger ones compare what is
    far apart. Rows with null coordinates or keys meet nothing; a box turned inside out is empty.
    """
    height = height or width
    span = lambda a, b, side: F.explode(F.sequence(_cell(F.col(a), side), _cell(F.col(b), side)))
    good = boxes.where("x1 <= x2 AND y1 <= y2")
    b = good.select("*", span("x1", "x2", width).alias("__i")).select("*", span("y1", "y2", height).alias("__j"))
    p = points.select("*", _cell(F.col("x"), width).alias("__i"), _cell(F.col("y"), height).alias("__j"))
    inside = F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2"))
    return p.join(b.hint("merge"), [*keys, "__i", "__j"]).where(inside).drop("__i", "__j")


def boxes_overlap(a: DataFrame, b: DataFrame, keys: list[str], width: float) -> DataFrame:
    """JN-21, FN-41: pairs of boxes of equal keys that share a point, as a_x1 .. b_y2 and all other columns.

    Both sides are copied to their cells; a pair counts in the cell of its overlap's lower left corner alone.
    """
    side = ("x1", "y1", "x2", "y2")

    def cells(df: DataFrame, name: str) -> DataFrame:
        out = df.where("x1 <= x2 AND y1 <= y2")
        for lo, hi, at in (("x1", "x2", "__i"), ("y1", "y2", "__j")):
            out = out.select("*", F.explode(F.sequence(_cell(F.col(lo), width), _cell(F.col(hi), width))).alias(at))
        return out.withColumnsRenamed({c: f"{name}_{c}" for c in side})

    met = cells(a, "a").join(cells(b, "b").hint("merge"), [*keys, "__i", "__j"])
    left, low = F.greatest("a_x1", "b_x1"), F.greatest("a_y1", "b_y1")
    own = (left <= F.least("a_x2", "b_x2")) & (low <= F.least("a_y2", "b_y2")) & (_cell(left, width) == F.col("__i")) & (_cell(low, width) == F.col("__j"))
    return met.where(own).drop("__i", "__j")


def interval_overlaps(a: DataFrame, b: DataFrame, keys: list[str], width: int = 4096) -> DataFrame:
    """Pairs of intervals start to end (without end) of equal keys that overlap, as a_start, a_end, b_start, b_end and all other columns."""

    def cells(df: DataFrame, name: str) -> DataFrame:
        out = df.where("start < end").select("*", F.explode(F.sequence(_cell(F.col("start"), width), _cell(F.col("end") - 1, width))).alias("__i"))
        return out.withColumnsRenamed({"start": f"{name}_start", "end": f"{name}_end"})

    begin = F.greatest("a_start", "b_start")
    own = (begin < F.least("a_end", "b_end")) & (_cell(begin, width) == F.col("__i"))
    return cells(a, "a").join(cells(b, "b").hint("merge"), [*keys, "__i"]).where(own).drop("__i")
