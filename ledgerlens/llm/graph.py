"""Connected components, and runs of rows of one key in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


#: Edges that a task reduces to stars at a time.
_AT_ONCE = 100_000


def _stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    names, at = np.unique(np.stack([a, b]), return_inverse=True)
    forest = Forest(len(names))
    for x, y in at.reshape(2, -1).T.tolist():
        forest.join(x, y)
    roots = np.asarray([forest.root(i) for i in range(len(names))], np.int64)
    far = np.flatnonzero(roots != np.arange(len(names)))
    return pa.RecordBatch.from_pydict({"a": pa.array(names[roots[far]], pa.int64()), "b": pa.array(names[far], pa.int64())})


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges (a, b), up to _AT_ONCE of them reduced to stars: the smallest node with each that it reaches there."""
    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= _AT_ONCE:
            yield _stars(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield _stars(*map(np.concatenate, zip(*held, strict=True)))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) for edges (a long, b long).

    Contraction: each node moves to that neighbour (or itself) which is first
    in the round's order, edges follow and loops go. Orders by hash shrink any
    shape by a constant share; those by number settle the stars that tasks make
    of their edges first, about _AT_ONCE edges a task. Tables are dropped as
    their successors stand.
    """
    shape = "a long, b long"
    pairs = written(edges.where("a <> b").mapInArrow(_local_forest, shape), "edges")
    place = None
    for round_ in range(rounds):
        left = pairs.count()
        if not left:
            break
        if round_ == 0:
            fewer = written(pairs.coalesce(1 + left // _AT_ONCE).mapInArrow(_local_forest, shape), "edges")
            dropped(pairs)
            pairs = fewer
        rank = (lambda c: F.xxhash64(c, F.lit(round_))) if round_ % 2 else F.col  # noqa: B023
        both = pairs.union(pairs.select("b", "a"))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("rank"), F.min_by("b", rank("b")).alias("to"))
        move = written(near.where(F.col("rank") < rank("node")).select("node", "to"), "moves")
        moved = pairs
        for end in ("a", "b"):
            of = move.select(F.col("node").alias(f"{end}_was"), F.col("to").alias(f"{end}_to"))
            moved = moved.join(of, F.col(end) == F.col(f"{end}_was"), "left").withColumn(end, F.coalesce(f"{end}_to", end)).select("a", "b")
        after = written(moved.where("a <> b").coalesce(1 + left // _AT_ONCE).mapInArrow(_local_forest, shape), "edges")
        dropped(pairs)
        pairs = after
        if place is None:
            place = move
            continue
        later = move.select(F.col("node").alias("at"), F.col("to").alias("then"))
        here = place.join(later, F.col("to") == F.col("at"), "left").select("node", F.coalesce("then", "to").alias("to"))
        both = written(here.unionByName(move.join(place.select("node"), "node", "left_anti")), "places")
        dropped(move, place)
        place = both
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    dropped(pairs)
    if place is None:
        return written(edges.sparkSession.createDataFrame([], "node long, component long"), "components")
    away = place.where("node <> to")  # a place that others moved to may be the last of all
    smallest = away.groupBy("to").agg(F.least(F.min("node"), F.col("to")).alias("component"))
    each = away.join(smallest, "to").select("node", "component")
    out = written(each.unionByName(smallest.select(F.col("to").alias("node"), "component")), "components")
    dropped(place)
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[pa.Table]:
    """Tables of the rows of one key each; rows of a key must be neighbours.

    Only the run at hand is held, so its size is the caller's to bound.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = np.asarray(batch.column(k))
            change[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(batch.column(k)[a].as_py() for k in keys)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over 0 to n - 1; join() tells whether it linked two trees."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def spanning(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs (row, column) of a boolean matrix that join all that its true entries join, one fewer than the places joined."""
    rows_left, columns_left = np.ones(near.shape[0], bool), np.ones(near.shape[1], bool)
    for first in range(near.shape[0]):
        if not rows_left[first]:
            continue
        rows_left[first] = False
        rows = np.asarray([first])
        while len(rows):
            fresh = np.flatnonzero(columns_left & near[rows].any(axis=0))
            if not len(fresh):
                break
            columns_left[fresh] = False
            yield from zip(rows[near[np.ix_(rows, fresh)].argmax(axis=0)].tolist(), fresh.tolist(), strict=True)
            more = np.flatnonzero(rows_left & near[:, fresh].any(axis=1))
            rows_left[more] = False
            yield from zip(more.tolist(), fresh[near[np.ix_(more, fresh)].argmax(axis=1)].tolist(), strict=True)
            rows = more
