"""Weighted cuts of ordered rows, found by distributed histograms.

Sharding cuts nodes at weighted medians and mixing cuts its last copies; both
need, for many groups at once, the place in an order up to which the weights
come to a target, though ties and one group may hold much of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cut:
    """Rows below `key`, and those at it if `inclusive`, stand before the cut; `key` None: all rows do."""

    key: tuple[float, ...] | None
    inclusive: bool
    weight: float


@dataclass
class _State:
    target: float
    at: int = 0
    prefix: tuple[float, ...] = ()
    low: float = 0.0
    high: float = 0.0
    below: float = 0.0
    few: bool = False


def find(rows: DataFrame, keys: list[str], targets: dict[int, float], bins: int = 256, few: int = 400, block: int = 128) -> dict[int, Cut]:
    """For each node of `targets` the cut whose weight is nearest its target.

    rows: node int, w long, and the double columns `keys`, compared from first
    to last; together they should tell rows apart. Groups go through in blocks,
    so the driver holds at most block * max(bins, few) rows at a time. A group
    without rows gets a cut before which nothing stands.
    """
    out: dict[int, Cut] = {}
    nodes = sorted(targets)
    for i in range(0, len(nodes), block):
        out |= _block(rows, keys, {n: targets[n] for n in nodes[i : i + block]}, bins, few)
    return out


def _held(rows: DataFrame, keys: list[str], states: dict[int, _State]) -> DataFrame:
    """The rows inside the states' brackets, with `key`, the column that a state is at."""
    names = [f"p{i}" for i in range(len(keys))]
    data = [(n, s.at, s.low, s.high, *[*s.prefix, *[0.0] * len(keys)][: len(keys)]) for n, s in states.items()]
    held = rows.sparkSession.createDataFrame(data, "node int, at int, low double, high double, " + ", ".join(f"{n} double" for n in names))
    key = F.coalesce(*[F.when(F.col("at") == i, F.col(k)) for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, (k, p) in enumerate(zip(keys, names, strict=True)):
        same &= (F.col("at") <= i) | (F.col(k) == F.col(p))
    return rows.join(F.broadcast(held), "node").where(same).withColumn("key", key).where("key BETWEEN low AND high")


def _block(rows: DataFrame, keys: list[str], targets: dict[int, float], bins: int, few: int) -> dict[int, Cut]:
    spark = rows.sparkSession
    mine = rows.join(F.broadcast(spark.createDataFrame([(n,) for n in targets], "node int")), "node")
    out = {n: Cut((float("-inf"),) * len(keys), False, 0.0) for n in targets}
    states = {
        r["node"]: _State(targets[r["node"]], low=r["a"], high=r["b"])
        for r in mine.groupBy("node").agg(F.min(keys[0]).alias("a"), F.max(keys[0]).alias("b")).collect()
    }
    while open_ := {n: s for n, s in states.items() if not s.few}:
        bin_ = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * bins))).otherwise(0)
        found = _held(rows, keys, open_).groupBy("node", bin_.alias("bin")).agg(
            F.sum("w").alias("w"), F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")
        ).collect()
        each: dict[int, list] = {}
        for r in sorted(found, key=lambda r: (r["node"], r["bin"])):
            each.setdefault(r["node"], []).append(r)
        for n, s in open_.items():
            for r in each[n]:
                if s.below + r["w"] > s.target:
                    s.low, s.high, s.few = r["a"], r["b"], r["n"] <= few
                    break
                s.below += r["w"]
            else:
                out[n] = Cut(None, True, s.below) if not s.prefix else Cut((*s.prefix, *[float("inf")] * (len(keys) - len(s.prefix))), True, s.below)
                del states[n]
                continue
            if not s.few and s.low == s.high:
                if s.at + 1 == len(keys):  # rows that no key tells apart: they stay together
                    out[n] = Cut((*s.prefix, s.low), False, s.below)
                    del states[n]
                else:
                    s.prefix, s.at, s.low, s.high = (*s.prefix, s.low), s.at + 1, float("-inf"), float("inf")
        fresh = {n: s for n, s in states.items() if s.low == float("-inf")}
        if fresh:
            for r in _held(rows, keys, fresh).groupBy("node").agg(F.min("key").alias("a"), F.max("key").alias("b")).collect():
                states[r["node"]].low, states[r["node"]].high = r["a"], r["b"]
    if states:
        rest: dict[int, list] = {}
        for r in _held(rows, keys, states).select("node", "w", *keys).collect():
            rest.setdefault(r["node"], []).append((tuple(r[k] for k in keys), r["w"]))
        for n, s in states.items():
            below = best = s.below
            cut, inclusive = min(rest[n])[0], False
            for key, w in sorted(rest[n]):
                below += w
                if abs(below - s.target) < abs(best - s.target):
                    cut, inclusive, best = key, True, below
            out[n] = Cut(cut, inclusive, best)
    return out


def table(spark, cuts: dict[int, Cut], keys: int) -> DataFrame:
    """node, cut (a struct of the keys) and inclusive."""
    data = [(n, c.inclusive, *(c.key or (float("inf"),) * keys)) for n, c in cuts.items()]
    df = spark.createDataFrame(data, "node int, inclusive boolean, " + ", ".join(f"c{i} double" for i in range(keys)))
    return df.select("node", "inclusive", F.struct(*[f"c{i}" for i in range(keys)]).alias("cut"))


def before(keys: list[Column]) -> Column:
    """Whether a row joined to table() stands before its group's cut."""
    own = F.struct(*[k.cast("double").alias(f"c{i}") for i, k in enumerate(keys)])
    return (own < F.col("cut")) | (F.col("inclusive") & (own == F.col("cut")))
