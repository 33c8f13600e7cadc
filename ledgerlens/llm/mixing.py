"""Mixing sources to target weights by entropy balancing.

Rates r_i near 1 in relative entropy, at most 2, are sought under one token
constraint a source: sum r_i * size_i = target. The dual is convex with one
multiplier a source, and its solution tilts exponentially:
r_i = min(2, exp(lambda_s * u_i)), where u_i = size_i / (size_i + mean size),
entropy being weighed by size_i + mean size. Newton steps sum over a histogram
of (source, size); rates are then rounded into whole copies.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cuts
from .common import dropped, written

WEIGHTS, BUDGET, CAP = (3, 1, 2), Fraction(3, 2), 2


def targets(sizes: dict[str | None, int], weights=WEIGHTS, budget=BUDGET, cap=CAP) -> dict[str | None, float]:
    """Each source's words: shares of the budget by weight, none above cap times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, free = budget * sum(sizes.values()), {}, list(order)
    while free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        if not (over := [s for s in free if share[s] > cap * sizes[s]]):
            out |= share
            break
        for s in over:
            out[s] = Fraction(cap * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return {s: float(out[s]) for s in order}


def _rate(lam="lam", mean="mean"):
    return F.when(F.col("size") <= 0, 1.0).when(F.col("full"), float(CAP)).otherwise(
        F.least(F.lit(float(CAP)), F.exp(F.col(lam) * F.try_divide(F.col("size"), F.col("size") + F.col(mean))))
    )


def _exact(x):
    """Sums of this don't depend on the order of the rows."""
    return F.sum(F.round(x * 1000).cast("decimal(38,0)"))


def solve(hist: DataFrame, stats: dict[int, tuple[int, int, float]], rounds: int = 60, close: float = 1e-7) -> dict[int, tuple[float, float, bool]]:
    """node -> (lambda, mean size, whether every document is taken CAP times).

    hist: node, size, n. stats: node -> (words, documents, target). Newton,
    kept inside the bracket that the sums so far leave.
    """
    spark, out, state = hist.sparkSession, {}, {}
    for node, (words, n, target) in stats.items():
        mean = words / n if n else 0.0
        full = words > 0 and target >= CAP * words * (1 - 1e-12)
        out[node] = (0.0, mean, full)
        if words > 0 and not full:
            state[node] = [2 * math.log(max(target, 1e-9) / words), -math.inf, math.inf]
    for _ in range(rounds):
        if not state:
            break
        now = spark.createDataFrame([(n, s[0], out[n][1], False) for n, s in state.items()], "node int, lam double, mean double, full boolean")
        u = F.try_divide(F.col("size"), F.col("size") + F.col("mean"))
        words = F.col("n") * F.col("size") * F.col("r")
        sums = hist.join(F.broadcast(now), "node").withColumn("r", _rate()).groupBy("node").agg(
            _exact(words).alias("g"), _exact(F.when(F.col("r") < CAP, words * u).otherwise(0.0)).alias("d")
        )
        for r in sums.collect():
            s, target = state[r["node"]], stats[r["node"]][2]
            off, slope = float(r["g"]) / 1000 - target, float(r["d"]) / 1000
            out[r["node"]] = (s[0], *out[r["node"]][1:])
            if abs(off) <= close * max(target, 1.0):
                del state[r["node"]]
                continue
            s[1 if off < 0 else 2] = s[0]
            to = s[0] - off / slope if slope > 0 else math.nan
            if not s[1] < to < s[2]:
                to = s[0] + (1 if off < 0 else -1) * max(1.0, abs(s[0])) if math.isinf(s[1]) or math.isinf(s[2]) else (s[1] + s[2]) / 2
            s[0] = to
    return out


def _measured(docs: DataFrame, rid: Column, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        rid.alias("__rid"), "doc_id", "source",
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).cast("double").alias("h"), *more,
    )


def copies(docs: DataFrame, max_sources: int = 100_000) -> DataFrame:
    """A row a document: __rid, doc_id, source, size, source_size, target, rate and copies (0 to 2).

    docs must carry a stable __rid. Size: runs of characters other than space
    and 0x09 to 0x0D; a null text has none. A null source is one of its own,
    the last. Documents without words are kept once. The whole parts of the
    rates are copies; the rest of a source's target goes, one copy each, to the
    documents that a hash of id and text ranks first by its value over the
    rate's fraction, so that reruns agree. Sources are metadata: their number is
    bounded by max_sources (more raise an error); an empty table gives no rows.
    """
    rows = written(_measured(docs, F.col("__rid")), "mix-sizes")
    return mixer(rows, max_sources)(rows)


def mixer(rows: DataFrame, max_sources: int = 100_000):
    """From measured rows, what adds source_size, target, rate and copies to any rows so measured.

    Only tables of a row a source are joined, so that texts may stay where they
    are. Rows that __rid doesn't tell apart, of one id and text, are taken alike.
    """
    spark = rows.sparkSession
    hist = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    sums = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("n")).limit(max_sources + 1).collect()
    if len(sums) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    words = {r["source"]: r["words"] for r in sums}
    goal = targets(words)
    number = {s: i for i, s in enumerate(goal)}
    stats = {number[r["source"]]: (r["words"], r["n"], goal[r["source"]]) for r in sums}

    schema = "source string, node int, source_size long, target double"
    named = spark.createDataFrame([(s, i, words[s], goal[s]) for s, i in number.items()], schema)
    numbered = lambda df: df.join(F.broadcast(named), df["source"].eqNullSafe(named["source"])).drop(named["source"])
    solved = solve(numbered(hist).select("node", "size", "n"), stats)
    rates = spark.createDataFrame([(n, *x) for n, x in solved.items()], "node int, lam double, mean double, full boolean")

    def rated_of(measured: DataFrame) -> DataFrame:
        out = numbered(measured).join(F.broadcast(rates), "node").withColumn("rate", _rate())
        out = out.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
        return out.withColumn("k0", F.try_divide(F.col("h") / float(1 << 53), F.col("part")))

    rated = written(rated_of(rows), "mix-rates")
    got = {r["node"]: r["w"] for r in rated.groupBy("node").agg(F.sum(F.col("whole") * F.col("size")).alias("w")).collect()}
    moving = rated.where("part > 0 AND size > 0").select("node", F.col("size").alias("w"), "k0", F.col("h").alias("k1"), F.col("__rid").cast("double").alias("k2"))
    found = cuts.find(moving, ["k0", "k1", "k2"], {n: stats[n][2] - w for n, w in got.items()})
    extra = F.when((F.col("part") > 0) & (F.col("size") > 0) & cuts.before([F.col("k0"), F.col("h"), F.col("__rid")]), 1).otherwise(0)
    dropped(rated)
    cut = cuts.table(spark, found, 3)

    def apply(measured: DataFrame, *keep: str) -> DataFrame:
        return rated_of(measured).join(F.broadcast(cut), "node", "left").select(
            "__rid", "doc_id", "source", "size", "source_size", "target", "rate", (F.col("whole") + extra).cast("int").alias("copies"), *keep
        )

    return apply


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("__rid", F.monotonically_increasing_id())
    return copies(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "rate"
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it; rows that repeat id and text are taken alike."""
    rows = written(_measured(docs, F.lit(0)), "mix-sizes")
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("own")
    taken = mixer(rows)(_measured(docs, F.lit(0), whole), "own").where("copies > 0")
    copied = taken.select("own", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return copied.select(*[F.col(f"own.c{i}").alias(c) for i, c in enumerate(docs.columns)])
