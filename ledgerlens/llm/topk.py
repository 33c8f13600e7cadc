"""Exact top-k by inner product: ball trees per shard, branch and bound.

Vectors are made integer, dealt into shards of bounded size, and every shard
is indexed once by a ball tree, stored as one row in the shared folder. Queries
come in blocks. A query walks a tree from its root by a heap of nodes, the
largest upper bound q.c + |q| r first, and ends where that bound falls below
its k-th score. A first pass goes down to each shard's most promising leaves
only; the best k-th score that any shard then has is shared with all, and the
second pass starts from it.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

SCALE, K = 1024, 10
#: Rows in a shard, in a leaf, and queries in a block: what one task holds.
SHARD_ROWS, LEAF_ROWS, QUERY_BLOCK = 8192, 128, 2048


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long) and dim; without vectors or ids that are null, empty vectors,
    and vectors that hold null or non-finite components. A finite component that
    leaves the range of long when scaled ends the query with an error."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = lambda e: F.when(F.abs(e * scale) >= float(1 << 63), F.raise_error(F.lit("a vector's component leaves the range of long"))).otherwise(F.floor(e * scale)).cast("long")
    return vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size(x) > 0) & fine).select(
        F.col("vec_id").cast("long"), F.transform(x, whole).alias("v"), F.size(x).alias("dim")
    )


def build(ids: np.ndarray, v: np.ndarray, leaf: int) -> dict:
    """A ball tree: rows in leaf order and, for each node, its range of rows, centre, radius and children (-1 for leaves).

    Nodes are cut at the median of their widest component until a leaf is small.
    """
    order, nodes, todo = np.arange(len(ids)), [], [(0, len(ids), -1, 0)]
    children: list[list[int]] = []
    while todo:
        a, b, parent, side = todo.pop()
        if parent >= 0:
            children[parent][side] = len(nodes)
        nodes.append((a, b))
        children.append([-1, -1])
        if b - a <= leaf:
            continue
        part = order[a:b]
        dim = int(np.argmax(np.ptp(v[part], axis=0)))
        mid = (b - a) // 2
        order[a:b] = part[np.argpartition(v[part, dim], mid)]
        todo += [(a, a + mid, len(nodes) - 1, 0), (a + mid, b, len(nodes) - 1, 1)]
    real = v[order].astype(np.float64)
    centre = np.stack([real[a:b].mean(axis=0) for a, b in nodes])
    radius = np.asarray([np.sqrt(((real[a:b] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(nodes, centre, strict=True)])
    return {"ids": ids[order], "v": v[order], "nodes": nodes, "children": children, "centre": centre, "radius": radius}


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row a shard: dim, shard, tree (bytes)."""
    small_batches(vectors.sparkSession)
    n = vectors.count()
    shards = max(1, -(-n // shard_rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("tree", pa.binary())])

    def grow(key, table):
        dim = key[0].as_py()
        ids = table.column("vec_id").to_numpy()
        v = np.asarray(table.column("v").combine_chunks().flatten(), np.int64).reshape(len(ids), dim)
        trees = []
        for a in range(0, len(ids), 4 * shard_rows):  # repeated rows may overfill a shard
            trees.append(pickle.dumps(build(ids[a : a + 4 * shard_rows], v[a : a + 4 * shard_rows], leaf_rows)))
        return pa.table([pa.array([dim] * len(trees), pa.int32()), pa.array([key[1].as_py()] * len(trees), pa.int32()), pa.array(trees, pa.binary())], schema=schema)

    return written(dealt.groupBy("dim", "shard").applyInArrow(grow, "dim int, shard int, tree binary"), "ball-trees")


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where they stay below 2**53, else in Python's integers.

    OverflowError where one leaves the range of long.
    """
    most = float(np.abs(rows.astype(np.float64)).max(initial=0)) * float(np.abs(query.astype(np.float64)).max(initial=0)) * len(query)
    if most < 2.0**53:
        return np.rint(rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    own = [int(x) for x in query]
    sums = [sum(a * b for a, b in zip(own, map(int, r), strict=True)) for r in rows]
    if any(not -(1 << 63) <= x < 1 << 63 for x in sums):
        raise OverflowError("an inner product leaves the range of long")
    return np.asarray(sums, np.int64)


class Search:
    """A block of queries against trees; `visited` counts the nodes looked into."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, floor: dict[int, int]) -> None:
        self.ids, self.v, self.k, self.floor, self.visited = ids, v, k, floor, 0
        self.real = v.astype(np.float64)
        self.norm = np.sqrt((self.real**2).sum(1))

    def best(self, tree: dict, first_leaf_only: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per query: its number, ids and scores of the k best of this tree that can matter."""
        bound = self.real @ tree["centre"].T + self.norm[:, None] * tree["radius"][None, :]
        # What rounding may have taken off, of products as large as these.
        size = np.sqrt((tree["centre"] ** 2).sum(1)) + tree["radius"]
        bound += 1e-9 * self.norm[:, None] * size[None, :] + 1
        for q in range(len(self.ids)):
            low, above = self.floor.get(q), bound[q]
            ids, scores, heap = np.empty(0, np.int64), np.empty(0, np.int64), [(-above[0], 0)]
            while heap:
                up, node = heapq.heappop(heap)
                if low is not None and -up < low:
                    break
                self.visited += 1
                left, right = tree["children"][node]
                if left >= 0:
                    heapq.heappush(heap, (-above[left], left))
                    heapq.heappush(heap, (-above[right], right))
                    continue
                a, b = tree["nodes"][node]
                s = products(tree["v"][a:b], self.v[q])
                keep = tree["ids"][a:b] != self.ids[q]
                keep &= True if low is None else s >= low
                ids, scores = np.concatenate([ids, tree["ids"][a:b][keep]]), np.concatenate([scores, s[keep]])
                if len(ids) > self.k:
                    top = np.lexsort((ids, ~scores))[: self.k]  # ~ turns the order and can't overflow
                    ids, scores = ids[top], scores[top]
                if len(ids) >= self.k:
                    low = int(scores.min()) if low is None else max(low, int(scores.min()))
                    if first_leaf_only:
                        break
            yield q, ids, scores


def search(vectors: DataFrame, trees: DataFrame, is_query, k: int = K, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query, its own id's rows left out.

    vectors as integer_vectors() gives them, trees from index() over them.
    Queries and rows of other dimensions don't meet. Ties go to the smaller
    vec_id; repeated rows count each; a query with fewer others gets them all.
    Scores are exact; one that leaves the range of long ends the query with an error.
    Queries reach the executors in blocks of a bounded size.
    """
    spark = trees.sparkSession
    asked = vectors.where(is_query).dropDuplicates(["vec_id", "v"])
    counts = asked.groupBy("dim").count().collect()
    parts = []
    for dim, count in sorted((r["dim"], r["count"]) for r in counts):
        n = -(-count // block)
        for i in range(n):
            own = asked.where(F.col("dim") == dim)
            own = own if n == 1 else own.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)) == i)
            parts.append(_block(spark, trees.where(F.col("dim") == dim), own.select("vec_id", "v").collect(), dim, k))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def _block(spark, trees: DataFrame, queries: list, dim: int, k: int) -> DataFrame:
    ids = np.asarray([r[0] for r in queries], np.int64)
    v = np.asarray([r[1] for r in queries], np.int64).reshape(len(ids), dim)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Search(ids, v, k, {})
        for batch in batches:
            for tree in batch.column("tree"):
                got = [(q, int(scores.min())) for q, _, scores in s.best(pickle.loads(tree.as_py()), True) if len(scores) >= k]
                yield pa.RecordBatch.from_pydict({"q": pa.array([x[0] for x in got], pa.int32()), "low": pa.array([x[1] for x in got], pa.int64())})

    shared = trees.select("tree").mapInArrow(first, "q int, low long").groupBy("q").agg(F.max("low").alias("low")).collect()
    floor = {r["q"]: r["low"] for r in shared}

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Search(ids, v, k, floor)
        for batch in batches:
            for tree in batch.column("tree"):
                q, vec, score = [], [], []
                for i, got, scores in s.best(pickle.loads(tree.as_py()), False):
                    q.append(np.full(len(got), ids[i]))
                    vec.append(got)
                    score.append(scores)
                yield pa.RecordBatch.from_pydict({n: pa.array(np.concatenate(x) if x else [], pa.int64()) for n, x in (("query_id", q), ("vec_id", vec), ("score", score))})

    near = trees.select("tree").mapInArrow(full, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(vectors, index(vectors), F.col("vec_id") % 100 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""
