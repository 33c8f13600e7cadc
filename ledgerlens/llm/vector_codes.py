"""Vector code compression: product codes, whose nearest entries are found by annular norm pruning.

An integer vector is cut into equal parts, and each part is coded by the nearest
of its position's entries. Entries are sorted by norm once. By the triangle
inequality an entry nearer than the best one known has a norm within that
distance of the part's own, so the entries nearest in norm are measured first, the
interval of norms their best distance allows is found by binary search, both ends
included, and only the entries of that annulus are measured, exactly. Codebooks
are trained by rounds of assignment and componentwise means: each task sums what
it assigns, Spark adds up the tasks' sums (entries times parts rows), and the
codebooks, bounded by `entries` times the dimension, go back with the next round.

Defined results: rows whose vector is null, empty, or holds a null or non-finite
component are dropped. The dimension is that of the smallest vec_id whose vector
divides into the parts; a kept row of another length has null code and error,
and starts or moves no codebook. A null vec_id is coded but starts no codebook;
of repeated vec_ids the smallest vector starts it. Fewer vec_ids than entries
give shorter codebooks; none at all, null codes and errors. A component of
1 << 24 or more once scaled (65536 in the vectors, at 256) ends the query with
an error, as distances must stay exact. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, written

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Entries measured for a first distance.
NEAR = 12
#: Scaled components stay below it, so that squared distances of up to 4096 dimensions fit a long.
RANGE = 1 << 24


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding (doubles) of the rows whose vectors are whole."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & (F.size(x) > 0) & fine).select("vec_id", "label", x.alias("embedding"))


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    y = np.floor(x * scale)
    if len(y) and np.abs(y).max() >= RANGE:
        raise ValueError(f"a vector's component reaches {RANGE} once scaled")
    return y.astype(np.int64)


# ---------------------------------------------------------------- the nearest entries
class Annuli:
    """The entries of one codebook by norm."""

    def __init__(self, entries: np.ndarray) -> None:
        squares = (entries * entries).sum(1)
        self.index = np.argsort(squares, kind="stable")
        self.entries, self.norms = entries[self.index], np.sqrt(squares[self.index].astype(np.float64))
        self.looked_at = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of x, the nearest entry's index (the lowest of ties) and squared distance, both exact."""
        n, k = len(x), len(self.norms)
        norms = np.sqrt((x * x).sum(1).astype(np.float64))
        near = min(NEAR, k)
        first = np.clip(np.searchsorted(self.norms, norms) - near // 2, 0, k - near)[:, None] + np.arange(near)
        away = x[:, None] - self.entries[first]
        best = (away * away).sum(2).min(1) if n else norms
        # Slack for the rounding of square roots keeps both ends in.
        reach = np.sqrt(best.astype(np.float64)) * (1 + 1e-9) + 1e-3
        low, high = np.searchsorted(self.norms, norms - reach, "left"), np.searchsorted(self.norms, norms + reach, "right")
        width = high - low
        begin = np.cumsum(width) - width
        row = np.repeat(np.arange(n), width)
        entry = np.arange(len(row)) - begin[row] + low[row]
        self.looked_at += len(row)
        away = x[row] - self.entries[entry]
        squares = (away * away).sum(1)
        best = np.minimum.reduceat(squares, begin) if n else squares
        index = np.where(squares == best[row], self.index[entry], len(self.index))
        return (np.minimum.reduceat(index, begin) if n else index), best


# ---------------------------------------------------------------- codebooks
@dataclass(frozen=True)
class Codebooks:
    """entries[p][e] is part p's entry e; without vectors to start from there are no entries."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def decoded(self, codes: list[str]) -> np.ndarray:
        """The integer vectors that codes stand for."""
        parts = len(self.entries)
        at = np.array([[int(c[2 * p : 2 * p + 2], 16) for p in range(parts)] for c in codes], np.int64).reshape(-1, parts)
        return self.entries[np.arange(parts), at].reshape(len(at), -1)

    def matrices(self, batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray]:
        """Which rows of a batch have the codebooks' dimension, and those rows' integer parts (row, part, position)."""
        parts, _, width = self.entries.shape
        vectors = batch.column("embedding")
        fits = vectors.value_lengths().to_numpy(zero_copy_only=False) == parts * width
        flat = vectors.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
        return fits, integers(flat, scale).reshape(-1, parts, width)


def started(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> Codebooks:
    """Codebooks from the smallest vec_ids. One pass, but for repeated vec_ids among them."""
    able = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") % parts == 0))
    dim, chosen, last = None, [], None
    while len(chosen) < entries:
        rest = able if last is None else able.where((F.col("vec_id") > last) & (F.size("embedding") == dim))
        some = rest.orderBy("vec_id", "embedding").limit(entries - len(chosen)).select("vec_id", "embedding").collect()
        if not some:
            break
        dim = dim or len(some[0]["embedding"])
        for r in some:
            if r["vec_id"] != last and len(r["embedding"]) == dim:
                last = r["vec_id"]
                chosen.append(r["embedding"])
    x = integers(np.array(chosen, np.float64), scale)
    return Codebooks(x.reshape(len(chosen), parts, -1).transpose(1, 0, 2) if chosen else np.empty((parts, 0, 0), np.int64))


def moved(vectors: DataFrame, books: Codebooks, scale: int = SCALE) -> Codebooks:
    """One round: every part to its nearest entry, every used entry to the floor of its parts' mean."""
    parts, entries, width = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(e) for e in books.entries]
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            _, x = books.matrices(batch, scale)
            for p in range(parts):
                index, _ = annuli[p].nearest(x[:, p])
                n[p] += np.bincount(index, minlength=entries)
                np.add.at(total[p], index, x[:, p])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"part": p.astype(np.int32), "entry": e.astype(np.int32), "n": n[p, e]} | {f"s{j}": total[p, e, j] for j in range(width)})

    schema = "part int, entry int, n long, " + ", ".join(f"s{j} long" for j in range(width))
    found = vectors.select("embedding").mapInArrow(sums, schema).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *(f"s{j}" for j in range(width))))).collect()
    out = books.entries.copy()
    for r in found:
        out[r["part"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return Codebooks(out)


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks after some rounds over all of kept_vectors()."""
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name 256 entries at most")
    small_batches(vectors.sparkSession)
    books = started(vectors, parts, entries, scale)
    for _ in range(rounds if books.entries.size else 0):
        books = moved(vectors, books, scale)
    return books


def coded(vectors: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distances summed over the parts)."""
    parts, entries, _ = books.entries.shape

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(e) for e in books.entries] if entries else []
        for batch in batches:
            n = batch.num_rows
            code, error = np.full(n, None, object), np.zeros(n, np.int64)
            fits = np.zeros(n, bool)
            if entries and n:
                fits, x = books.matrices(batch, scale)
                found = [annuli[p].nearest(x[:, p]) for p in range(parts)]
                error[fits] = sum(d for _, d in found)
                digits = np.stack([i for i, _ in found], 1).astype(np.uint8)
                code[fits] = [row.tobytes().hex() for row in digits]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, mask=~fits)], ["vec_id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(codes, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error (summed over equal labels, nulls together) and codebooks_sha256.

    The labels' sums are written, so that Spark broadcasts them where their real size allows and else shuffles.
    """
    kept = kept_vectors(vectors)
    books = trained(kept, parts, entries, rounds, scale)
    rows = written(coded(kept, books, scale), "codes")
    sums = written(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", "of")
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_ROUND = """
a{i} AS (
  SELECT part, vec_id, v, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist FROM (
    SELECT p.part, p.vec_id, p.v, c.entry, list_sum(list_transform(range(1, len(p.v) + 1), lambda j: (p.v[j] - c.v[j]) * (p.v[j] - c.v[j]))) AS dist
    FROM parts p JOIN c{i} c ON c.part = p.part) GROUP BY part, vec_id, v)"""
_MOVE = """,
m{i} AS (
  SELECT part, entry, list(mean ORDER BY j) AS v FROM (
    SELECT part, entry, j, CAST(floor(sum(v[j])::DECIMAL(38, 0) / count(*)) AS BIGINT) AS mean FROM a{i}, range(1, 257) AS r(j) WHERE j <= len(v) GROUP BY part, entry, j)
  GROUP BY part, entry),
c{k} AS (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.part = c.part AND m.entry = c.entry),"""

OP12_SQL = (
    """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, part, v[CAST(part * len(v) // 16 + 1 AS BIGINT):CAST((part + 1) * len(v) // 16 AS BIGINT)] AS v FROM kept, range(0, 16) AS r(part)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
c0 AS (SELECT p.part, f.entry, p.v FROM parts p JOIN first f ON f.vec_id = p.vec_id),"""
    + "".join(_ROUND.format(i=i) + _MOVE.format(i=i, k=i + 1) for i in range(ROUNDS))
    + _ROUND.format(i=ROUNDS)
    + f""",
codes AS (SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept k JOIN codes USING (vec_id), book
"""
)
