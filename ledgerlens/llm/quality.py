"""A quality classifier by compression: which of two dictionaries a text compresses better with.

Two zstandard dictionaries are built, from text labelled good and text labelled
bad, of equal size. A text is compressed with each, whole, in blocks of 2 KB (a
dictionary tells little once a text has its own history to refer to). The
difference of both sizes over their sum, and how far the text was compressed at
all (a text of one word repeated looks the same to both dictionaries, and to
neither like prose), become a score by a logistic regression fitted on labelled
rows that no dictionary was built from.

What is fitted on is bounded by parameters: `ROWS` rows of each label, taken in
the order of a hash, and `TRAIN_BYTES` of text of each label for a dictionary
(of a longer text its first bytes; what is scored is always whole).
The rows' classes are weighted by how many rows of each are labelled in all.

Defined results: null text counts as empty, and empty text gets a score like any
other. Rows of `labels` without a doc_id or with a quality other than 0 or 1
don't count; a doc_id with both is left out. Labels of one kind only, or none:
every score is the smoothed share of good ones, (good + 1) / (all + 2). Repeated
doc_ids are scored each by its own text, and the smallest text of one is learnt
from. Columns other than doc_id, text and the labels' are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_values, dropped, small_batches, written

#: Labelled rows of each kind that are fitted on, bytes of text a dictionary is built from, and a dictionary's size.
ROWS, TRAIN_BYTES, DICTIONARY_BYTES = 6000, 8 << 20, 110 << 10
BLOCK, LEVEL, GOOD_FROM = 2048, 3, 0.7
#: Ridge of the regression, and rounds of Newton's method.
RIDGE, NEWTON = 0.01, 50


def held_out(doc_id: Column) -> Column:
    """Rows no label of which is learnt from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def blocks(text: bytes | None) -> list[bytes]:
    text = text or b""
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] or [b""]


# ---------------------------------------------------------------- dictionaries
def dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; of too little text for that, the text's last bytes themselves."""
    samples = [b for t in texts for b in blocks(t) if b]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressor(words: bytes) -> zstandard.ZstdCompressor:
    if not words:
        return zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
    d = zstandard.ZstdCompressionDict(words)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


def sizes(texts: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """texts without `text`, with size_good and size_bad (compressed bytes) and size (bytes)."""
    keep = [c for c in texts.columns if c != "text"]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = [compressor(good), compressor(bad)]
        for batch in batches:
            values = byte_values(batch.column("text"))
            each = [np.fromiter((sum(len(c.compress(b)) for b in blocks(t)) for t in values), np.int64, len(values)) for c in by]
            whole = np.fromiter((len(t or b"") for t in values), np.int64, len(values))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, (*each, whole))], [*keep, "size_good", "size_bad", "size"])

    kinds = dict(texts.dtypes)
    return texts.mapInArrow(measured, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", size_good long, size_bad long, size long")


# ---------------------------------------------------------------- calibration
def features() -> list[Column]:
    """The normalised difference, and the logarithm of the compressed share with its square."""
    good, bad = F.col("size_good"), F.col("size_bad")
    share = F.log((good + bad + 1) / (2 * F.col("size") + 16))
    return [F.lit(1.0), 20 * (bad - good) / (good + bad), share, share * share]


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A weighted logistic regression with a small ridge, by Newton's method with halved steps."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + RIDGE / 2 * w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(NEWTON):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (weight * (y - p)) - RIDGE * w)
        before = loss(w)
        while loss(w + step) > before and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass(frozen=True)
class Model:
    """Both dictionaries and the regression's weights; without dictionaries, `base` alone."""

    good: bytes | None
    bad: bytes | None
    weights: tuple[float, ...]
    base: float

    def scored(self, documents: DataFrame) -> DataFrame:
        """doc_id, score, size_good and size_bad of every document."""
        if self.good is None:
            return documents.select("doc_id", F.lit(self.base).alias("score"), F.lit(None).cast("long").alias("size_good"), F.lit(None).cast("long").alias("size_bad"))
        logit = sum((w * f for w, f in zip(self.weights, features(), strict=True)), F.lit(0.0))
        score = 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(500.0)), F.lit(-500.0))))
        return sizes(documents.select("doc_id", "text"), self.good, self.bad).select("doc_id", score.alias("score"), "size_good", "size_bad")


def trained(documents: DataFrame, labels: DataFrame, rows: int = ROWS, train_bytes: int = TRAIN_BYTES, size: int = DICTIONARY_BYTES) -> Model:
    """A model of the labels of rows that aren't held out."""
    small_batches(documents.sparkSession)
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
        .select("doc_id", "quality")
    )
    known = written(known.join(documents.select("doc_id").distinct(), "doc_id"), "known-quality")
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    n_good, n_bad = counts.get(1, 0), counts.get(0, 0)
    base = (n_good + 1) / (n_good + n_bad + 2)
    if not n_good or not n_bad:
        dropped(known)
        return Model(None, None, (), base)
    order = F.xxhash64("doc_id", F.lit("quality"))
    chosen = known.where("quality = 1").orderBy(order, "doc_id").limit(rows).unionByName(known.where("quality = 0").orderBy(order, "doc_id").limit(rows))
    chosen = chosen.withColumns({"place": order, "builds": F.pmod(F.xxhash64("doc_id", F.lit("dictionary")), F.lit(2)) == 0})
    sample = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = written(sample.groupBy("doc_id", "quality", "place", "builds").agg(F.min("text").alias("text")), "quality-sample")
    # By size first: no more text comes to the driver than dictionaries are built from, in bytes, whatever a row holds.
    every = sample.select("doc_id", "quality", "builds", F.least(F.octet_length("text"), F.lit(train_bytes)).alias("size")).orderBy("place", "doc_id").collect()
    fit = {q: [r for r in every if r["quality"] == q and r["builds"]] or [r for r in every if r["quality"] == q] for q in (0, 1)}
    most = min(train_bytes, *(sum(r["size"] for r in some) for some in fit.values()))
    ids = [i for some in fit.values() for i in _first(some, most)]
    head = F.substring(F.encode("text", "utf-8"), 1, train_bytes)
    texts = sample.where(F.col("doc_id").isin(ids)).orderBy("place", "doc_id").select("quality", head.alias("text")).collect()
    good, bad = (dictionary([bytes(r["text"]) for r in texts if r["quality"] == q], size) for q in (1, 0))
    found = sizes(sample.where("NOT builds").select("quality", "text"), good, bad).select("quality", F.array(*features()).alias("x")).collect()
    dropped(known, sample)
    y = np.array([r["quality"] for r in found], np.float64)
    if 0 < y.sum() < len(y):
        share = np.where(y == 1, n_good / y.sum(), n_bad / (len(y) - y.sum())) * len(y) / (n_good + n_bad)
        weights = tuple(fitted(np.array([r["x"] for r in found]), y, share).tolist())
    else:  # no rows of both kinds are left to fit it: the difference, about the base
        weights = (float(np.log(base / (1 - base))), 1.0, 0.0, 0.0)
    return Model(good, bad, weights, base)


def _first(rows: list, most: int) -> list:
    """Ids in order, up to `most` bytes of text."""
    out, total = [], 0
    for r in rows:
        if total and total + r["size"] > most:
            break
        out.append(r["doc_id"])
        total += r["size"]
    return out


def classified(documents: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted, and the compressed sizes behind the score."""
    scores = trained(documents, labels, **parameters).scored(documents)
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"), "size_good", "size_bad")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
