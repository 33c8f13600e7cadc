"""Language identification by Bayesian fusion of evidence.

Three kinds of evidence meet in one posterior a document: the likelihood of the
text's byte trigrams under each language, the declared language (of the markup
or the metadata) through a confusion table, and where the text comes from,
through priors smoothed hierarchically: all documents, then the address suffix,
then the host. Models, table and priors are grouped aggregations over all
documents. A further class, "und", spreads its trigrams evenly: it wins
where no language explains the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, byte_values, groups_of_bytes, small_batches, written

BUCKETS = 4096
UNKNOWN = "und"
#: Trigrams overlap; each counts for less than independent evidence would.
TEMPER = 0.3
#: Documents that a broader level's prior counts for.
KAPPA = 10.0
#: Documents that declare a language for it to be a class; all such languages are, at BUCKETS numbers each.
MIN_DECLARED = 3
#: A document is rejected where "und" is at least this likely.
REJECT_AT = 0.99
#: Rejected documents of up to so many bytes of keys are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20

_LETTERS = bytes(32 if chr(c).isdigit() and c < 128 else WORD_TABLE[c] for c in range(256))


def trigrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte of the joined texts, whether it counts, and where each text's begin.

    Texts are framed by blanks; trigrams that begin with two blanks, or span two texts, don't count.
    """
    joined = b" " + b"  ".join(t or b"" for t in texts) + b"   "
    b = np.frombuffer(joined.translate(_LETTERS), np.uint8)
    x = b.astype(np.uint32)
    code = (x[:-2] * np.uint32(65599) + x[1:-1]) * np.uint32(65599) + x[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int32)
    counts = (b[1:-1] != 32) | ((b[:-2] != 32) & (b[2:] != 32))
    sizes = np.fromiter((len(t or b"") + 2 for t in texts), np.int64, len(texts))
    return bucket, counts, np.concatenate([[0], np.cumsum(sizes)])


def _primary(tag: Column) -> Column:
    """The primary subtag of a language tag: en of en-GB; null where there is none."""
    tag = F.lower(F.regexp_extract(F.coalesce(tag, F.lit("")), r"^\s*([A-Za-z]{2,8})", 1))
    return F.when(tag != "", tag)


def suffix_of(host: Column) -> Column:
    """The last label of a host name; empty for a name without dots."""
    return F.when(host.contains("."), F.lower(F.substring_index(host, ".", -1))).otherwise("")


def train(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """Log likelihoods, a row a language and last an even one for "und". rows: declared, text."""
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            own, texts = batch.column(0).to_pylist(), byte_values(batch.column(1))
            for a, b in groups_of_bytes(texts):
                for x in set(own[a:b]) & set(number):
                    bucket, counts, _ = trigrams([t for t, o in zip(texts[a:b], own[a:b], strict=True) if o == x])
                    total[number[x]] += np.bincount(bucket[counts], minlength=BUCKETS)
        lang, at = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.int32()), "bucket": pa.array(at, pa.int32()), "n": pa.array(total[lang, at], pa.int64())})

    counted = rows.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    table = np.full((len(languages) + 1, BUCKETS), 0.5)
    table[-1] = 1.0
    for r in counted:
        table[r["lang"], r["bucket"]] += r["n"]
    return np.log(table / table.sum(axis=1, keepdims=True))


def score(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """rows with `loglik` (tempered, a value a class) in place of `text`; null where no trigram counts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T

    out = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField("loglik", T.ArrayType(T.DoubleType()))])
    arrow, at = to_arrow_schema(out), rows.columns.index("text")
    flat = model.astype(np.float64)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = byte_values(batch.column(at)), []
            for a, b in groups_of_bytes(texts):
                bucket, counts, start = trigrams(texts[a:b])
                n = np.concatenate([[0], np.cumsum(counts)])
                begin, end = start[:-1], np.minimum(start[1:] - 1, len(counts))
                each = np.empty((b - a, len(flat)))
                for i, row in enumerate(flat):
                    sums = np.concatenate([[0.0], np.cumsum(np.where(counts, row[bucket], 0.0))])
                    each[:, i] = (sums[end] - sums[begin]) * TEMPER
                some = n[end] > n[begin]
                found += [x if s else None for x, s in zip(each.tolist(), some, strict=True)]
            columns = [c for i, c in enumerate(batch.columns) if i != at] + [pa.array(found, arrow.field("loglik").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(apply, out)


def _argmax(values: Column, names: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, names)), (F.array_position(values, F.array_max(values)) - 1).cast("int"))


def _normal(logs: Column) -> Column:
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def identify(docs: DataFrame, declared: str = "lang", host: str = "source") -> DataFrame:
    """A row a document: doc_id, __key, lang, posterior, text_lang, declared and accepted.

    Classes are the languages that MIN_DECLARED documents or more declare (primary
    subtags) and "und". A text without letters, null ones included, has no
    language: "und", posterior 1. A null or unlisted declaration says nothing; a
    null host is a host of its own, of no suffix. Equal posteriors go to the
    language first by code.
    "Und" takes a document, which is then not accepted, only where it is at least
    REJECT_AT likely: a few odd tokens don't cost a text its language. Repeated
    rows are told apart by nothing and get the same verdict each. An empty table
    gives no rows; with no declared language at all every text is "und".
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        "doc_id",
        key(declared, host).alias("__key"),
        _primary(F.col(declared)).alias("declared"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        "text",
    )
    heads = rows.where("declared IS NOT NULL").groupBy("declared").count().where(F.col("count") >= MIN_DECLARED).collect()
    languages = sorted(r["declared"] for r in heads if r["declared"] != UNKNOWN)
    names = [*languages, UNKNOWN]
    model = train(rows.select("declared", "text"), languages)
    scores = score(rows, model)
    scores = written(scores.withColumn("text_lang", _argmax(F.col("loglik"), names)).withColumn("suffix", suffix_of(F.col("host"))), "langid")

    # Grouped aggregation: who declares what, and what each suffix and host holds.
    known = scores.where("loglik IS NOT NULL")
    cross = {(r["declared"], r["text_lang"]): r["count"] for r in known.where(F.col("declared").isin(languages)).groupBy("declared", "text_lang").count().collect()}
    said = {x: sum(n for (_, t), n in cross.items() if t == x) for x in names}
    log = lambda d, x: float(np.log((cross.get((d, x), 0) + 1.0) / (said[x] + max(1, len(languages)))))
    confusion = F.coalesce(
        *[F.when(F.col("declared") == d, F.array(*[F.lit(log(d, x)) for x in names])) for d in languages],
        F.array(*[F.lit(0.0)] * len(names)),
    )
    per = [F.sum(F.when(F.col("text_lang") == x, 1).otherwise(0)).alias(f"n{i}") for i, x in enumerate(names)]
    hosts = known.groupBy("host", "suffix").agg(*per)
    suffixes = hosts.groupBy(F.col("suffix").alias("of")).agg(*[F.sum(f"n{i}").alias(f"s{i}") for i in range(len(names))])
    top = hosts.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(names))]).first()
    total = sum(top[i] or 0 for i in range(len(names)))
    broad = [((top[i] or 0) + 1.0) / (total + len(names)) for i in range(len(names))]
    all_s, all_h = sum((F.col(f"s{i}") for i in range(len(names))), F.lit(0)), sum((F.col(f"n{i}") for i in range(len(names))), F.lit(0))
    by_suffix = [(F.col(f"s{i}") + KAPPA * broad[i]) / (all_s + KAPPA) for i in range(len(names))]
    prior = F.array(*[F.log((F.col(f"n{i}") + KAPPA * p) / (all_h + KAPPA)) for i, p in enumerate(by_suffix)])
    priors = written(hosts.join(suffixes, hosts["suffix"] == suffixes["of"]).select(F.col("host").alias("of"), prior.alias("prior")), "langid-priors")

    fused = scores.join(priors, scores["host"] == priors["of"], "left").withColumn(
        "logs", F.zip_with(F.zip_with("loglik", "prior", lambda a, b: a + b), confusion, lambda a, b: a + b)
    )
    fused = fused.withColumn("post", _normal(F.col("logs")))
    unknown = F.coalesce(F.get("post", len(languages)), F.lit(1.0))
    named = F.slice("post", 1, len(languages)) if languages else F.array(F.lit(0.0))
    lang = F.when(unknown >= REJECT_AT, UNKNOWN).otherwise(F.coalesce(_argmax(named, languages or [UNKNOWN]), F.lit(UNKNOWN)))
    return fused.select(
        "doc_id", "__key", lang.alias("lang"), F.when(lang == UNKNOWN, unknown).otherwise(F.array_max(named)).alias("posterior"),
        F.coalesce("text_lang", F.lit(UNKNOWN)).alias("text_lang"), "declared", (lang != UNKNOWN).alias("accepted"),
    )


def key(declared: str = "lang", host: str = "source") -> Column:
    """Tells a document's row by content; rows that share it get the same verdict."""
    return F.xxhash64(F.col("doc_id"), F.col("text"), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in (declared, host)])


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("__key")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without the rejected ones."""
    gone = written(identify(docs).where("NOT accepted").select(F.col("__key").alias("__gone")).distinct(), "langid-rejected")
    small = gone.count() * 16 <= BROADCAST_BYTES
    return docs.join(F.broadcast(gone) if small else gone, key() == gone["__gone"], "left_anti")
