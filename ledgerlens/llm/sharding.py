"""K-d tree partitioning of documents into shards of near equal bytes.

A node of the tree is split across its widest metadata dimension at the
weighted median, found by distributed histograms, until every leaf holds one
shard's bytes. Only a narrow table of metadata takes part. Dimensions are the
source and the language; copies of a text share those of one of them, so that
they stay neighbours in every order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cuts
from .common import numbered, written

SHARDS = 40
OVERHEAD = 16


def _as_unit(x: Column) -> Column:
    """A category's place in [0, 1): its hash, so that nothing is collected."""
    return F.shiftrightunsigned(F.xxhash64(x), 11).cast("double") / float(1 << 53)


def metadata(docs: DataFrame) -> DataFrame:
    """__rid, doc_id, size, text_crc32, the dimensions d0 (source) and d1 (language) and the tie keys.

    The dimensions are the smallest of all rows that share the text's checksum and size.
    """
    names = set(docs.columns)
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    part = docs.select(
        F.col("__rid"),
        "doc_id",
        (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        *[_as_unit(F.col(c)).alias(d) if c in names else F.lit(0.0).alias(d) for c, d in (("source", "d0"), ("lang", "d1"))],
    )
    part = written(part, "kd-rows")
    copies = part.groupBy("text_crc32", "size").agg(F.count("*").alias("n"), F.min("d0").alias("c0"), F.min("d1").alias("c1")).where("n > 1").drop("n")
    part = part.join(copies, ["text_crc32", "size"], "left").withColumns({"d0": F.coalesce("c0", "d0"), "d1": F.coalesce("c1", "d1")})
    return part.select(
        "__rid", "doc_id", "size", "text_crc32", "d0", "d1",
        F.col("text_crc32").cast("double").alias("k1"),
        F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double").alias("k2"),
        F.col("__rid").cast("double").alias("k3"),
    )


def tree(meta: DataFrame, shards: int) -> DataFrame:
    """meta with `node`, the shard: leaves 0 to shards - 1.

    A node is named by its first shard. Equal dimension values go by the text's
    checksum, then the id, so a text's copies are parted only where a cut runs
    through them. A cut is off its target by half of one document at most, so a
    shard's bytes are off the mean by less than one of the largest documents.
    """
    spark, dims = meta.sparkSession, ["d0", "d1"]
    rows, wide, level = meta.withColumn("node", F.lit(0)), {0: shards}, 0
    while any(m > 1 for m in wide.values()):
        stats = rows.groupBy("node").agg(
            F.sum("size").alias("w"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))]
        ).collect()
        split, targets = [], {}
        for r in stats:
            if (m := wide[r["node"]]) > 1:
                widest = max(range(len(dims)), key=lambda i: (r[f"max_{dims[i]}"] - r[f"min_{dims[i]}"], -i))
                split.append((r["node"], widest, r["node"] + m // 2))
                targets[r["node"]] = r["w"] * (m // 2) / m
        if not split:
            break
        plan = spark.createDataFrame(split, "node int, dim int, right int")
        rows = rows.join(F.broadcast(plan) if len(split) <= 10_000 else plan, "node", "left").withColumn(
            "k0", F.coalesce(*[F.when(F.col("dim") == i, F.col(d)) for i, d in enumerate(dims)])
        )
        moving = rows.where("dim IS NOT NULL").select("node", F.col("size").alias("w"), "k0", "k1", "k2", "k3")
        found = cuts.find(moving, ["k0", "k1", "k2", "k3"], targets)
        where = cuts.table(spark, found, 4)
        rows = rows.join(F.broadcast(where) if len(found) <= 10_000 else where, "node", "left").withColumn(
            "node", F.when(F.col("dim").isNull() | cuts.before([F.col(f"k{i}") for i in range(4)]), F.col("node")).otherwise(F.col("right"))
        ).select(*meta.columns, "node")
        wide = {n: x for a, m in wide.items() for n, x in (((a, m // 2), (a + m // 2, m - m // 2)) if m > 1 else ((a, m),))}
        level += 1
        if level % 2 == 0:
            rows = written(rows, "kd-level")
    return rows


def slots(rows: DataFrame, shards: int, per_bucket: int = 50_000) -> DataFrame:
    """rows with `slot`, gapless from 0 in each shard, by counts of hash buckets and places within them."""
    n = rows.count()
    buckets = max(16, -(-n // (shards * per_bucket)) * 4)
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("__rid"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("node", "__bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("node").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("node", "__bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("node", "__bucket").orderBy("doc_id", "text_crc32", "__rid"))
    return rows.withColumn("__place", place).join(start, ["node", "__bucket"]).withColumn("slot", F.col("__start") + F.col("__place") - 1)


def assign(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """A row a document: __rid, doc_id, size, text_crc32, shard and slot. docs must carry a stable __rid.

    Either `shards` leaves, or as many as bring each to target_bytes. Null
    texts have no bytes and the checksum of an empty text. Null sources,
    languages and ids are values of their own. Repeated rows are placed one by
    one. With fewer documents than shards some shards stay empty; an empty
    table gives no rows.
    """
    meta = written(metadata(docs), "kd-meta")
    if target_bytes:
        shards = max(1, round((meta.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    placed = written(tree(meta, shards), "kd-leaves")
    return slots(placed, shards).select("__rid", "doc_id", "size", "text_crc32", F.col("node").alias("shard"), "slot")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    docs = numbered(spark.read.parquet(f"{sf_dir}/documents.parquet"), "kd-docs")
    return assign(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with shard, slot and size, in place of columns of those names."""
    rows = numbered(docs, "kd-docs")
    placed = assign(rows).select(F.col("__rid").alias("__of"), F.col("text_crc32").alias("__crc"), "shard", "slot", "size")
    crc = F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot", "size", "__rid")]
    kept = rows.select("__rid", crc.alias("__own_crc"), *own)
    return kept.join(placed, (F.col("__rid") == F.col("__of")) & (F.col("__own_crc") == F.col("__crc"))).drop("__rid", "__own_crc", "__of", "__crc")
